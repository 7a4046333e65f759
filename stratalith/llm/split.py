"""Splitting oversized texts at natural boundaries (problem 1).

Texts and files are handled as byte ranges with halos. Workers detect the boundaries in
each range; the boundary tables of the ranges are stitched by prefix sums of lengths and of
pieces; pieces are then emitted by offset. No task ever holds more than one range of a giant file.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.session import cut_lineage

SEGMENT_BYTES = 1 << 13
RANGE_BYTES = 1 << 14
FILE_RANGE_BYTES = 1 << 20
MAX_TYPES = 10_000
WORD, SENTENCE, PARAGRAPH = 1, 2, 3
_GAP = re.compile(r"\s+|[\u3002\uff01\uff1f\uff0e]+[\u300d\u300f\uff09]*")
_STOPS = frozenset(".!?\u2026:;")
_CLOSERS = "\"')]}\u00bb\u201d\u2019"
_WIDE_STOPS = frozenset("\u3002\uff01\uff1f\uff0e")
BLANK = " \t\r\n"


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places where a piece may end (before the character at the place) and their rank.

    White space belongs to what precedes it. A blank line ends a paragraph; a line end or a
    stop before something other than a digit or small letter ends a sentence; other
    white space ends a word. Each place is judged by its gap and one character on either side.
    """
    places: list[int] = []
    ranks: list[int] = []
    for gap in _GAP.finditer(text):
        at, found = gap.end(), gap.group()
        if found[0] in _WIDE_STOPS:
            if not text[at : at + 1].isspace():
                places.append(at)
                ranks.append(SENTENCE)
            continue
        lines = found.count("\n") or found.count("\r")
        if lines > 1:
            rank = PARAGRAPH
        elif lines:
            rank = SENTENCE
        else:
            before, after = text[gap.start() - 1 : gap.start()], text[at : at + 1]
            if before in _WIDE_STOPS and before:
                rank = SENTENCE
            elif before and before in _CLOSERS and text[gap.start() - 2 : gap.start() - 1] in _STOPS or before in _STOPS and before:
                rank = WORD if after.isdigit() or after.islower() else SENTENCE
            else:
                rank = WORD
        if len(found) > 1 and gap.start() > 0:
            places.append(gap.start())
            ranks.append(WORD)
        places.append(at)
        ranks.append(rank)
    return places, ranks


def _whole(text: str, at: int, least: int) -> int:
    """The place moved back so that no mark or joiner is parted from its base character."""
    place = at
    while place > least and place < len(text) and (unicodedata.combining(text[place]) or text[place] in "\u200d\ufe0e\ufe0f" or text[place - 1] == "\u200d"):
        place -= 1
    return place if place > least else at


def best_cut(text: str, places: list[int], ranks: list[int], least: int, most: int, wanted: int) -> int:
    """The best place in (least, most]: of the highest rank beyond ``wanted``, then of the highest rank, latest; else ``most``."""
    lo, hi = bisect_right(places, least), bisect_right(places, most)
    mid = bisect_right(places, wanted, lo, hi)
    for start in (mid, lo):
        best = 0
        for i in range(hi - 1, start - 1, -1):
            if ranks[i] > best:
                best, at = ranks[i], places[i]
                if best == PARAGRAPH:
                    break
        if best:
            return at
    return _whole(text, most, least)


def cut_segment(text: str, begin: int, end: int, first: int, max_chars: int, overlap: int, table: tuple[list[int], list[int]] | None = None) -> list[tuple[int, int]]:
    """Pieces (start, end) of text[begin:end]; the first repeats text[first:begin] too."""
    places, ranks = boundaries(text) if table is None else table
    pieces: list[tuple[int, int]] = []
    start, done = first, begin
    while done < end:
        stop = end if end - start <= max_chars else best_cut(text, places, ranks, done, min(start + max_chars, end), max(done, start + max_chars // 2))
        pieces.append((start, stop))
        done = stop
        start = overlap_start(places, ranks, stop, overlap, max_chars, start)
    return pieces


def overlap_start(places: list[int], ranks: list[int], end: int, overlap: int, max_chars: int, floor: int = 0) -> int:
    """Where the piece after ``end`` begins: ``overlap`` characters back, or up to a quarter fewer at a natural start, and not before ``floor``."""
    overlap = max(0, min(overlap, max_chars - 1))
    if not overlap:
        return end
    start = max(floor, end - overlap)
    lo, hi = bisect_left(places, start), bisect_right(places, min(end - 1, start + overlap // 4))
    if lo < hi:
        return places[max(range(lo, hi), key=lambda i: (ranks[i], -places[i]))]
    return start


class Slice:
    """Decoded bytes from ``begin`` to ``end`` of a text, with the byte place of every character.

    ``data`` holds the text's bytes from ``data_at`` on. A character that ``begin`` or ``end`` parts is left out; bytes that are
    no UTF-8 count as a character each.
    """

    def __init__(self, data: bytes, data_at: int, begin: int, end: int, whole: int) -> None:
        part = data[begin - data_at : end - data_at]
        skip = 0
        while begin > 0 and skip < min(3, len(part)) and part[skip] & 0xC0 == 0x80:
            skip += 1
        if end < whole:
            part = _complete(part)
        self.text = part[skip:].decode("utf-8", "surrogateescape")
        self.at = begin + skip
        self.places: np.ndarray | None = None
        if len(self.text) != len(part) - skip:
            codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
            escaped = (codes >= 0xDC80) & (codes <= 0xDCFF)
            widths = np.where(escaped, 1, 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))
            self.places = self.at + np.concatenate([[0], np.cumsum(widths)])

    def byte(self, char: int) -> int:
        """Byte place of a character (or of the slice's end)."""
        return self.at + char if self.places is None else int(self.places[char])

    def char(self, byte: int) -> int:
        """The first character that begins at the byte or after it."""
        return min(max(byte - self.at, 0), len(self.text)) if self.places is None else int(np.searchsorted(self.places[:-1], byte))


def _complete(part: bytes) -> bytes:
    """Without a last character whose bytes go on beyond the end."""
    for back in range(1, min(4, len(part)) + 1):
        lead = part[-back]
        if lead & 0xC0 != 0x80:
            wide = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
            return part[:-back] if wide > back else part
    return part


def halos(max_chars: int, overlap: int) -> tuple[int, int]:
    """Bytes that a segment has to see before and after its own."""
    return overlap * 4 + 16, max_chars * 4 + 16


def anchor(data: bytes, data_at: int, place: int, whole: int, max_chars: int) -> int:
    """Byte place where the segment whose bytes begin at ``place`` begins: a best place within one piece's length.

    It depends on fixed bytes around the place only, so that the segment before and the segment itself agree.
    """
    near = Slice(data, data_at, max(0, place - 16), min(whole, place + max_chars * 4 + 16), whole)
    at = near.char(place)
    return near.byte(best_cut(near.text, *boundaries(near.text), at, min(at + max_chars, len(near.text)), at)) if at < len(near.text) else whole


def range_cuts(data: bytes, data_at: int, number: int, per: int, size: int, whole: int, max_chars: int, overlap: int) -> tuple[int, np.ndarray]:
    """The boundary table of one range: how many characters begin in it, and its pieces.

    A range is ``per`` segments of ``size`` bytes. Pieces are rows (first and end character, counted from the range's
    begin, first and end byte). They depend on the segment alone, not on the range that it is in.
    """
    left, right = halos(max_chars, overlap)
    owned, cuts = 0, []
    for k in range(number * per, min((number + 1) * per, max(1, -(-whole // size)))):
        lo, hi = k * size, min((k + 1) * size, whole)
        part = Slice(data, data_at, max(0, lo - left), min(whole, hi + right), whole)
        base, edge = part.char(lo), part.char(hi)
        begin = 0 if k == 0 else part.char(anchor(data, data_at, lo, whole, max_chars))
        end = len(part.text) if hi == whole else part.char(anchor(data, data_at, hi, whole, max_chars))
        if end - begin <= max_chars and k == 0:
            pieces = [(begin, end)] if end > begin else []
        else:
            table = boundaries(part.text)
            pieces = cut_segment(part.text, begin, end, begin if k == 0 else overlap_start(*table, begin, overlap, max_chars), max_chars, overlap, table)
        cuts += [(a + owned - base, b + owned - base, part.byte(a), part.byte(b)) for a, b in pieces]
        owned += edge - base
    return owned, np.array(cuts, np.int64).reshape(-1, 4)


_CUTS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("from", pa.int64()), ("to", pa.int64())]))
_TABLE = pa.struct([("owned", pa.int64()), ("cuts", _CUTS)])
_TABLE_DDL = "owned long, cuts array<struct<a: long, b: long, from: long, to: long>>"


def _table(found: list[tuple[int, np.ndarray]]) -> pa.StructArray:
    offsets = np.concatenate([[0], np.cumsum([len(c) for _, c in found])]).astype(np.int32)
    cuts = np.concatenate([c for _, c in found]) if found else np.zeros((0, 4), np.int64)
    struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(cuts[:, i])) for i in range(4)], fields=list(_CUTS.value_type))
    return pa.StructArray.from_arrays([pa.array([o for o, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), struct)], fields=list(_TABLE))


_PLAN = ("from", "number", "per", "size", "n_bytes", "max_chars", "overlap")


def _ranges(items: DataFrame, range_bytes: int) -> DataFrame:
    """Every range with its halos, in bytes; ``items`` has item, n_bytes, max_chars, overlap."""
    size = F.greatest(F.lit(SEGMENT_BYTES), F.col("max_chars") * 12 + F.col("overlap") * 4 + 64).cast("long")
    planned = items.withColumn("size", size).withColumn("per", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(range_bytes) / F.col("size"))))
    count = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / (F.col("size") * F.col("per"))))
    left, right = halos(F.col("max_chars"), F.col("overlap"))
    return (
        planned.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
        .withColumn("from", F.greatest(F.lit(0), F.col("number") * F.col("per") * F.col("size") - left).cast("long"))
        .withColumn("length", (F.least(F.col("n_bytes"), (F.col("number") + 1) * F.col("per") * F.col("size") + right) - F.col("from")).cast("long"))
    )


def _stitched(found: DataFrame) -> DataFrame:
    """The stitched boundary tables: by prefix sums what comes before each range, in characters and in pieces."""
    order = Window.partitionBy("item").orderBy("number")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("item")
    return found.withColumns({
        "chars_before": F.coalesce(F.sum("owned").over(before), F.lit(0)), "pieces_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "n_pieces": F.sum("n").over(whole),
    })


def split_items(items: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of texts. ``items`` has a unique ``item``, ``text``, ``max_chars`` and ``overlap``.

    Texts are stripped of spaces, tabs, CR and LF at both ends; null and blank texts give no
    pieces; a text within its limit is one piece. Otherwise ordered pieces of at most
    ``max_chars`` code points come out, ended at paragraph, sentence or word ends where
    there are any in the piece (else anywhere, but not inside a combined character). Each piece
    after the first repeats ``overlap`` characters of the one before, or up to a quarter
    fewer to begin at a natural place. An overlap of the limit or more counts as one less than the limit.
    A limit under 1 counts as 1. Pieces without their overlap rebuild the text exactly.

    A text is cut in segments of 8 KiB (more where limits are large), each of which begins a new piece at the best
    boundary within one piece's length, so that segments are independent; ``range_bytes`` only says how many
    segments a worker is given at once, and the pieces are the same for any.

    Returns item, piece_no (from 0), n_pieces, start_char, end_char and piece.

    Scale: boundaries are detected once, in ranges; the ranges are shuffled once, by item, for the prefix sums (without
    their bytes if the pieces' texts aren't asked for); pieces are taken by byte offset in the JVM. A text in a row is at
    most 2 GB, and its ranges are rows of their own before Python sees them; larger ones are files (:func:`split_files`).
    """
    ready = items.select(
        F.col("item").cast("string").alias("item"), F.encode(F.btrim("text", F.lit(BLANK)), "UTF-8").alias("whole"),
        F.greatest(F.lit(1), F.col("max_chars")).cast("int").alias("max_chars"), F.greatest(F.lit(0), F.coalesce("overlap", F.lit(0))).cast("int").alias("overlap"),
    ).withColumn("n_bytes", F.octet_length("whole").cast("long")).where("n_bytes > 0")
    data = F.expr("substring(whole, cast(`from` + 1 as int), cast(length as int))").alias("data")
    ranges = _ranges(ready, range_bytes).select("item", *_PLAN, data)

    @F.arrow_udf(_TABLE_DDL)
    def detect(data: pa.Array, *plan: pa.Array) -> pa.Array:
        rows = zip(data, *[p.to_pylist() for p in plan])
        return _table([range_cuts(text.as_py(), *row) for text, *row in rows])

    found = ranges.withColumn("found", detect("data", *_PLAN)).select("item", "number", "from", "data", "found.owned", "found.cuts", F.size("found.cuts").cast("long").alias("n"))
    pieces = _stitched(found).select("item", "from", "data", "chars_before", "pieces_before", "n_pieces", F.posexplode("cuts").alias("k", "cut"))
    return pieces.select(
        "item", (F.col("pieces_before") + F.col("k")).alias("piece_no"), "n_pieces", (F.col("chars_before") + F.col("cut.a")).alias("start_char"), (F.col("chars_before") + F.col("cut.b")).alias("end_char"),
        F.expr("cast(substring(data, cast(cut.`from` - `from` + 1 as int), cast(cut.`to` - cut.`from` as int)) as string)").alias("piece"),
    )


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = []
        for path in batch.column("item").to_pylist():
            with _open(path) as file:
                sizes.append(file.size())
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(sizes, pa.int64())], names=["item", "n_bytes"])


def _detect_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The boundary table of each range; only the range's bytes are read."""
    for batch in batches:
        for row in batch.to_pylist():
            with _open(row["item"]) as file:
                table = _table([range_cuts(file.read_at(row["length"], row["from"]), *[row[c] for c in _PLAN])])
            yield pa.RecordBatch.from_arrays([pa.array([row["item"]]), pa.array([row["number"]], pa.int64()), *table.flatten()], names=["item", "number", "owned", "cuts"])


_PIECES = pa.schema([("item", pa.string()), ("piece_no", pa.int64()), ("n_pieces", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("piece", pa.string())])


def _emit_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by offset: the bytes of a range's pieces are read again, nothing is detected again."""
    for batch in batches:
        for row in batch.to_pylist():
            if not row["cuts"]:
                continue
            first, last = row["cuts"][0]["from"], row["cuts"][-1]["to"]
            with _open(row["item"]) as file:
                data = file.read_at(last - first, first)
            yield pa.RecordBatch.from_pylist([
                {"item": row["item"], "piece_no": row["pieces_before"] + k, "n_pieces": row["n_pieces"], "start_char": row["chars_before"] + c["a"], "end_char": row["chars_before"] + c["b"],
                 "piece": data[c["from"] - first : c["to"] - first].decode("utf-8", "replace")}
                for k, c in enumerate(row["cuts"])
            ], _PIECES)


def split_files(spark: SparkSession, paths: list[str], max_chars: int, overlap: int, range_bytes: int = FILE_RANGE_BYTES) -> DataFrame:
    """Pieces of UTF-8 files, by byte range: as :func:`split_items`, without stripping; no file is ever read whole.

    Files of any size; paths may be URIs that pyarrow knows (hdfs, s3, file). Empty files give no pieces. Bytes that
    are no UTF-8 come out as replacement characters, and a run of them may come out as fewer.

    Scale: sizes are asked for by the workers. Each range is read once to detect its boundaries; the tables, without
    any text, are written to the shared folder, and their lengths alone are stitched; each range is read once more to
    emit its pieces by offset.
    """
    listed = spark.createDataFrame([(p,) for p in paths], "item string").repartition("item").mapInArrow(_sized, "item string, n_bytes long").where("n_bytes > 0")
    ranges = _ranges(listed.withColumns({"max_chars": F.lit(max(1, max_chars)), "overlap": F.lit(max(0, overlap))}), range_bytes)
    found = cut_lineage(ranges.select("item", "length", *_PLAN).repartition("item", "number").mapInArrow(_detect_files, f"item string, number long, {_TABLE_DDL}"))
    sums = _stitched(found.select("item", "number", "owned", F.size("cuts").cast("long").alias("n"))).drop("owned", "n")
    return found.join(sums, ["item", "number"]).mapInArrow(_emit_files, "item string, piece_no long, n_pieces long, start_char long, end_char long, piece string")


def split_chunks(chunks: DataFrame, limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of chunk texts under the limits of their types.

    Redelivered rows count once: of several rows for one id the one last indexed holds. Rows with a null id
    have no key to lead back to and are left out. Types are compared without case and surrounding spaces; a null or
    unlisted type takes the limit ``*``. ``limits`` is a closed list and is refused beyond 10,000 types; it goes into the plan.
    """
    kind = F.lower(F.trim(F.col("type")))
    listed = limits.groupBy(kind.alias("_type")).agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap")).where("_type IS NOT NULL").limit(MAX_TYPES + 1).collect()
    if len(listed) > MAX_TYPES:
        raise ValueError("the list of limits is not a small closed list")
    last = chunks.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("type", "text"), F.struct("indexed_at", "type", "text")).alias("r"))
    rows = last.select(F.col("id").alias("item"), F.lower(F.trim("r.type")).alias("_type"), F.col("r.text").alias("text"))
    by_type = F.from_json(F.lit(json.dumps({r["_type"]: {"m": r["max_chars"], "o": r["overlap"]} for r in listed})), "map<string, struct<m: int, o: int>>")
    limit = F.coalesce(F.try_element_at(by_type, "_type"), F.try_element_at(by_type, F.lit("*")))
    items = rows.withColumn("_limit", limit).select("item", "text", F.col("_limit.m").alias("max_chars"), F.col("_limit.o").alias("overlap")).where("max_chars IS NOT NULL")
    return split_items(items, range_bytes).withColumnRenamed("item", "id")
