"""Encoding with a public byte-level BPE vocabulary (problem 6).

Texts are cut into units that can't share a token, units into the vocabulary's
pre-tokens, and the distinct pre-tokens of a partition are contracted in DuckDB: a
recursive query joins token-position rows with the merge table and contracts each
word's leftmost minimum-rank pair until no pair is left.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the white space of the pattern (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

SLICE_CHARS = 3_000_000
CACHE_UNITS = 300_000
CACHE_IDS = 6_000_000
CALL_COST = 3_000_000
LONG_WORD = 512

CONTRACT = """
WITH RECURSIVE step(word, pos, tok, live) AS (
  SELECT word, pos, tok, true FROM start_rows
  UNION ALL
  SELECT word, pos, CASE WHEN pair = best THEN merged ELSE tok END, best IS NOT NULL
  FROM (
    SELECT word, pos, tok, merged, pair, min(pair) OVER (PARTITION BY word) AS best, lag(pair) OVER (PARTITION BY word ORDER BY pos) AS left_pair
    FROM (
      SELECT n.word, n.pos, n.tok, m.merged, m.merged::BIGINT * 1048576 + n.pos AS pair
      FROM (SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM step WHERE live) n
      LEFT JOIN merges m ON m.a = n.tok AND m.b = n.nxt))
  WHERE best IS NULL OR left_pair IS NULL OR left_pair <> best)
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE NOT live GROUP BY word ORDER BY word
"""


def read_vocabulary(path: str) -> bytes:
    """The rank file as bytes; under a megabyte, as its format bounds it."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Encoder:
    """Encoder of one worker process, with bounded caches of units and words."""

    def __init__(self, data: bytes) -> None:
        import duckdb
        import regex

        self.ranks = parse_ranks(data)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = {i: t for t, i in self.ranks.items()}
        halves = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, merged = np.array(halves, np.int32).T
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.db.register("pairs", pa.table({"a": np.ascontiguousarray(a), "b": np.ascontiguousarray(b), "merged": np.ascontiguousarray(merged)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM pairs")
        self.db.unregister("pairs")
        self.pattern = regex.compile(PATTERN)
        self.blank_before_space = re.compile(r"\s ")
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.clear()

    def clear(self) -> None:
        """Forget all cached units and words."""
        self.unit_index: dict[str, int] = {}
        self.words: dict[str, list[int]] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        """Units of a text: a token never spans the place where white space follows other characters."""
        if self.blank_before_space.search(text):
            return self.units.findall(text)
        parts = text.split(" ")
        head = parts[0]
        rest = [f" {p}" for p in parts[1:]]
        return [head, *rest] if head else rest

    def contract(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word, by the recursive query."""
        out: list[list[int]] = [[]] * len(words)
        batch: list[tuple[int, bytes]] = []
        cost = 0
        for i, word in enumerate(words):
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > LONG_WORD:
                out[i] = self._long(raw)
                continue
            if batch and cost + len(raw) ** 2 > CALL_COST:
                self._query(batch, out)
                batch, cost = [], 0
            batch.append((i, raw))
            cost += len(raw) ** 2
        if batch:
            self._query(batch, out)
        return out

    def _query(self, batch: list[tuple[int, bytes]], out: list[list[int]]) -> None:
        sizes = np.array([len(raw) for _, raw in batch])
        tokens = self.byte_ids[np.frombuffer(b"".join(raw for _, raw in batch), np.uint8)]
        positions = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = pa.table({"word": np.repeat(np.arange(len(batch)), sizes).astype(np.int32), "pos": positions.astype(np.int32), "tok": tokens})
        self.db.register("start_rows", rows)
        for word, ids in self.db.execute(CONTRACT).fetchall():
            out[batch[word][0]] = ids
        self.db.unregister("start_rows")

    def _long(self, raw: bytes) -> list[int]:
        """The same contraction for a word of over 512 bytes, by a heap of pairs over a linked list."""
        ids = [int(x) for x in self.byte_ids[np.frombuffer(raw, np.uint8)]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (merged := self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]])) is not None:
                heapq.heappush(heap, (merged, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            merged, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def _learn(self, new: list[str]) -> None:
        """Add units to the cache."""
        pieces = [self.pattern.findall(u) for u in new]
        words = list({w for p in pieces for w in p} - self.words.keys())
        self.words.update(zip(words, self.contract(words)))
        known = self.words
        encoded = [list(chain.from_iterable([known[w] for w in p])) for p in pieces]
        lengths = np.array([len(e) for e in encoded], np.int64)
        at = len(self.flat)
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(encoded), np.int32, int(lengths.sum()))])
        self.starts = np.concatenate([self.starts, at + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        base = len(self.unit_index)
        self.unit_index.update((u, base + i) for i, u in enumerate(new))

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts, one after the other, and how many each text has."""
        split = [self.split(t) if t else [] for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        units = list(chain.from_iterable(split))
        codes = self._known(units)
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            new = list(dict.fromkeys([units[i] for i in missing]))
            if len(self.unit_index) + len(new) > CACHE_UNITS or len(self.flat) > CACHE_IDS:
                self.clear()
                new, missing = list(dict.fromkeys(units)), range(len(units))
            self._learn(new)
            codes[missing] = self._known([units[i] for i in missing])
        return codes, counts

    def _known(self, units: list[str]) -> np.ndarray:
        """Numbers of units, -1 for those not in the cache."""
        return np.fromiter(map(self.unit_index.get, units, repeat(-1)), np.int64, len(units))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and how many each text has."""
        codes, counts = self.codes(texts)
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[codes] - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.flat[at], self._per_text(lengths, counts)

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        codes, counts = self.codes(texts)
        return self._per_text(self.lengths[codes], counts)

    @staticmethod
    def _per_text(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]


_ENCODERS: dict[int, Encoder] = {}
_LAST_RUN: list[str] = []


def encoder(shared: Broadcast | bytes, run: str = "") -> Encoder:
    """This process's encoder for a vocabulary. What it learnt of words is kept within one ``run`` of an operator only."""
    data = shared if isinstance(shared, bytes) else shared.value
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data)
    if _LAST_RUN != [run]:
        _ENCODERS[key].clear()
        _LAST_RUN[:] = [run]
    return _ENCODERS[key]


def _slices(column: pa.Array) -> Iterator[list[str]]:
    """The batch's texts in order, in lists of bounded size; null counts as empty."""
    held: list[str] = []
    size = 0
    for value in column:
        text = value.as_py() or ""
        if held and size + len(text) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encode_column(df: DataFrame, text: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` columns and ``ids`` array<int> of every row, without special tokens.

    Strings that look like special tokens are ordinary text. A null and an empty text have
    an empty list; rows repeat as they come; other columns aren't read. Whole texts
    are encoded, however long (a word of over 512 bytes is contracted by a heap in place of
    the query, whose cost is quadratic in the word).

    Scale: one narrow Arrow pass, no shuffle (a scan of fewer partitions than cores is spread first). The vocabulary (under 1 MB, fixed by its format)
    is read on the driver and broadcast; caches are bounded.
    """
    return _apply(df, text, keep, vocabulary, ids=True)


def count_column(df: DataFrame, text: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """As :func:`encode_column`, with ``n_tokens`` in place of the ids."""
    return _apply(df, text, keep, vocabulary, ids=False)


def decode_column(df: DataFrame, ids: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` columns and ``text`` of every row: its tokens' bytes in order, the inverse of :func:`encode_column`.

    Null and empty lists give an empty text; a null or unknown id gives an error; bytes that are no UTF-8 (of lists that
    don't come from encoding) give replacement characters. Scale: one narrow Arrow pass; the vocabulary is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    source = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)], F.col(ids).cast("array<int>").alias("_ids"))
    kept = source.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in parse_ranks(shared.value).items()}
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, row.as_py() or ())).decode("utf-8", "replace") for row in batch.column("_ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), "_out"])

    result = source.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "_out string"]))
    return result.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], F.col("_out").alias("text"))


def _apply(df: DataFrame, text: str, keep: list[str], vocabulary: str, ids: bool) -> DataFrame:
    spark: SparkSession = df.sparkSession
    shared, number = spark.sparkContext.broadcast(read_vocabulary(vocabulary)), uuid.uuid4().hex
    source = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    kept = source.schema.fields[:-1]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "_out array<int>" if ids else "_out bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(shared, number)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("_text")):
                if ids:
                    flat, counts = worker.encode(texts)
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                else:
                    out = pa.array(worker.count(texts))
                rows = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), out], names=[*(f.name for f in kept), "_out"])

    result = spread(source).mapInArrow(run, schema)
    return result.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], F.col("_out").alias("ids" if ids else "n_tokens"))
