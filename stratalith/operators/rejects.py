"""Typed loading of delimited records with rejects (problem 5).

Records are assembled quote-aware, parsed by the strict csv reader, and checked
field by field; each failing record gets the first reason that applies.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("schema_name", "table_name", "column_name", "ordinal_position", "data_type", "udt_schema", "udt_name", "is_nullable", "default_expression", "comment")
OUT = "schema_name string, table_name string, column_name string, ordinal_position int, data_type string, udt_schema string, udt_name string, is_nullable boolean, default_expression string, comment string, reason string, detail string"
NULL_MARK = "\\N"
MAX_ORDINAL = 2**31 - 1
MAX_TYPE_NAMES = 100_000
# Spellings of booleans in exports.
BOOLEANS = {"t": True, "true": True, "1": True, "f": False, "false": False, "0": False}
_CONTROL = re.compile("[\x00-\x1f\x7f\ufffd]")
_DIGITS = re.compile("[0-9]+")
_ARRAY = re.compile(r"(?: *\[\])+$")
_MODIFIER = re.compile(r"\( *[0-9]+ *(?:, *[0-9]+ *)?\)")
_SPACES = re.compile(" +")
csv.field_size_limit(2**31 - 1)


def assemble(lines: Iterable[str]) -> Iterator[str]:
    """Physical lines (with their ends) joined into records: a line end inside an open quote goes on."""
    held, quotes = [], 0
    for line in lines:
        held.append(line)
        quotes += line.count('"')
        if quotes % 2 == 0:
            yield "".join(held)
            held, quotes = [], 0
    if held:
        yield "".join(held)


def physical_lines(text: str) -> list[str]:
    """Split after CR, LF or CRLF only (not after other Unicode line marks)."""
    return re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", text)


def split_record(raw: str) -> list[str]:
    """Fields of one record; ``csv.Error`` if its quoting is broken."""
    raw = raw.removeprefix("\ufeff").rstrip("\r\n")
    records = list(assemble(physical_lines(raw)))
    if len(records) > 1:
        raise csv.Error("line end outside quotes")
    rows = list(csv.reader(records, strict=True))
    if not rows:
        return [""]  # an empty record has one empty field
    fields = rows[0]
    # the strict reader still takes a quote inside a bare field as text
    if any('"' in f and not quoted for f, quoted in zip(fields, _quoted(raw, fields))):
        raise csv.Error("quote inside a bare field")
    return fields


def _quoted(raw: str, fields: list[str]) -> Iterator[bool]:
    """Which fields begin with a quote in the raw record."""
    at = 0
    for field in fields:
        quoted = raw[at : at + 1] == '"'
        yield quoted
        at += len(field) + (field.count('"') + 2 if quoted else 0) + 1


def base_type(data_type: str) -> str:
    """Type name without array marks and modifiers, lower-case, blanks normalised."""
    name = _ARRAY.sub("", data_type.strip(" \t").lower())
    return _SPACES.sub(" ", _MODIFIER.sub("", name)).strip(" ")


def judge(raw: str | None, type_names: frozenset[str]) -> tuple[list[str] | None, str | None, str | None]:
    """Fields, or the first reason that applies with its detail."""
    if raw is None:
        return None, "column_count", "null record"
    try:
        fields = split_record(raw)
    except csv.Error as error:
        return None, "quoting", str(error)
    if len(fields) != len(FIELDS):
        return None, "column_count", f"{len(fields)} fields"
    name, ordinal, data_type = fields[2], fields[3].strip(" \t"), fields[4]
    if name.strip(" \t") in ("", NULL_MARK) or _CONTROL.search(name):
        return None, "column_name", repr(name)
    digits = ordinal.lstrip("0")
    if not _DIGITS.fullmatch(ordinal) or not 0 < len(digits) <= 10 or int(digits) > MAX_ORDINAL:
        return None, "ordinal_position", ordinal[:80]
    if base_type(data_type) not in type_names:
        return None, "data_type", data_type[:80]
    return fields, None, None


def _typed(fields: list[str] | None) -> list[object]:
    if fields is None:
        return [None] * len(FIELDS)
    text = [None if f.strip(" \t") in ("", NULL_MARK) else f for f in fields]
    text[3] = int(fields[3].strip(" \t"))
    text[7] = BOOLEANS.get((text[7] or "").strip(" \t").lower())
    text[2] = fields[2].strip(" \t")
    text[4] = fields[4].strip(" \t")
    return text


def parse_records(df: DataFrame, type_names: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every record of ``df`` once: typed fields if valid, else nulls with ``reason`` and ``detail``.

    Reasons, first that applies: quoting, column_count, column_name, ordinal_position,
    data_type. A null record is ``column_count``; an empty one has one field and is so
    too. One byte-order mark before and line ends after a record are ignored. Empty and
    ``\\N`` fields become null; a boolean that can't be read becomes null. Repeated
    records each give a row. ``keep`` names columns carried along; others (also
    such as clash with a field's name) aren't read.

    Scale: one narrow Arrow pass without shuffle, in batches. ``type_names`` is the closed
    list of type names; it goes to the workers and is refused beyond 100,000 rows.
    """
    names = frozenset(r[0] for r in type_names.select("type_name").limit(MAX_TYPE_NAMES + 1).collect() if r[0] is not None)
    if len(names) > MAX_TYPE_NAMES:
        raise ValueError("the list of type names is not a small closed list")
    source = df.select(*[F.col(k).alias(f"_k_{k}") for k in keep], F.col(raw).alias("_raw"))
    fields = [f for f in source.schema.fields if f.name != "_raw"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            verdicts = [judge(x, names) for x in batch.column("_raw").to_pylist()]
            columns = list(zip(*(_typed(v[0]) for v in verdicts))) or [()] * len(FIELDS)
            arrays = [batch.column(f.name) for f in fields] + [pa.array(c, t) for c, t in zip(columns, types)]
            arrays += [pa.array([v[i] for v in verdicts], pa.string()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields] + [*FIELDS, "reason", "detail"])

    parsed = source.mapInArrow(run, schema)
    return parsed.select(*[F.col(f"_k_{k}").alias(k if k not in FIELDS else f"source_{k}") for k in keep], *FIELDS, "reason", "detail")


def valid_rows(parsed: DataFrame) -> DataFrame:
    """The typed rows."""
    return parsed.where("reason IS NULL").drop("reason", "detail")


def rejected_rows(parsed: DataFrame) -> DataFrame:
    """The rejects."""
    return parsed.where("reason IS NOT NULL").drop(*FIELDS)
