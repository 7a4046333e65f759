"""Catalog from a Prisma schema file, without a database."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import SparkSession

from stratalith.errors import ConnectorError
from stratalith.sources.catalog import ROWS, Catalog

# The file format's scalar types and the column types they stand for.
SCALARS = {"String": "text", "Int": "integer", "BigInt": "bigint", "Float": "double precision", "Decimal": "numeric", "Boolean": "boolean", "DateTime": "timestamp", "Json": "jsonb", "Bytes": "bytea"}


def find_schema(path: str) -> list[Path]:
    """Schema files: the file itself, schema.prisma or prisma/schema.prisma of a folder, or all its files."""
    at = Path(path)
    if at.is_file():
        return [at]
    for name in ("schema.prisma", "prisma/schema.prisma"):
        if (at / name).exists():
            return [at / name]
    files = sorted(at.glob("*.prisma"))
    if not files:
        raise ConnectorError("no schema file", "PRISMA_MISSING")
    return files


def _argument(text: str, name: str) -> list[str]:
    found = re.search(rf"{name}:\s*\[([^\]]*)\]", text)
    return [x.strip() for x in found[1].split(",")] if found else []


def read_prisma(spark: SparkSession, path: str) -> Catalog:
    """Models as tables, relations as foreign keys, enums as enums; mapped names are used, connection strings ignored."""
    text = "\n".join(p.read_text(encoding="utf-8") for p in find_schema(path))
    text = re.sub(r"//[^\n]*", "", text)
    blocks = re.findall(r"(?m)^\s*(model|enum)\s+(\w+)\s*\{(.*?)^\s*\}", text, re.S)
    enums = {n: body for kind, n, body in blocks if kind == "enum"}
    models = {n: body for kind, n, body in blocks if kind == "model"}
    mapped = lambda body, name: (re.search(r'@@map\("([^"]+)"\)', body) or [None, name])[1]
    space = lambda body: (re.search(r'@@schema\("([^"]+)"\)', body) or [None, "public"])[1]
    columns: dict[str, dict[str, str]] = {}
    rows: dict[str, list[tuple]] = {part: [] for part in ROWS}
    lines = {m: [x.strip() for x in body.split("\n") if re.match(r"\s*\w+\s+\S", x)] for m, body in models.items()}
    for model, body in lines.items():
        columns[model] = {x.split()[0]: (re.search(r'(?<!@)@map\("([^"]+)"\)', x) or [None, x.split()[0]])[1] for x in body}
    for model, body in models.items():
        table, schema = mapped(body, model), space(body)
        rows["tables"].append((schema, table, "r", False, None))
        keys: list[str] = _argument(re.sub(r"@@id\(\[", "@@id(fields: [", body), "@@id\\(fields")
        place = 0
        for line in lines[model]:
            name, kind = line.split()[:2]
            base, many, optional = kind.rstrip("?[]").split("(")[0], kind.endswith("[]"), kind.endswith("?")
            if base in models:
                if fields := _argument(line, "fields"):
                    action = lambda a: (re.search(rf"{a}:\s*(\w+)", line) or [None, "NoAction"])[1]  # noqa: B023, E731
                    word = lambda a: re.sub(r"(?<!^)(?=[A-Z])", "_", a).upper()
                    for i, (own, other) in enumerate(zip(fields, _argument(line, "references"))):
                        rows["foreign_keys"].append((schema, table, f"{table}_{name}_fkey", i + 1, columns[model][own], space(models[base]), mapped(models[base], base), columns[base][other], word(action("onDelete")), word(action("onUpdate"))))
                continue
            place += 1
            native = re.search(r'Unsupported\("([^"]+)"\)', line)
            typed = native[1] if native else SCALARS.get(base, base.lower() if base in enums else base)
            rows["columns"].append((schema, table, columns[model][name], place, typed + ("[]" if many else ""), "", base, optional, (re.search(r"@default\((.*?)\)(?:\s|$)", line) or [None, None])[1], None))
            if re.search(r"(?<!@)@id\b", line):
                keys = [name]
            if re.search(r"(?<!@)@unique\b", line):
                rows["unique_constraints"].append((schema, table, f"{table}_{name}_key", 1, columns[model][name]))
        rows["primary_keys"] += [(schema, table, f"{table}_pkey", i + 1, columns[model][k]) for i, k in enumerate(keys)]
    for name, body in enums.items():
        values = [v.split()[0] for v in body.split("\n") if v.strip() and not v.strip().startswith("@@")]
        rows["enums"] += [(space(body), mapped(body, name), i + 1, v) for i, v in enumerate(values)]
    rows["schemas"] = [(s,) for s in sorted({r[0] for r in rows["tables"]})]
    return {part: spark.createDataFrame(rows[part], ", ".join(f"{k} {v}" for k, v in ROWS[part].items())) for part in ROWS}
