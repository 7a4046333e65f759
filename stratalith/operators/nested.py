"""Nested JSON documents as related flat tables (problem 3).

A merged schema is inferred over all documents; each array level becomes a child
table whose rows carry their parent's surrogate key and their place in the array.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.session import cut_lineage

MAX_FIELDS = 200
# Places whose types are looked at in one aggregate; the rest follow in further ones.
MAX_PLACES = 100


@dataclass
class Node:
    """Merged type of one place in the documents: an object, an array or a scalar.

    A place whose type conflicts has kind VARIANT, with the fields of those values that are
    objects and the element of those that are arrays.
    """

    kind: str
    fields: dict[str, Node] = field(default_factory=dict)
    element: Node | None = None


def parse_schema(text: str) -> Node:
    """The tree of a merged schema as ``schema_of_variant_agg`` writes it."""
    at = 0

    def name() -> str:
        nonlocal at
        if text[at] == "`":
            end = at + 1
            while text[end] != "`" or text[end : end + 2] == "``":
                end += 2 if text[end] == "`" else 1
            out, at = text[at + 1 : end].replace("``", "`"), end + 1
            return out
        found = re.match(r"[^:]+", text[at:])
        at += found.end()
        return found.group()

    def node() -> Node:
        nonlocal at
        if text.startswith("OBJECT<", at):
            at += 7
            out = Node("object")
            while text[at] != ">":
                key = name()
                at += 1
                while text[at] == " ":
                    at += 1
                out.fields[key] = node()
                while text[at] in ", ":
                    at += 1
            at += 1
            return out
        if text.startswith("ARRAY<", at):
            at += 6
            out = Node("array", element=node())
            at += 1
            return out
        found = re.match(r"[A-Z_ ]+(?:\([0-9, ]*\))?", text[at:])
        at += found.end()
        return Node(found.group().strip())

    return node()


def read_json(payload: Column) -> Column:
    """Variant of a text that is one complete JSON object, else null.

    In brackets the text must be exactly one array element, so that anything after
    the object is noticed.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))
    elements = F.try_variant_get(wrapped, "$", "array<variant>")
    one = F.when(F.size(elements) == 1, elements[0])
    return F.when(F.schema_of_variant(one).startswith("OBJECT"), one)


def _get(value: Column, name: str, kind: str) -> Column:
    """A field by its name, whatever characters that has; null if the value is no object or lacks it."""
    if "'" in name and '"' in name:  # no variant path can hold both
        return F.try_variant_get(F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name)), "$", kind)
    return F.try_variant_get(value, f'$["{name}"]' if "'" in name else f"$['{name}']", kind)


def merged(nodes: Iterable[Node]) -> Node:
    """One node for values of several: their fields and elements put together, VARIANT where their kinds differ."""
    nodes = [n for n in nodes if n.kind != "VOID"]
    if not nodes:
        return Node("VOID")
    kinds = {n.kind for n in nodes}
    names = dict.fromkeys(name for n in nodes for name in n.fields)
    elements = [n.element for n in nodes if n.element is not None]
    fields = {name: merged(n.fields[name] for n in nodes if name in n.fields) for name in names}
    return Node(kinds.pop() if len(kinds) == 1 else "VARIANT", fields, merged(elements) if elements else None)


def _arrays_below(node: Node) -> int:
    """Arrays that can be named from a place without an explode."""
    return sum((child.element is not None) + _arrays_below(child) for child in node.fields.values())


def infer_schema(documents: DataFrame, document: str) -> Node:
    """Merged schema of all documents; fields whose types conflict are variants.

    Where types conflict, the objects and the arrays among the values are merged apart, so
    that what deviates in one document hides nothing of the others. Scale: one more
    aggregate for each array level that holds conflicts.
    """
    merged = documents.agg(F.schema_of_variant_agg(document).alias("s")).first()["s"]
    schema = parse_schema(merged) if merged else Node("object")
    if _conflicts(schema):
        _refine(documents.select(F.col(document).alias("element")).where("element IS NOT NULL"), schema)
    return schema


def _conflicts(node: Node) -> bool:
    below = [*node.fields.values(), *([node.element] if node.element else [])]
    return node.kind == "VARIANT" or any(map(_conflicts, below))


def _places(value: Column, node: Node) -> Iterator[tuple[Column, Node]]:
    """A value and all fields in it that need no explode."""
    yield value, node
    for name, child in node.fields.items():
        yield from _places(_get(value, name, "variant"), child)


def _refine(level: DataFrame, node: Node) -> None:
    """Fields and elements of the places of one level whose types conflict, then of the levels below."""
    known: set[int] = set()
    while found := [(v, n) for v, n in _places(F.col("element"), node) if n.kind == "VARIANT" and id(n) not in known][:MAX_PLACES]:
        shapes = [F.schema_of_variant_agg(F.when(F.schema_of_variant(v).startswith(kind), v)) for v, _ in found for kind in ("OBJECT", "ARRAY")]
        merged = [parse_schema(s) if s else Node("VOID") for s in level.agg(*[s.alias(f"s{i}") for i, s in enumerate(shapes)]).first()]
        for (_, n), whole, array in zip(found, merged[::2], merged[1::2]):
            known.add(id(n))
            n.fields, n.element = whole.fields, array.element
    for value, n in _places(F.col("element"), node):
        if n.element is not None and _conflicts(n.element):
            below = level.select(F.explode(F.try_variant_get(value, "$", "array<variant>")).alias("element"))
            _refine(below.where(F.col("element").isNotNull() & ~F.is_variant_null("element")), n.element)


def flatten_documents(documents: DataFrame, key: str, document: str, schema: Node | None = None, max_fields: int = MAX_FIELDS) -> dict[str, DataFrame]:
    """Flat tables of nested documents, by path (``""`` the documents themselves).

    ``documents`` has one row per document with a unique ``key`` and a variant column
    ``document`` (see :func:`read_json`); null documents give no rows. Every table has
    ``row_id`` (key and positions, unique over the table), ``parent_id``, ``position``
    (from 0; null elements take a position and give no row), ``ancestors`` (positions
    of the enclosing elements, outermost first), the key, ``element``
    (the variant itself) and a typed ``f_<name>`` column per scalar field of the merged
    schema. Fields absent from a document are null. Objects inside objects are joined
    to their parent by dotted names; fields whose types conflict are JSON text; arrays inside
    them become child tables all the same, and fields of conflicting objects columns.
    Arrays of scalars become child tables with ``value``; of an array directly inside an array the elements
    are the child table ``<path>[]``. Where a field holds no array in some document, that document
    gives no child rows. Of paths that coincide the later get a number.

    An object with more than ``max_fields`` distinct fields is a map in disguise: it is JSON text in its
    parent, and its fields are the rows of a child table ``<path>.*`` with the field's name as ``entry``.
    Arrays in it are child tables by their names, or, if there are more than ``max_fields`` of those too,
    child tables of the entries.

    Scale: each document is parsed once; each level is one generate step without shuffle. The merged schema goes to the
    driver: it grows with the number of distinct field names, which the aggregate merges on the executors first.
    """
    schema = infer_schema(documents, document) if schema is None else schema
    root = documents.where(F.col(document).isNotNull()).select(
        F.col(key), F.col(key).cast("string").alias("row_id"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(None).cast("int").alias("position"), F.array().cast("array<int>").alias("ancestors"), F.col(document).alias("element"),
    )
    tables: dict[str, DataFrame] = {}

    def visit(path: str, level: DataFrame, node: Node, more: tuple[str, ...] = ()) -> None:
        columns: list[Column] = []
        taken: set[str] = set()
        arrays: list[tuple[str, Column, Node]] = []
        maps: list[tuple[str, Column, Node]] = []

        def label(dotted: str) -> str:
            """Column name; names that differ only by case get a number."""
            name, n = f"f_{dotted}", 1
            while name.lower() in taken:
                n += 1
                name = f"f_{dotted}~{n}"
            taken.add(name.lower())
            return name

        def walk(dotted: str, value: Column, current: Node, wide: bool) -> None:
            """Columns and arrays of an object; of a wide one, which is a column itself, the arrays only."""
            if len(current.fields) > max_fields:
                named = _arrays_below(current) <= max_fields
                maps.append((f"{dotted}.*".lstrip("."), value, Node("VARIANT") if named else merged(current.fields.values())))
                if not named:
                    return
                wide = True
            for name, child in current.fields.items():
                field_name = f"{dotted}.{name}" if dotted else name
                if child.kind == "array":
                    arrays.append((field_name, _get(value, name, "array<variant>"), child.element))
                elif child.kind in ("object", "VARIANT"):
                    raw = _get(value, name, "variant")
                    if not wide and (len(child.fields) > max_fields or child.kind == "VARIANT"):
                        columns.append(F.when(~F.is_variant_null(raw), F.coalesce(F.try_variant_get(raw, "$", "string"), F.to_json(raw))).alias(label(field_name)))
                    if child.kind == "VARIANT" and (child.element or not wide):
                        arrays.append((field_name, F.try_variant_get(raw, "$", "array<variant>"), child.element or Node("VARIANT")))
                    walk(field_name, raw, child, wide)
                elif not wide:
                    columns.append(_get(value, name, "string" if child.kind == "VOID" else child.kind).alias(label(field_name)))

        walk("", F.col("element"), node, False)
        if node.element is not None:
            arrays.append(("[]", F.try_variant_get("element", "$", "array<variant>"), node.element))
        if node.kind != "object":
            columns.append(F.coalesce(F.try_variant_get("element", "$", "string"), F.to_json("element")).alias("value"))
        place, n = path, 1
        while place in tables:
            n += 1
            place = f"{path}~{n}"
        tables[place] = level.select(key, "row_id", "parent_id", "position", "ancestors", "element", *more, *columns)
        below = F.array_append("ancestors", F.col("position")) if path else F.col("ancestors")
        held = F.col("element").isNotNull() & ~F.is_variant_null("element")
        for name, value, child in arrays:
            exploded = (
                level.select(key, F.col("row_id").alias("parent_id"), below.alias("ancestors"), F.posexplode(value).alias("position", "element")).where(held)
                .withColumn("row_id", F.concat(F.col("parent_id"), F.lit("" if name == "[]" else f"/{name}"), F.lit("["), F.col("position").cast("string"), F.lit("]")))
            )
            visit(path + name if name == "[]" else f"{path}.{name}".lstrip("."), exploded, child)
        for name, value, child in maps:
            entries = F.posexplode(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))).alias("position", "_entry")
            exploded = (
                level.select(key, F.col("row_id").alias("parent_id"), below.alias("ancestors"), entries)
                .select(key, "parent_id", "ancestors", "position", F.col("_entry.key").alias("entry"), F.col("_entry.value").alias("element")).where(held)
                .withColumn("row_id", F.concat(F.col("parent_id"), F.lit(f"/{name}["), F.col("position").cast("string"), F.lit("]")))
            )
            visit(f"{path}.{name}".lstrip("."), exploded, child, ("entry",))

    visit("", root, schema)
    return tables


def schema_documents(artifacts: DataFrame) -> DataFrame:
    """One row per distinct artifact: its schema document as a variant, or null.

    Redelivered artifacts count once; should payloads of one id differ, the last received
    holds. In a bundle the schema document is ``physical``. Rows without an id are left out.
    """
    last = artifacts.where("artifact_id IS NOT NULL").groupBy("artifact_id").agg(F.max_by("payload", F.struct("received_at", "payload")).alias("payload"))
    whole = last.select("artifact_id", read_json(F.col("payload")).alias("whole"))
    bundled = F.coalesce(F.try_variant_get("whole", "$.bundled", "boolean"), F.lit(False))
    return whole.select("artifact_id", F.when(bundled, F.try_variant_get("whole", "$.physical", "variant")).otherwise(F.col("whole")).alias("document"))


def _objects_only(schema: Node, path: list[str]) -> bool:
    """Whether all elements of the array at a path of arrays are objects."""
    for name in path:
        found = schema.fields.get(name)
        if found is None or found.element is None:
            return False
        schema = found.element
    return schema.kind == "object"


def artifact_tables(artifacts: DataFrame) -> dict[str, DataFrame]:
    """``tables``, ``columns`` and ``relationships`` of all artifacts, with marks and keys.

    Columns: artifact_id, row_id, parent_id, table_pos, node_pos, node_name, sensitive,
    payload fields by merged schema. Unreadable and missing payloads give no rows, nor do elements that are no objects.
    """
    documents = cut_lineage(schema_documents(artifacts))
    schema = infer_schema(documents, "document")
    levels = flatten_documents(documents, "artifact_id", "document", schema)
    empty = levels[""].where("false")
    out = {}
    for kind, path, label in (("table", "tables", "name"), ("column", "tables.columns", "name"), ("relationship", "tables.relationships", "from")):
        level = levels.get(path)
        if level is None:
            level = empty
        if not _objects_only(schema, path.split(".")):
            level = level.where(F.schema_of_variant("element").startswith("OBJECT"))
        if kind != "table":
            level = level.where(F.size("ancestors") == 1)
        element = F.col("element")
        raw = _get(element, label, "variant")
        mark = F.lower(F.try_variant_get("element", "$.sensitive", "string"))
        out[f"{kind}s"] = level.select(
            "artifact_id", "row_id", "parent_id", F.lit(kind).alias("node_kind"),
            (F.col("position") if kind == "table" else F.try_element_at("ancestors", F.lit(1))).cast("int").alias("table_pos"),
            (F.lit(-1) if kind == "table" else F.col("position")).cast("int").alias("node_pos"),
            F.coalesce(F.try_variant_get(raw, "$", "string"), F.when(~F.is_variant_null(raw), F.to_json(raw))).alias("node_name"),
            (F.lit("none") if kind == "relationship" else F.when(mark.isin("true", "false"), mark).otherwise("none")).alias("sensitive"),
            *[F.col(f"`{c.replace('`', '``')}`") for c in level.columns if c.startswith("f_")],
        )
    return out
