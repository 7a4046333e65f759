"""The star schema as a described artifact with a tenant policy, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalith.sources.artifact import Artifact, Described, first_paragraph, read_sections
from stratalith.sources.tables import table

_COLUMNS = {
    "region": "r_regionkey integer PK, r_name text",
    "nation": "n_nationkey integer PK, n_name text, n_regionkey integer",
    "customer": "c_custkey bigint PK, c_name text S, c_nationkey integer, c_acctbal double S, c_mktsegment text",
    "supplier": "s_suppkey bigint PK, s_name text, s_nationkey integer, s_acctbal double S",
    "part": "p_partkey bigint PK, p_name text, p_brand text, p_type text, p_size integer, p_retailprice double",
    "orders": "o_orderkey bigint PK, o_custkey bigint, o_orderstatus text, o_totalprice double, o_orderdate timestamp, o_orderpriority text",
    "lineitem": "l_orderkey bigint PK, l_partkey bigint, l_suppkey bigint, l_linenumber integer PK, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag text, l_linestatus text, l_shipdate timestamp",
    "events": "event_id bigint PK, ts timestamp, user_id bigint, event_type text, value double, props jsonb",
}
_LINKS = {
    "nation": [("n_regionkey", "region", "r_regionkey")], "customer": [("c_nationkey", "nation", "n_nationkey")], "supplier": [("s_nationkey", "nation", "n_nationkey")],
    "orders": [("o_custkey", "customer", "c_custkey")], "lineitem": [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")],
}
_TEXTS = {
    "orders": "# Orders\n\nOne row per order that a customer placed.\n\n## Common query language\n\nRevenue means o_totalprice.\n\nOpen orders have status O.\n\n## Example questions\n\n- Which orders are open?\n- How much did each customer order?\n\n## Business context\n\nOrders are never deleted.\n",
    "customer": "# Customers\n\nWho buys.\n\n## Example questions\n\n- Who has the highest c_acctbal?\n- Which segment is largest?\n\n## Business context\n\nSegments are set by sales.\n\n## Column notes\n\n- `c_mktsegment`: one of five\n",
}


def _id(name: str, column: str | None = None) -> str:
    return f"table:public.{name}" + (f"#{column}" if column else "")


def star_artifact() -> Artifact:
    """Schema document and descriptions; events is untracked."""
    tables = []
    for name, text in _COLUMNS.items():
        cols = []
        for part in text.split(", "):
            words = part.split()
            cols.append({"id": _id(name, words[0]), "name": words[0], "type": words[1], "nullable": "PK" not in words, "primaryKey": "PK" in words, "sensitive": "S" in words})
        tables.append({"id": _id(name), "name": name, "schema": "public", "sensitive": name == "supplier", "columns": cols, "relationships": [{"from": _id(name, a), "to": _id(t, b)} for a, t, b in _LINKS.get(name, [])]})
    described = {}
    for name, body in _TEXTS.items():
        front = {"id": _id(name), "aliases": {"orders": ["purchases"], "customer": ["clients", "buyers"]}[name], "primaryEntity": name, "tracked": True, "columns": [{"id": _id("orders", "o_orderstatus"), "description": "State of the order", "enum": ["O", "F", "P"]}] if name == "orders" else []}
        described[_id(name)] = Described(front, body, read_sections(body), first_paragraph(body))
    described[_id("events")] = Described({"id": _id("events"), "tracked": False}, "", {}, "")
    concepts = [
        {"id": "concept:revenue", "label": "Revenue", "synonyms": ["turnover"], "links": [_id("orders", "o_totalprice")], "description": "Sum of order prices."},
        {"id": "concept:balance", "label": "Balance", "synonyms": [], "links": [_id("customer", "c_acctbal")], "description": "What a customer owes."},
    ]
    return Artifact({"version": 2, "schemaId": "star", "provider": "spark", "tables": tables}, described, concepts, star_policy())


def star_policy() -> dict:
    """Region over nation over customer; orders by column, lineitem along orders, events by type, part shared."""
    return {
        "schemaId": "star", "enforcement": "strict",
        "roots": [
            {"id": _id("region"), "tenantIdColumn": _id("region", "r_regionkey"), "label": "Region"},
            {"id": _id("nation"), "tenantIdColumn": _id("nation", "n_nationkey"), "label": "Nation", "parent": {"root": _id("region"), "foreignKey": _id("nation", "n_regionkey")}},
            {"id": _id("customer"), "tenantIdColumn": _id("customer", "c_custkey"), "label": "Customer", "parent": {"root": _id("nation"), "foreignKey": _id("customer", "c_nationkey")}},
        ],
        "scopedTables": [
            {"id": _id("orders"), "scopeThrough": [{"root": _id("customer"), "column": _id("orders", "o_custkey")}]},
            {"id": _id("supplier"), "scopeThrough": [{"root": _id("nation"), "column": _id("supplier", "s_nationkey")}]},
            {"id": _id("lineitem"), "scopeThrough": [{"root": _id("customer"), "join": [{"from": _id("lineitem", "l_orderkey"), "to": _id("orders", "o_orderkey")}, {"from": _id("orders", "o_custkey"), "to": _id("customer", "c_custkey")}]}]},
        ],
        "polymorphicTables": [{"id": _id("events"), "typeColumn": _id("events", "event_type"), "idColumn": _id("events", "user_id"), "mapping": {"purchase": _id("customer"), "click": _id("customer"), "view": _id("nation")}}],
        "globalTables": [_id("part")],
    }


def star_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Frames by table id."""
    return {_id(name): table(spark, folder, name) for name in _COLUMNS}
