"""Queries of problems 2, 3 and 5, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions.types import comparable_type, shorten_type_sql
from stratalith.operators.nested import artifact_tables
from stratalith.operators.rejects import parse_records, rejected_rows, valid_rows
from stratalith.operators.snapshots import snapshot_changes
from stratalith.sources.tables import table


def column_changes(spark: SparkSession, folder: str, values: bool = False) -> DataFrame:
    """Changes of every schema's columns between deliveries, types in comparison form."""
    return snapshot_changes(
        table(spark, folder, "column_snapshots"), "schema_id", "id", "snapshot_no", "delivered_at",
        {"type": comparable_type(F.col("type")), "nullable": F.col("nullable")}, values,
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Added, removed and changed columns."""
    return column_changes(spark, folder)


def p2_values(spark: SparkSession, folder: str) -> DataFrame:
    """The same with old and new values."""
    return column_changes(spark, folder, values=True)


_NODES = ("artifact_id", "node_kind", "table_pos", "node_pos", "node_name", "sensitive")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every table, column and relationship of every readable artifact."""
    tables = [t.select(*_NODES) for t in artifact_tables(table(spark, folder, "artifacts")).values()]
    return tables[0].unionAll(tables[1]).unionAll(tables[2])


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """Columns and relationships joined back to their table by the parent key."""
    flat = artifact_tables(table(spark, folder, "artifacts"))
    parent = flat["tables"].select(F.col("row_id").alias("parent_id"), F.col("node_name").alias("table_name"))
    children = flat["columns"].select("parent_id", *_NODES).unionAll(flat["relationships"].select("parent_id", *_NODES))
    return children.join(parent, "parent_id").groupBy("artifact_id", "table_pos", "table_name").agg(
        F.count_if(F.col("node_kind") == "column").alias("n_columns"), F.count_if(F.col("node_kind") == "relationship").alias("n_relationships"),
    )


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return parse_records(table(spark, folder, "catalog_lines"), table(spark, folder, "type_names"), keep=("line_id",))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected records with the reason."""
    return rejected_rows(_records(spark, folder)).select("line_id", "reason")


def p5_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Valid records as typed catalog rows."""
    return valid_rows(_records(spark, folder))


def queries() -> dict:
    """By name."""
    return {f.__name__: f for f in (p2_found, p2_values, p3_found, p3_links, p5_found, p5_rows)}


_TYPE = shorten_type_sql("lower(regexp_replace(type, '^[ \\t]+|[ \\t]+$', '', 'g'))")

_P2 = f"""
WITH placed AS (
  SELECT schema_id, id, snapshot_no, {_TYPE} AS type, nullable,
         row_number() OVER (PARTITION BY schema_id, id, snapshot_no ORDER BY delivered_at DESC NULLS LAST) AS n
  FROM column_snapshots WHERE schema_id IS NOT NULL AND id IS NOT NULL AND snapshot_no IS NOT NULL),
held AS (SELECT schema_id, id, snapshot_no, type, nullable FROM placed WHERE n = 1),
steps AS (
  SELECT schema_id, snapshot_no AS to_snapshot, lag(snapshot_no) OVER (PARTITION BY schema_id ORDER BY snapshot_no) AS from_snapshot
  FROM (SELECT DISTINCT schema_id, snapshot_no FROM column_snapshots WHERE schema_id IS NOT NULL AND id IS NOT NULL AND snapshot_no IS NOT NULL)),
old AS (SELECT s.*, h.id, h.type, h.nullable FROM steps s JOIN held h ON h.schema_id = s.schema_id AND h.snapshot_no = s.from_snapshot),
new AS (SELECT s.*, h.id, h.type, h.nullable FROM steps s JOIN held h ON h.schema_id = s.schema_id AND h.snapshot_no = s.to_snapshot WHERE s.from_snapshot IS NOT NULL),
both_sides AS (
  SELECT coalesce(o.schema_id, n.schema_id) AS schema_id, coalesce(o.id, n.id) AS id, coalesce(o.from_snapshot, n.from_snapshot) AS from_snapshot,
         coalesce(o.to_snapshot, n.to_snapshot) AS to_snapshot,
         CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed'
              WHEN o.type IS DISTINCT FROM n.type OR o.nullable IS DISTINCT FROM n.nullable THEN 'changed' END AS change,
         o.type AS old_type, n.type AS new_type, o.nullable AS old_nullable, n.nullable AS new_nullable
  FROM old o FULL JOIN new n ON o.schema_id = n.schema_id AND o.id = n.id AND o.from_snapshot = n.from_snapshot)
"""

_P3 = """
WITH last AS (
  SELECT artifact_id, payload, row_number() OVER (PARTITION BY artifact_id ORDER BY received_at DESC NULLS LAST) AS n FROM artifacts WHERE artifact_id IS NOT NULL),
readable AS (SELECT artifact_id, payload::JSON AS doc FROM last WHERE n = 1 AND json_valid(payload) AND CASE WHEN json_valid(payload) THEN json_type(payload) END = 'OBJECT'),
docs AS (SELECT artifact_id, CASE WHEN json_extract_string(doc, '$.bundled') = 'true' THEN json_extract(doc, '$.physical') ELSE doc END AS doc FROM readable),
t AS (SELECT artifact_id, unnest(json_extract(doc, '$.tables[*]')) AS el, unnest(range(json_array_length(doc, '$.tables')::BIGINT)) AS pos FROM docs WHERE json_type(doc, '$.tables') = 'ARRAY'),
ts AS (SELECT * FROM t WHERE json_type(el) = 'OBJECT'),
c AS (SELECT artifact_id, pos, unnest(json_extract(el, '$.columns[*]')) AS node, unnest(range(json_array_length(el, '$.columns')::BIGINT)) AS npos FROM ts WHERE json_type(el, '$.columns') = 'ARRAY'),
r AS (SELECT artifact_id, pos, unnest(json_extract(el, '$.relationships[*]')) AS node, unnest(range(json_array_length(el, '$.relationships')::BIGINT)) AS npos FROM ts WHERE json_type(el, '$.relationships') = 'ARRAY'),
nodes AS (
  SELECT artifact_id, 'table' AS node_kind, pos::INT AS table_pos, -1 AS node_pos, json_extract_string(el, '$.name') AS node_name,
         CASE WHEN json_extract_string(el, '$.sensitive') IN ('true', 'false') THEN json_extract_string(el, '$.sensitive') ELSE 'none' END AS sensitive FROM ts
  UNION ALL
  SELECT artifact_id, 'column', pos::INT, npos::INT, json_extract_string(node, '$.name'),
         CASE WHEN json_extract_string(node, '$.sensitive') IN ('true', 'false') THEN json_extract_string(node, '$.sensitive') ELSE 'none' END FROM c WHERE json_type(node) = 'OBJECT'
  UNION ALL
  SELECT artifact_id, 'relationship', pos::INT, npos::INT, json_extract_string(node, '$.from'), 'none' FROM r WHERE json_type(node) = 'OBJECT')
"""

_P5 = r"""
WITH bare AS (
  SELECT line_id, raw, regexp_replace(regexp_replace(raw, '^\x{FEFF}', ''), '[\r\n]+$', '') AS rec FROM catalog_lines),
split AS (
  SELECT line_id, raw, regexp_full_match(rec, '(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*') AS sound,
         list_transform(regexp_extract_all(rec || ',', '("(?:[^"]|"")*"|[^",]*),', 1),
                        lambda f: CASE WHEN f LIKE '"%' THEN replace(f[2:-2], '""', '"') ELSE f END) AS f
  FROM bare),
named AS (
  SELECT *, trim(f[4], chr(32) || chr(9)) AS ordinal,
         trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(f[5], chr(32) || chr(9))), '( *\[\])+$', ''), '\( *[0-9]+ *(, *[0-9]+ *)?\)', '', 'g'), ' +', ' ', 'g'), ' ') AS base
  FROM split),
judged AS (
  SELECT *, CASE
    WHEN raw IS NULL THEN 'column_count'
    WHEN NOT sound THEN 'quoting'
    WHEN len(f) <> 10 THEN 'column_count'
    WHEN trim(f[3], chr(32) || chr(9)) IN ('', '\N') OR regexp_matches(f[3], '[\x00-\x1f\x7f\x{FFFD}]') THEN 'column_name'
    WHEN NOT regexp_full_match(ordinal, '0*[1-9][0-9]{0,9}') OR try_cast(ordinal AS HUGEINT) > 2147483647 THEN 'ordinal_position'
    WHEN base NOT IN (SELECT type_name FROM type_names WHERE type_name IS NOT NULL) THEN 'data_type' END AS reason
  FROM named)
"""


def _text(n: int) -> str:
    return rf"CASE WHEN trim(f[{n}], chr(32) || chr(9)) IN ('', '\N') THEN NULL ELSE f[{n}] END"


def oracle_sql() -> dict[str, str]:
    """By name."""
    return {
        "p2_found": _P2 + "SELECT schema_id, id, from_snapshot, to_snapshot, change FROM both_sides WHERE change IS NOT NULL",
        "p2_values": _P2 + "SELECT * FROM both_sides WHERE change IS NOT NULL",
        "p3_found": _P3 + "SELECT * FROM nodes",
        "p3_links": _P3 + """SELECT n.artifact_id, n.table_pos, t.node_name AS table_name, count(*) FILTER (n.node_kind = 'column') AS n_columns,
            count(*) FILTER (n.node_kind = 'relationship') AS n_relationships
            FROM nodes n JOIN nodes t ON n.artifact_id = t.artifact_id AND n.table_pos = t.table_pos AND t.node_kind = 'table'
            WHERE n.node_kind <> 'table' GROUP BY ALL""",
        "p5_found": _P5 + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
        "p5_rows": _P5 + f"""SELECT line_id, {_text(1)} AS schema_name, {_text(2)} AS table_name, trim(f[3], chr(32) || chr(9)) AS column_name, ordinal::INT AS ordinal_position,
            trim(f[5], chr(32) || chr(9)) AS data_type, {_text(6)} AS udt_schema, {_text(7)} AS udt_name,
            CASE WHEN lower(trim(f[8], chr(32) || chr(9))) IN ('t', 'true', '1') THEN true WHEN lower(trim(f[8], chr(32) || chr(9))) IN ('f', 'false', '0') THEN false END AS is_nullable,
            {_text(9)} AS default_expression, {_text(10)} AS comment FROM judged WHERE reason IS NULL""",
    }
