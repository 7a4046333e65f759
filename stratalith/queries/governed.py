"""Queries of the governed pipeline and the schema knowledge base, and their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.functions import text as tx
from stratalith.plans import tenant as tenancy
from stratalith.plans.dialects import DIALECTS
from stratalith.plans.execute import Engine
from stratalith.plans.guard import verdict
from stratalith.plans.lexer import placeholders
from stratalith.plans.prompt import ddl_lines, ddl_stats
from stratalith.queries.star import _id, star_artifact, star_policy, star_tables
from stratalith.sources.artifact import frames, merge_marks, warnings
from stratalith.sources.catalog import (
    all_comments, catalog_columns, folded_enums, folded_foreign_keys, folded_indexes, folded_keys, is_system, matches_globs, namespaces, read_catalog, read_frames, selected_tables,
)
from stratalith.sources.tables import STAR_TABLES, table
from stratalith.sources.templates import TEMPLATES


def _engine(spark: SparkSession, folder: str) -> Engine:
    return Engine(spark, star_artifact(), star_tables(spark, folder))


def _ids(root: str, *ids: str) -> dict:
    return {"access": {"kind": "ids", "tenantRoot": _id(root), "ids": list(ids)}}


def _subtree(root: str, *ids: str) -> dict:
    return {"access": {"kind": "subtree", "tenantRoot": _id(root), "rootIds": list(ids), "includeDescendants": True}}


_BY_STATUS = "SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY o_orderstatus"


def tenant_scope_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of three customers."""
    return _engine(spark, folder).run(_BY_STATUS, _ids("customer", "1", "2", "3")).frame


def tenant_scope_subtree(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a region's customers."""
    return _engine(spark, folder).run(_BY_STATUS, _subtree("region", "1")).frame


def tenant_scope_multi_root(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers by nation where the scope names nations and customers."""
    scope = {"access": {"kind": "multi_root", "scopes": [{"tenantRoot": _id("nation"), "ids": ["3", "7"]}, {"tenantRoot": _id("customer"), "ids": ["5"]}]}}
    return _engine(spark, folder).run("SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY s_nationkey", scope).frame


def tenant_scope_join_path(spark: SparkSession, folder: str) -> DataFrame:
    """Line items that hang on a nation's customers by way of orders."""
    sql = "SELECT l_returnflag, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag"
    return _engine(spark, folder).run(sql, _subtree("nation", "4", "9")).frame


def tenant_scope_global(spark: SparkSession, folder: str) -> DataFrame:
    """Everything, for a reason."""
    return _engine(spark, folder).run(_BY_STATUS, {"access": {"kind": "global", "reason": "audit"}}).frame


def tenant_scope_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A subtree with a further filter on one table."""
    scope = _subtree("region", "2") | {"tenantFilters": {_id("orders"): {"conditions": [{"column": _id("orders", "o_orderstatus"), "operator": "NOT IN", "value": ["F"]}]}}}
    return _engine(spark, folder).run(_BY_STATUS, scope).frame


def tenant_placeholder(spark: SparkSession, folder: str) -> DataFrame:
    """Tenant ids bound as arguments."""
    sql = "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (:tenant_customer_ids) GROUP BY o_custkey"
    return _engine(spark, folder).run(sql, _ids("customer", "7", "10", "11")).frame


def tenant_subtree_ids(spark: SparkSession, folder: str) -> DataFrame:
    """All ids below two regions, by root."""
    policy = tenancy.parse_policy(star_policy())
    ids = tenancy.allowed_ids(policy, tenancy.parse_scope(_subtree("region", "0", "3"), policy), star_tables(spark, folder).__getitem__)
    parts = [df.select(F.lit(tenancy.table_name(root)).alias("root"), F.col("id").cast("long").alias("id")) for root, df in ids.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def tenant_self_subtree(spark: SparkSession, folder: str) -> DataFrame:
    """Orders below one customer in a hierarchy that refers to itself: each customer hangs on the one with a third of its number."""
    customers = table(spark, folder, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 3).alias("above"))
    root = {"id": _id("customer"), "tenantIdColumn": _id("customer", "c_custkey"), "label": "Customer", "parent": {"root": _id("customer"), "foreignKey": _id("customer", "above")}}
    scoped = [{"id": _id("orders"), "scopeThrough": [{"root": _id("customer"), "column": _id("orders", "o_custkey")}]}]
    policy = tenancy.parse_policy({"schemaId": "star", "enforcement": "strict", "roots": [root], "scopedTables": scoped})
    read = {_id("customer"): customers, _id("orders"): table(spark, folder, "orders")}.__getitem__
    scope = tenancy.parse_scope(_subtree("customer", "2"), policy)
    rows = tenancy.scoped_table(_id("orders"), policy, scope, tenancy.allowed_ids(policy, scope, read), read)
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"))


def tenant_typed_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Filters on numbers, given as texts and numbers, one of which is none."""
    scope = {"access": {"kind": "global", "reason": "audit"}, "tenantFilters": {_id("orders"): {"conditions": [
        {"column": _id("orders", "o_custkey"), "operator": "IN", "value": ["1", 2, 4.0, "x"]}, {"column": _id("orders", "o_orderkey"), "operator": "NOT IN", "value": ["y", 7]}]}}}
    return _engine(spark, folder).run(_BY_STATUS, scope).frame


def tenant_polymorphic(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the customers and nations that a scope reaches, by their type."""
    policy = tenancy.parse_policy(star_policy())
    read = star_tables(spark, folder).__getitem__
    scope = tenancy.parse_scope(_subtree("region", "1"), policy)
    rows = tenancy.scoped_table(_id("events"), policy, scope, tenancy.allowed_ids(policy, scope, read), read)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total"))


def tenant_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every table of the catalog."""
    catalog = read_frames(spark, {n: table(spark, folder, n) for n in STAR_TABLES})
    tables = catalog["tables"].select(tx.table_id(F.col("schema_name"), F.col("table_name")).alias("table_id"))
    return tenancy.coverage(tables, tenancy.parse_policy(star_policy()))


def policy_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """What a policy names that the schema lacks."""
    raw = star_policy()
    raw["globalTables"] = [_id("part"), _id("currency")]
    raw["scopedTables"].append({"id": _id("invoices"), "scopeThrough": [{"root": _id("planet"), "column": _id("orders", "o_planet")}]})
    physical = star_artifact().physical
    found = tenancy.policy_warnings(tenancy.parse_policy(raw), {t["id"] for t in physical["tables"]}, {c["id"] for t in physical["tables"] for c in t["columns"]})
    return spark.createDataFrame(found, "kind string, id string")


def catalog_column_list(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of the tables themselves, introspected natively."""
    catalog = read_frames(spark, {n: table(spark, folder, n) for n in STAR_TABLES})
    return catalog_columns(catalog, selected_tables(catalog)).select("table_id", "column_id", "ordinal_position")


_FKS = [("berths", "fk_vessel", 2, "hull", "vessels", "hull_no", "c"), ("berths", "fk_vessel", 1, "flag", "vessels", "flag", "c"), ("berths", "fk_quay", 1, "port", "quays", "port", "a"), ("berths", "fk_quay", 2, "quay", "quays", "quay_no", "a")]


def catalog_fk_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Composite keys in declared order, whatever the order of the rows."""
    rows = spark.createDataFrame([("public", t, n, p, c, "public", rt, rc, a, None) for t, n, p, c, rt, rc, a in _FKS], "schema_name string, table_name string, constraint_name string, key_position int, column_name string, referenced_schema_name string, referenced_table_name string, referenced_column_name string, on_delete_code string, on_update_code string")
    folded = folded_foreign_keys(rows)
    return folded.select("constraint_name", F.array_join("columns", ",").alias("columns"), F.array_join("referenced_columns", ",").alias("referenced_columns"), "on_delete", "on_update")


def catalog_key_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Key columns of each table in order of the artifact."""
    cols = frames(spark, star_artifact())["columns"].where("primary_key")
    rows = cols.select(F.lit("public").alias("schema_name"), F.col("table_id").alias("table_name"), F.lit("pk").alias("constraint_name"), F.col("position").alias("key_position"), F.col("name").alias("column_name"))
    return folded_keys(rows).select("table_name", F.array_join("columns", ",").alias("columns"))


def catalog_enum_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Values in declared, not alphabetical, order."""
    values = [("public", "tide", i, v) for i, v in enumerate(("slack", "flood", "crest", "ebb"))]
    rows = spark.createDataFrame(values[::-1], "schema_name string, enum_name string, enum_position int, enum_value string")
    return folded_enums(rows).select("enum_name", F.array_join("values", ",").alias("values"))


def catalog_glob_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of the registry whose last part fits a glob, from the column snapshots' ids."""
    names = table(spark, folder, "column_snapshots").select(F.regexp_extract("id", r"^table:[^.]+\.([^#]+)", 1).alias("table_name")).distinct()
    return names.where(matches_globs(F.col("table_name"), ["recipe_*", "*_item_1?"]))


# What a harbour's catalog answers to the template of each part.
_KEY = ["schema_name", "table_name", "constraint_name", "key_position", "column_name"]
_RECORDED = {
    "schemas": (["schema_name"], [["port"], ["pg_toast"]]),
    "tables": (["schema_name", "table_name", "relkind", "row_level_security", "comment"], [
        ["port", "vessels", "r", True, "Ships"], ["port", "berths", "p", False, None], ["port", "afloat", "v", False, ""], ["pg_toast", "chunk", "r", False, None], ["port", "ids", "S", False, None]]),
    "columns": (["SCHEMA_NAME", "table_name", "column_name", "ordinal_position", "data_type", "udt_schema", "udt_name", "is_nullable", "default_expression", "comment"], [
        ["port", "vessels", "flag", 2, "character(2)", "pg_catalog", "bpchar", False, None, None], ["port", "vessels", "hull_no", 1, "integer", "pg_catalog", "int4", False, None, "Painted on"],
        ["port", "berths", "since", 1, "timestamp with time zone", "pg_catalog", "timestamptz", True, "now()", None], ["pg_toast", "chunk", "x", 1, "bytea", "pg_catalog", "bytea", True, None, None],
        ["port", "afloat", "flag", 1, "character varying(2)", "pg_catalog", "varchar", True, None, None]]),
    "primary_keys": (_KEY, [["port", "vessels", "pk", 2, "hull_no"], ["port", "vessels", "pk", 1, "flag"]]),
    "foreign_keys": ([*_KEY, "referenced_schema_name", "referenced_table_name", "referenced_column_name", "on_delete_code", "on_update_code"], [["port", t, n, i, c, "port", rt, rc, a, None] for t, n, i, c, rt, rc, a in _FKS]),
    "unique_constraints": (_KEY, [["port", "berths", "u", 1, "since"]]),
    "check_constraints": (["schema_name", "table_name", "constraint_name", "expression"], [["port", "vessels", "c", "CHECK (hull_no > 0)"]]),
    "indexes": (["schema_name", "table_name", "index_name", "is_unique", "method", "columns", "expressions"], [["port", "vessels", "i", False, "btree", '{flag,NULL,"a,b"}', "lower(flag)"]]),
    "enums": (["schema_name", "enum_name", "enum_position", "enum_value"], [["port", "tide", 2, "ebb"], ["port", "tide", 1, "flood"]]),
    "sequences": (["schema_name", "sequence_name", "data_type", "start_value", "minimum_value", "maximum_value", "increment", "cycle_option"], [["port", "ids", "bigint", "1", "1", "9", "1", False]]),
    "views": (["schema_name", "view_name", "definition", "is_materialized"], [["port", "afloat", "select 1", False]]),
    "comments": (["object_type", "schema_name", "table_name", "column_name", "comment"], [["schema", "port", None, None, "Harbour"]]),
}


def catalog_recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of a catalog through its template and a runner that answers with recorded rows: one line a fact."""
    asked = {query: part for part, query in TEMPLATES["postgres"].items()}
    catalog = read_catalog(spark, "postgres", lambda query, parameters: _RECORDED[asked[query]])
    columns = catalog_columns(catalog, selected_tables(catalog))
    lines = [
        selected_tables(catalog).select(F.lit("table"), F.concat_ws(" ", "table_name", "relkind")), columns.select(F.lit("column"), F.concat_ws(" ", "column_id", "type", F.when(F.col("primary_key"), "key"))),
        folded_keys(catalog["primary_keys"]).select(F.lit("key"), F.array_join("columns", ",")), folded_keys(catalog["unique_constraints"]).select(F.lit("unique"), F.array_join("columns", ",")),
        folded_foreign_keys(catalog["foreign_keys"]).select(F.lit("foreign"), F.concat_ws(" ", F.array_join("columns", ","), F.array_join("referenced_columns", ","), "on_delete")),
        catalog["check_constraints"].select(F.lit("check"), F.col("expression")), folded_indexes(catalog["indexes"]).select(F.lit("index"), F.array_join("columns", "|", "?")), folded_enums(catalog["enums"]).select(F.lit("enum"), F.array_join("values", ",")),
        catalog["sequences"].select(F.lit("sequence"), F.concat_ws(" ", "sequence_name", "maximum_value")), catalog["views"].select(F.lit("view"), F.col("definition")), all_comments(catalog).select(F.lit("comment"), F.concat_ws(" ", "object_type", "comment")),
        namespaces(catalog).where(~is_system()).select(F.lit("schema"), F.col("schema_name")),
    ]
    return functools.reduce(DataFrame.unionAll, lines).toDF("part", "fact")


def catalog_merge_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Every schema's last delivered snapshot with the marks of the one delivered before, new columns flagged.

    Snapshots of a schema are those it has rows for; a schema with only one has new columns only.
    """
    rows = table(spark, folder, "column_snapshots").where("schema_id IS NOT NULL AND id IS NOT NULL AND snapshot_no IS NOT NULL")
    back = F.row_number().over(Window.partitionBy("schema_id").orderBy(F.desc("snapshot_no")))
    steps = rows.select("schema_id", "snapshot_no").distinct().withColumn("_back", back).where("_back <= 2")
    last = Window.partitionBy("schema_id", "snapshot_no", "id").orderBy(F.desc("delivered_at"), "sensitive")
    rows = rows.join(F.broadcast(steps), ["schema_id", "snapshot_no"]).withColumn("_n", F.row_number().over(last)).where("_n = 1").withColumnRenamed("id", "column_id")
    new, old = (rows.where(F.col("_back") == n).select("schema_id", "column_id", "sensitive") for n in (1, 2))
    return merge_marks(new, old, ["schema_id", "column_id"]).groupBy("is_new").agg(F.count(F.lit(1)).alias("n_columns"), F.count_if("sensitive").alias("n_sensitive"))


def catalog_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """References of chunks that no column or table of their schema's snapshots has."""
    refs = table(spark, folder, "chunk_texts").where("schema_id IS NOT NULL").select("schema_id", F.explode("refs").alias("ref")).where("ref IS NOT NULL").distinct()
    columns = table(spark, folder, "column_snapshots").where("schema_id IS NOT NULL AND id IS NOT NULL").select("schema_id", F.col("id").alias("ref"))
    known = columns.unionAll(columns.select("schema_id", tx.table_of(F.col("ref")).alias("ref"))).distinct()
    return refs.join(known, ["schema_id", "ref"], "left_anti").groupBy("schema_id").agg(F.count(F.lit(1)).alias("n_orphans"))


def registry_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Schemas by provider and tracking, with those that never delivered columns."""
    registry = table(spark, folder, "schema_registry").select("schema_id", "provider", F.coalesce("tracked", F.lit(True)).alias("tracked"))
    seen = table(spark, folder, "column_snapshots").where("schema_id IS NOT NULL").select("schema_id").distinct().withColumn("_seen", F.lit(True))
    return registry.join(seen, "schema_id", "left").groupBy("provider", "tracked").agg(F.count(F.lit(1)).alias("n_schemas"), F.count_if(F.col("_seen").isNull()).alias("n_silent"))


def artifact_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Missing descriptions and dangling ids of the star artifact, by kind."""
    return spark.createDataFrame(warnings(star_artifact()), "kind string, id string").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def prompt_ddl_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Schema text for a prompt, sensitive parts left out."""
    found = frames(spark, star_artifact())
    return ddl_lines(found["tables"], found["columns"], omit=True)


def sensitive_redaction_stats(spark: SparkSession, folder: str) -> DataFrame:
    """What the prompt leaves out."""
    found = frames(spark, star_artifact())
    return ddl_stats(found["tables"], found["columns"], omit=True)


# Statements and what the rules say of them.
_CORPUS = {
    "select 1": None, "": "SQL_EMPTY", "select 1; select 2": "SQL_MULTI_STATEMENT", "select 1 -- x": "SQL_COMMENT", "insert into t values (1)": "SQL_NOT_SELECT_OR_WITH",
    "with a as (select 1) select * from a": None, "select * from t where x = 'drop; --'": None, "select call from t": "SQL_FORBIDDEN_KEYWORD", "select 1;": None,
    "select * from (delete from t)": "SQL_FORBIDDEN_KEYWORD", "explain select 1": "SQL_NOT_SELECT_OR_WITH", "select /* x */ 1": "SQL_COMMENT",
}


def validator_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of the text rules on each statement."""
    return spark.createDataFrame([(s, verdict(s, DIALECTS["spark"]) or "ok") for s in _CORPUS], "statement string, verdict string")


def placeholder_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Placeholders outside quotes, in order."""
    sql = "select :b, ':c', x::date from t where a = :a and b in (:b_list)"
    return spark.createDataFrame([(i, p.name) for i, p in enumerate(placeholders(sql))], "place int, name string")


def param_scalar_bind(spark: SparkSession, folder: str) -> DataFrame:
    """A text and a number bound as arguments."""
    sql = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = :status AND o_totalprice > :least GROUP BY o_orderpriority"
    return _engine(spark, folder).run(sql, {"access": {"kind": "global", "reason": "test"}}, {"status": "O", "least": 100000}).frame


def param_list_bind(spark: SparkSession, folder: str) -> DataFrame:
    """A list spread over markers; quotes in a value do nothing."""
    sql = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN (:wanted) GROUP BY o_orderpriority"
    return _engine(spark, folder).run(sql, {"access": {"kind": "global", "reason": "test"}}, {"wanted": ["1-URGENT", "2-HIGH", "x' OR '1'='1"]}).frame


def sensitive_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk texts that mention a column which their schema's last row for it marks sensitive, by schema."""
    rows = table(spark, folder, "column_snapshots").where("schema_id IS NOT NULL AND id IS NOT NULL")
    last = rows.groupBy("schema_id", "id").agg(F.max_by(F.struct("sensitive", "name"), F.struct("snapshot_no", "delivered_at", "sensitive", "name")).alias("last"))
    names = last.where("last.sensitive AND last.name IS NOT NULL").select("schema_id", F.col("last.name").alias("word")).distinct()
    words = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z0-9_]+"), 0))
    texts = table(spark, folder, "chunk_texts").where("id IS NOT NULL AND schema_id IS NOT NULL AND text IS NOT NULL").select("schema_id", "id", F.explode(words).alias("word"))
    return texts.join(names, ["schema_id", "word"], "left_semi").select("schema_id", "id").distinct().groupBy("schema_id").agg(F.count(F.lit(1)).alias("n_texts"))


_ALL = (
    tenant_scope_ids, tenant_scope_subtree, tenant_scope_multi_root, tenant_scope_join_path, tenant_scope_global, tenant_scope_filter, tenant_typed_filter, tenant_placeholder, tenant_subtree_ids, tenant_self_subtree, tenant_polymorphic, tenant_coverage,
    policy_warnings, catalog_column_list, catalog_recorded, catalog_fk_fold, catalog_key_fold, catalog_enum_fold, catalog_glob_filter, catalog_merge_marks, catalog_orphans, registry_coverage, artifact_warnings, prompt_ddl_lines,
    sensitive_redaction_stats, validator_verdicts, placeholder_scan, param_scalar_bind, param_list_bind, sensitive_refs,
)


def queries() -> dict:
    """By name."""
    return {f.__name__: f for f in _ALL}


def _status(where: str) -> str:
    return f"SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE {where} GROUP BY o_orderstatus"


_IN_REGION = "o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = {})"
_NAMES = ", ".join(f"'{t}'" for t in STAR_TABLES)


def oracle_sql() -> dict[str, str]:
    """By name."""
    verdicts = ", ".join(f"""('{s.replace("'", "''")}', '{v or "ok"}')""" for s, v in _CORPUS.items())
    return {
        "tenant_scope_ids": _status("o_custkey IN (1, 2, 3)"),
        "tenant_scope_subtree": _status(_IN_REGION.format(1)),
        "tenant_scope_multi_root": "SELECT s_nationkey, count(*) AS n_suppliers FROM supplier WHERE s_nationkey IN (3, 7) GROUP BY 1",
        "tenant_scope_join_path": """SELECT l_returnflag, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM lineitem
            WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (4, 9)) GROUP BY 1""",
        "tenant_scope_global": _status("true"),
        "tenant_scope_filter": _status(_IN_REGION.format(2) + " AND o_orderstatus <> 'F'"),
        "tenant_placeholder": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (7, 10, 11) GROUP BY 1",
        "tenant_subtree_ids": """WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 3))
            SELECT 'region' AS root, r_regionkey::BIGINT AS id FROM region WHERE r_regionkey IN (0, 3)
            UNION ALL SELECT 'nation', n_nationkey::BIGINT FROM n UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n)""",
        "tenant_self_subtree": """WITH RECURSIVE below AS (SELECT 2::BIGINT AS id UNION SELECT c.c_custkey FROM customer c JOIN below b ON c.c_custkey // 3 = b.id)
            SELECT o_orderstatus, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers FROM orders WHERE o_custkey IN (SELECT id FROM below) GROUP BY 1""",
        "tenant_typed_filter": _status("o_custkey IN (1, 2, 4) AND o_orderkey <> 7"),
        "tenant_polymorphic": """WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n))
            SELECT event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events
            WHERE (event_type IN ('purchase', 'click') AND user_id IN (SELECT * FROM c)) OR (event_type = 'view' AND user_id IN (SELECT * FROM n)) GROUP BY 1""",
        "tenant_coverage": f"""SELECT 'table:public.' || table_name AS table_id, CASE WHEN table_name IN ('region', 'nation', 'customer') THEN 'root' WHEN table_name IN ('orders', 'supplier') THEN 'scoped'
            WHEN table_name = 'lineitem' THEN 'inherited' WHEN table_name = 'events' THEN 'polymorphic' WHEN table_name = 'part' THEN 'global' ELSE 'unknown' END AS classification
            FROM (SELECT unnest([{_NAMES}]) AS table_name)""",
        "policy_warnings": """SELECT * FROM (VALUES ('orphaned_scoped_table_id', 'table:public.invoices'), ('unknown_root_in_scope', 'table:public.planet'),
            ('orphaned_column_id', 'table:public.orders#o_planet'), ('orphaned_global_table_id', 'table:public.currency')) t(kind, id)""",
        "catalog_column_list": f"""SELECT 'table:public.' || table_name AS table_id, 'table:public.' || table_name || '#' || column_name AS column_id, ordinal_position
            FROM information_schema.columns WHERE table_name IN ({_NAMES})""",
        "catalog_fk_fold": """SELECT * FROM (VALUES ('fk_vessel', 'flag,hull', 'flag,hull_no', 'cascade', NULL), ('fk_quay', 'port,quay', 'port,quay_no', 'no action', NULL))
            t(constraint_name, columns, referenced_columns, on_delete, on_update)""",
        "catalog_recorded": """SELECT * FROM (VALUES ('table', 'vessels r'), ('table', 'berths p'), ('table', 'afloat v'), ('column', 'table:port.vessels#flag char(2) key'), ('column', 'table:port.vessels#hull_no integer key'),
            ('column', 'table:port.berths#since timestamptz'), ('column', 'table:port.afloat#flag varchar(2)'), ('key', 'flag,hull_no'), ('unique', 'since'), ('foreign', 'flag,hull flag,hull_no cascade'),
            ('foreign', 'port,quay port,quay_no no action'), ('check', 'CHECK (hull_no > 0)'), ('index', 'flag|?|a,b'), ('enum', 'flood,ebb'), ('sequence', 'ids 9'), ('view', 'select 1'),
            ('comment', 'relation Ships'), ('comment', 'column Painted on'), ('comment', 'schema Harbour'), ('schema', 'port')) t(part, fact)""",
        "catalog_key_fold": """SELECT * FROM (VALUES ('table:public.region', 'r_regionkey'), ('table:public.nation', 'n_nationkey'), ('table:public.customer', 'c_custkey'), ('table:public.supplier', 's_suppkey'),
            ('table:public.part', 'p_partkey'), ('table:public.orders', 'o_orderkey'), ('table:public.lineitem', 'l_orderkey,l_linenumber'), ('table:public.events', 'event_id')) t(table_name, columns)""",
        "catalog_enum_fold": "SELECT 'tide' AS enum_name, 'slack,flood,crest,ebb' AS values",
        "catalog_glob_filter": r"""SELECT DISTINCT regexp_extract(id, '^table:[^.]+\.([^#]+)', 1) AS table_name FROM column_snapshots
            WHERE table_name LIKE 'recipe\_%' ESCAPE '\' OR table_name LIKE '%\_item\_1_' ESCAPE '\'""",
        "catalog_merge_marks": """WITH last AS (SELECT schema_id, snapshot_no, id, sensitive FROM column_snapshots WHERE schema_id IS NOT NULL AND id IS NOT NULL AND snapshot_no IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY schema_id, snapshot_no, id ORDER BY delivered_at DESC, sensitive NULLS FIRST) = 1),
            placed AS (SELECT *, dense_rank() OVER (PARTITION BY schema_id ORDER BY snapshot_no DESC) AS back FROM last)
            SELECT o.sensitive IS NULL AS is_new, count(*) AS n_columns, count(*) FILTER (coalesce(o.sensitive, c.sensitive, false)) AS n_sensitive
            FROM (FROM placed WHERE back = 1) c LEFT JOIN (FROM placed WHERE back = 2) o ON o.id = c.id AND o.schema_id = c.schema_id GROUP BY 1""",
        "catalog_orphans": """WITH refs AS (SELECT DISTINCT schema_id, ref FROM (SELECT schema_id, unnest(refs) AS ref FROM chunk_texts WHERE schema_id IS NOT NULL) WHERE ref IS NOT NULL),
            known AS (SELECT DISTINCT schema_id, id AS ref FROM column_snapshots UNION SELECT DISTINCT schema_id, split_part(id, '#', 1) FROM column_snapshots)
            SELECT schema_id, count(*) AS n_orphans FROM refs r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.schema_id = r.schema_id AND k.ref = r.ref) GROUP BY 1""",
        "registry_coverage": """SELECT provider, coalesce(tracked, true) AS tracked, count(*) AS n_schemas, count(*) FILTER (schema_id NOT IN (SELECT schema_id FROM column_snapshots WHERE schema_id IS NOT NULL)) AS n_silent
            FROM schema_registry GROUP BY 1, 2""",
        "artifact_warnings": f"""SELECT 'missing_table_description' AS kind, count(*) AS n FROM (SELECT unnest([{_NAMES}]) AS name) WHERE name NOT IN ('documents', 'embeddings', 'orders', 'customer')
            UNION ALL SELECT 'missing_column_description', count(*) FROM information_schema.columns WHERE table_name IN ({_NAMES}) AND table_name NOT IN ('documents', 'embeddings') AND column_name <> 'o_orderstatus'""",
        "prompt_ddl_lines": """WITH t AS (SELECT * FROM (VALUES (0, 'region', ''), (1, 'nation', ''), (2, 'customer', ' -- aliases: clients, buyers'), (3, 'supplier', ''), (4, 'part', ''), (5, 'orders', ' -- aliases: purchases'), (6, 'lineitem', '')) v(p, name, tail)),
            c AS (SELECT table_name, column_name, ordinal_position::INT AS o, CASE data_type WHEN 'VARCHAR' THEN 'text' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(data_type) END AS type,
                    column_name IN ('r_regionkey', 'n_nationkey', 'c_custkey', 'p_partkey', 'o_orderkey', 'l_orderkey', 'l_linenumber') AS pk FROM information_schema.columns)
            SELECT p AS table_position, 0 AS line_no, 'TABLE public.' || name || tail AS line FROM t
            UNION ALL SELECT p, o + 9, '  - ' || column_name || ' ' || type || CASE WHEN pk THEN ' (PK NOT NULL)' ELSE ' (NULL)' END || CASE column_name WHEN 'o_orderstatus' THEN ' -- values: O|F|P; State of the order' ELSE '' END
              FROM t JOIN c ON table_name = name WHERE name <> 'supplier' AND column_name NOT IN ('c_name', 'c_acctbal')
            UNION ALL SELECT * FROM (VALUES (2, 1, '-- Who buys.'), (5, 1, '-- One row per order that a customer placed.'), (3, 2, '  [this table''s columns are not shown: it is sensitive]'), (5, 1000000, '-- common query language --'),
              (5, 1000001, '-- Revenue means o_totalprice.'), (5, 1000002, '-- '), (5, 1000003, '-- Open orders have status O.'))""",
        "sensitive_redaction_stats": "SELECT 6::BIGINT AS redacted_columns, 1::BIGINT AS sensitive_table_stubs, 0::BIGINT AS listed_sensitive_columns, 1::BIGINT AS untracked_tables",
        "validator_verdicts": f"SELECT * FROM (VALUES {verdicts}) t(statement, verdict)",
        "placeholder_scan": "SELECT * FROM (VALUES (0, 'b'), (1, 'a'), (2, 'b_list')) t(place, name)",
        "param_scalar_bind": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 GROUP BY 1",
        "param_list_bind": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1",
        "sensitive_refs": """WITH last AS (SELECT schema_id, name, sensitive FROM column_snapshots WHERE schema_id IS NOT NULL AND id IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY schema_id, id ORDER BY snapshot_no DESC, delivered_at DESC, sensitive DESC NULLS LAST) = 1),
            names AS (SELECT schema_id, list(DISTINCT name) AS names FROM last WHERE sensitive AND name IS NOT NULL GROUP BY 1),
            texts AS (SELECT DISTINCT id, schema_id, text FROM chunk_texts WHERE schema_id IS NOT NULL AND text IS NOT NULL)
            SELECT t.schema_id, count(*) AS n_texts FROM texts t JOIN names n ON n.schema_id = t.schema_id
            WHERE list_has_any(regexp_extract_all(t.text, '[A-Za-z0-9_]+'), n.names) GROUP BY 1""",
    }
