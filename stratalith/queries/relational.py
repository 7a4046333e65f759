"""Queries of the delegated relational surface, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.plans.execute import latest_history
from stratalith.plans.tenant import descendants
from stratalith.session import shared_folder
from stratalith.sources.tables import register_views, table
from stratalith.streaming.incremental import append_stream, windowed_events

#: Statements that Spark and DuckDB both run as they stand; each is one operator of the surface.
SHARED = {
    "scan_project": "SELECT o_orderkey, o_totalprice * 2 AS doubled, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders WHERE o_orderstatus = 'O'",
    "join_inner": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
    "join_left": "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey",
    "join_full": "SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k",
    "join_semi": "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "join_anti": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
    "join_right": "SELECT n.n_name, count(s.s_suppkey) AS n_suppliers FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name",
    "join_cross": "SELECT r_name, step FROM region CROSS JOIN (VALUES (1), (2), (3)) v(step)",
    "join_hinted": "SELECT /*+ SHUFFLE_HASH(customer), MERGE(orders) */ c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "join_range": "SELECT r.label, count(*) AS n FROM orders JOIN (VALUES ('low', 0, 100000), ('mid', 100000, 300000), ('high', 300000, 100000000)) r(label, lo, hi) ON o_totalprice >= lo AND o_totalprice < hi GROUP BY r.label",
    "join_multi_key": "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber",
    "join_lateral": "SELECT r_name, n.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) n",
    "agg_basic": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_discount, max(l_tax) AS max_tax, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "agg_percentile": "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS middle, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS high FROM lineitem GROUP BY l_returnflag",
    "agg_approx": "SELECT l_returnflag, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.15 * count(DISTINCT l_partkey) AS near FROM lineitem GROUP BY l_returnflag",
    "agg_moments": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS deviation, round(var_pop(l_discount), 8) AS variance, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem GROUP BY l_returnflag",
    "rollup_sales": "SELECT r_name, n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "cube_flags": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "window_rank": "SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS place FROM customer",
    "window_running": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "window_lag": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events",
    "window_frame": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth FROM events",
    "window_range": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY value RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n_near FROM events",
    "window_values": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_order, lead(o_orderkey, 2) OVER w AS second_next, round(percent_rank() OVER w, 9) AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "window_ntile": "SELECT s_suppkey, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS quarter FROM supplier",
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "topk_per_group": "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) t WHERE n <= 3",
    "setop_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "setop_union_all": "SELECT 'c' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier",
    "setop_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "setop_except": "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "subquery_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "subquery_correlated": "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "cte_chain": "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), b AS (SELECT c_nationkey, o_custkey, total FROM a JOIN customer ON c_custkey = o_custkey), c AS (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY total DESC) AS place FROM b) SELECT c_nationkey, o_custkey, round(total, 2) AS total, place FROM c WHERE place <= 3",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "text_match": "SELECT p_partkey FROM part WHERE p_name ILIKE '%a%' AND p_type LIKE '%S%'",
    "case_pivot": "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS n_open, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_final FROM lineitem GROUP BY l_returnflag",
    "local_supplier_volume": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "shipping_priority": "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10",
}


def _shared(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        session = spark.newSession()
        register_views(session, folder)
        return session.sql(SHARED[name])

    run.__name__ = name
    return run


def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the events' JSON, counted by type."""
    rows = table(spark, folder, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return rows.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type; the batch form of the streaming operator."""
    return windowed_events(table(spark, folder, "events")).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user: a gap of over six hours starts a new one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp")), F.lit(0)) > 6 * 3600 * 10**6
    numbered = table(spark, folder, "events").withColumn("_new", gap.cast("int")).withColumn("session", F.sum("_new").over(order))
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"))


def history_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Newest events as a history page."""
    return latest_history(table(spark, folder, "events").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))).select("id")


def asof_join(spark: SparkSession, folder: str) -> DataFrame:
    """For each purchase the user's last earlier view, by one sort and no range join."""
    rows = table(spark, folder, "events").where("event_type IN ('purchase', 'view')")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(order))
    return seen.where("event_type = 'purchase'").select("event_id", "view_id")


def recursive_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Everything below region 1 in one edge table, by recursion."""
    region_edges = table(spark, folder, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    nation_edges = table(spark, folder, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    start = spark.createDataFrame([("r1",)], "id string")
    return descendants(region_edges.unionAll(nation_edges), start, levels=4)


def scan_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written as CSV, JSON and ORC in the shared folder, read back with a given schema, and summed by format."""
    at = f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}"
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    out = None
    for kind in ("csv", "json", "orc"):
        rows.write.format(kind).option("header", True).save(f"{at}/{kind}")
        back = spark.read.format(kind).schema(rows.schema).option("header", True).load(f"{at}/{kind}").where("c_acctbal > 0")
        one = back.agg(F.lit(kind).alias("format"), F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.max("c_name").alias("last_name"))
        out = one if out is None else out.unionAll(one)
    return out


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Windowed counts of the events as a stream with a watermark, appended to a table as windows close.

    The stream has three batches: the first 15 days without some events, the rest, and those events, now later than the
    watermark, which drops them. Windows still open at the end aren't in the table.
    """
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, folder, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts")).where("ts IS NOT NULL")
    half = F.date_trunc("day", F.lit(events.agg(F.min("ts")).first()[0])) + F.expr("INTERVAL 15 DAYS")
    late = (F.col("ts") < half - F.expr("INTERVAL 2 DAYS")) & (F.dayofmonth("ts") % 5 == 0)
    for part in ((F.col("ts") < half) & ~late, F.col("ts") >= half, late):
        events.where(part).coalesce(1).write.mode("append").parquet(f"{at}/in")
    arrived = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    append_stream(windowed_events(arrived), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema("window_start timestamp, event_type string, n long, total double").parquet(f"{at}/out").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


_OWN = (json_props, event_windows, event_sessions, event_stream, history_latest, asof_join, recursive_descendants, scan_formats)


def queries() -> dict:
    """By name."""
    return {name: _shared(name) for name in SHARED} | {f.__name__: f for f in _OWN}


def oracle_sql() -> dict[str, str]:
    """By name."""
    return SHARED | {
        "json_props": "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2",
        "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "event_sessions": """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events),
            s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n_events FROM s GROUP BY 1, 2""",
        "event_stream": """WITH e AS (SELECT *, (SELECT date_trunc('day', min(ts)) + INTERVAL 15 DAYS FROM events) AS half, (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS seen FROM events)
            SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e
            WHERE NOT (ts < half - INTERVAL 2 DAYS AND day(ts) % 5 = 0) AND date_trunc('day', ts) + INTERVAL 1 DAY <= seen GROUP BY 1, 2""",
        "scan_formats": """SELECT f.format, count(*) AS n, round(sum(c_acctbal), 2) AS total, max(c_name) AS last_name
            FROM customer, (VALUES ('csv'), ('json'), ('orc')) f(format) WHERE c_acctbal > 0 GROUP BY 1""",
        "history_latest": "SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
        "asof_join": """SELECT p.event_id, (SELECT v.event_id FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND (v.ts, v.event_id) < (p.ts, p.event_id) ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS view_id
            FROM events p WHERE p.event_type = 'purchase'""",
        "recursive_descendants": """SELECT 'r1' AS id UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1
            UNION ALL SELECT 'c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1""",
    }
