"""Statement checks, parameters, tenancy and the pipeline."""

import io
import json

import pytest

from conftest import SMALL
from stratalith.errors import ConfigError, EngineError, GuardError, ParameterError, SchemaError, ScopeError, StatementError
from stratalith.plans import tenant as tenancy
from stratalith.plans.config import load_settings, required
from stratalith.plans.dialects import DIALECTS, dialect
from stratalith.plans.enrich import broken_links, neighbours, parse_candidates, suggest, suggest_policy
from stratalith.plans.execute import Engine, drop_history, envelope, latest_history, record_history, total_usage
from stratalith.plans.guard import explain, inspect, validate, verdict
from stratalith.plans.lexer import code_only, placeholders, same_statement, spans
from stratalith.plans.logs import EventLog
from stratalith.plans.parameters import Parameter, Prepared, bind, cross_check, literal, parse_manifest, statement_of
from stratalith.plans.prompt import ambiguity_notes
from stratalith.queries.star import _id, star_artifact, star_policy, star_tables

POSTGRES, SPARK, SQLSERVER = DIALECTS["postgres"], DIALECTS["spark"], DIALECTS["sqlserver"]


@pytest.mark.parametrize("sql", ["a 'b''c' \"d\"\"e\" `f` [g] $x$ h $x$ i", "'open", "$$;$$", "a::b"])
def test_spans_cover_the_text(sql):
    found = spans(sql)
    assert "".join(sql[s.start : s.end] for s in found) == sql and len(code_only(sql)) == len(sql)


def test_placeholders_outside_quotes_and_casts():
    assert [p.name for p in placeholders("select :a, ':b', x::date, \":c\", $$ :d $$ from t where y in (:e_1)")] == ["a", "e_1"]
    assert [p.name for p in placeholders(r"select 'it\'s :no' , :yes", backslash=True)] == ["yes"]
    assert same_statement(" SELECT  1 ;", "select 1") and not same_statement("select 1", "select 2")


REJECTED = {
    "": "SQL_EMPTY", "  ": "SQL_EMPTY", "select 1; drop table t": "SQL_MULTI_STATEMENT", "select 1 -- c": "SQL_COMMENT", "select /* c */ 1": "SQL_COMMENT", "values (1)": "SQL_NOT_SELECT_OR_WITH",
    "explain select 1": "SQL_NOT_SELECT_OR_WITH", "select update from t": "SQL_FORBIDDEN_KEYWORD", "with a as (select 1) insert into t select * from a": "SQL_FORBIDDEN_KEYWORD",
}


@pytest.mark.parametrize("sql", REJECTED)
def test_rejected(sql):
    assert verdict(sql) == REJECTED[sql]
    with pytest.raises(StatementError) as error:
        validate(sql)
    assert error.value.code == REJECTED[sql]


@pytest.mark.parametrize("sql", ["select 1", "SELECT 1;", "with a as (select 1) select * from a", "select 'insert; -- x'", "select `drop` from t", "(select 1)"])
def test_accepted(sql):
    assert verdict(sql) is None and explain(validate(sql)).kind in ("select", "with")


def test_dialects():
    assert verdict("select pragma from t", DIALECTS["sqlite"]) == "SQL_FORBIDDEN_KEYWORD" and verdict("select pragma from t", POSTGRES) is None
    assert [POSTGRES.mark(0), SQLSERVER.mark(0), SPARK.mark(3)] == ["$1", "@p0", "?"]
    with pytest.raises(ConfigError):
        dialect("oracle")


@pytest.mark.parametrize(
    "sql",
    ["select * from identifier('t')", "select transform(a) using 'cat' as (b) from t", "with t as (select 1 a) insert into x select * from t", "drop table t", "select * from t; select 1", "select java_method('java.lang.System', 'exit')", "cache table t", "set a = 1", "select system.reflect('a', 'b')", "select * from read_files('x')"],
)
def test_plans_refused(spark, sql):
    with pytest.raises(StatementError):
        inspect(spark, sql)


def test_plan_relations_see_through_nesting(spark):
    sql = "with a as (select * from t1) select (select max(x) from t2) from a where exists (select 1 from t3) and y in (select y from t4) order by (select 1 from t5)"
    assert set(inspect(spark, sql).relations) == {"t1", "t2", "t3", "t4", "t5"}


def reply(*parameters):
    return f"```json\n{json.dumps({'parameters': list(parameters)})}\n```"


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("no block", "MISSING"), ("```json\n{\n```", "MALFORMED"), (reply(), "EMPTY"), (reply({"name": "A", "type": "string", "value": "x"}), "INVALID_NAME"),
        (reply({"name": "tenant_x", "type": "string", "value": "x"}), "RESERVED_NAME"), (reply({"name": "a", "type": "number", "value": True}), "INVALID_VALUE"),
        (reply({"name": "a", "type": "date", "value": "2024-1-1"}), "INVALID_VALUE"), (reply({"name": "a", "type": "string", "cardinality": "many", "value": []}), "INVALID_VALUE"),
        (reply({"name": "a", "type": "blob", "value": "x"}), "MALFORMED"),
    ],
)
def test_manifest_errors(text, code):
    with pytest.raises(ParameterError) as error:
        parse_manifest(text)
    assert error.value.code == code


def test_statement_of_a_reply():
    assert statement_of("```sql-unbound\nx\n```\n```SQL select 1 ```") == "select 1" and statement_of("a ```\nselect 2\n``` b") == "select 2"
    assert statement_of(" select 3 ") == "select 3" and statement_of("```json\n{}\n```") is None and statement_of("") is None


def test_binding():
    prepared = Prepared("postgres", "select * from t where a = :a and b in (:b) and c not in (:b) and d = ':a'", (Parameter("a", "string"), Parameter("b", "number", True)))
    bound = bind(prepared, {"a": "o'x\\", "b": [1, 2.5]}, POSTGRES)
    assert bound.literal == "select * from t where a = 'o''x\\' and b IN (1, 2.5) and c NOT IN (1, 2.5) and d = ':a'"
    assert bound.marked == "select * from t where a = $1 and b = ANY($2) and c <> ALL($3) and d = ':a'" and bound.values[1] == [1, 2.5]
    wide = bind(prepared, {"a": "x", "b": [1, 2]}, SQLSERVER)
    assert "IN (@p1, @p2)" in wide.marked and wide.values == ("x", 1, 2, 1, 2)
    assert "values" not in prepared.to_json()


def test_binding_errors():
    many = (Parameter("b", "number", True),)
    for sql, code in (("select :b", "INVALID_LIST_CONTEXT"), ("select 1", "UNRESOLVED_PLACEHOLDER"), ("select 1 where x in (:b) and y = :c", "UNRESOLVED_PLACEHOLDER"), ("select 1 where x in (:b, 2)", "INVALID_LIST_CONTEXT")):
        with pytest.raises(ParameterError) as error:
            cross_check(sql, many, SPARK)
        assert error.value.code == code
    with pytest.raises(ParameterError) as error:
        literal("a\x00b", SPARK)
    assert "a\x00b" not in str(error.value)
    assert literal("a'b\\", SPARK) == "'a\\'b\\\\'" and literal(True, POSTGRES) == "TRUE"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, star_artifact(), star_tables(spark, SMALL))


def ids(root, *values):
    return {"access": {"kind": "ids", "tenantRoot": _id(root), "ids": list(values)}}


@pytest.mark.parametrize(
    ("scope", "code"),
    [
        (None, "MISSING_SCOPE"), ({}, "INVALID_SCOPE_SHAPE"), (ids("customer"), "INVALID_SCOPE_SHAPE"), (ids("planet", "1"), "UNKNOWN_TENANT_ROOT"), ({"access": {"kind": "global"}}, "GLOBAL_WITHOUT_REASON"),
        ({"access": {"kind": "ids", "tenantRoot": _id("customer"), "ids": [1]}}, "INVALID_SCOPE_SHAPE"), ({"access": {"kind": "no"}}, "INVALID_SCOPE_SHAPE"),
        (ids("customer", "1") | {"tenantFilters": {"t": {"conditions": [{"column": "a", "operator": "<", "value": "1"}]}}}, "INVALID_SCOPE_SHAPE"),
    ],
)
def test_scopes_fail_closed(engine, scope, code):
    with pytest.raises(ScopeError) as error:
        engine.run("select 1 from orders", scope)
    assert error.value.code == code


def test_no_way_around_the_scope(engine, spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("secret")
    spark.createDataFrame([(1,)], "a int").createOrReplaceGlobalTempView("shared_secret")
    scope = ids("customer", "1", "x' OR 1=1")
    mine = engine.run("select count(*) from orders where o_custkey = 1 or 1 = 1", scope).frame.first()[0]
    assert mine == engine.tables[_id("orders")].where("o_custkey = 1").count()
    for sql in (f"select * from parquet.`{SMALL}/orders.parquet`", "select * from secret", "select * from global_temp.shared_secret", "select * from spark_catalog.default.orders", "select 1 from orders where exists (select 1 from secret)"):
        with pytest.raises(EngineError):
            engine.run(sql, scope)
    strict = ids("customer", "1")
    with pytest.raises(GuardError):
        engine.run("select * from supplier", strict)
    assert engine.run("select count(*) from customer", strict).frame.first()[0] == 1
    assert engine.run("select count(*) from nation", strict).frame.first()[0] == 0
    with pytest.raises(ScopeError):
        engine.run("select * from orders where o_custkey in (:tenant_nation_ids)", strict)


def test_several_paths_are_alternatives(spark):
    raw = star_policy()
    raw["scopedTables"][1]["scopeThrough"].append({"root": _id("customer"), "column": _id("supplier", "s_suppkey")})
    policy = tenancy.parse_policy(raw)
    scope = tenancy.parse_scope({"access": {"kind": "multi_root", "scopes": [{"tenantRoot": _id("nation"), "ids": ["3"]}, {"tenantRoot": _id("customer"), "ids": ["1", "2"]}]}}, policy)
    read = star_tables(spark, SMALL).__getitem__
    rows = tenancy.scoped_table(_id("supplier"), policy, scope, tenancy.allowed_ids(policy, scope, read), read)
    assert rows.count() == read(_id("supplier")).where("s_nationkey = 3 or s_suppkey in (1, 2)").count()


def test_policy_shape_and_cycles():
    for change in ({"enforcement": "maybe"}, {"roots": []}, {"surprise": 1}, {"scopedTables": [{"id": "x", "scopeThrough": []}]}):
        with pytest.raises(SchemaError):
            tenancy.parse_policy(star_policy() | change)
    looped = star_policy() | {"hierarchy": [{"parent": _id("customer"), "child": _id("region"), "foreignKey": "x"}]}
    assert set(tenancy.cycle(tenancy.parse_policy(looped))) == {_id("region"), _id("nation"), _id("customer")}
    assert tenancy.cycle(tenancy.parse_policy(star_policy())) == []
    assert tenancy.placeholder_name("Sub-Agency") == "tenant_sub_agency_ids"


def test_descendants_end_on_loops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    assert {r[0] for r in tenancy.descendants(edges, spark.createDataFrame([("a",)], "id string"), 5).collect()} == {"a", "b", "c"}


def test_ask_runs_and_checks(engine):
    scope = {"access": {"kind": "subtree", "tenantRoot": _id("region"), "rootIds": ["1"], "includeDescendants": True}}
    good = "```sql\nselect count(*) as n from orders where o_orderstatus = 'O'\n```\n```sql-unbound\nselect count(*) as n from orders where o_orderstatus = :st\n```\n" + reply({"name": "st", "type": "string", "cardinality": "one", "value": "O"})
    seen = []
    log = io.StringIO()
    engine.model, engine.log = lambda system, prompt: seen.append(prompt) or good, EventLog(log, correlation="c")
    answer = engine.ask("How many open orders?", scope)
    assert answer.named_sql and answer.parameters[0].value == "O" and envelope(answer.frame)["rows"][0][0] > 0
    assert "c_acctbal" not in seen[0] and "TABLE public.orders" in seen[0] and "orders" not in log.getvalue()
    engine.model = lambda system, prompt: good.replace("= :st", "<> :st")
    assert engine.ask("x", scope).prepared is None
    for text in ("nothing", "```json\n{}\n```", "```sql\ndelete from orders\n```"):
        engine.model = lambda system, prompt, text=text: text
        with pytest.raises(EngineError):
            engine.ask("x", scope)
    with pytest.raises(EngineError):
        engine.ask("x", scope, generator=lambda q, d: "drop table orders")
    with pytest.raises(ScopeError):
        engine.ask("x")
    engine.log = None


def test_envelope_and_history(engine, spark, tmp_path):
    frame = engine.run("select l_orderkey from lineitem", {"access": {"kind": "global", "reason": "test"}}).frame
    out = envelope(frame)
    assert out["row_count"] == 500 and out["truncated"] and envelope(frame.limit(3))["truncated"] is False
    assert envelope(spark.range(1).selectExpr("assert_true(id > 5)"))["ok"] is False
    for i in range(3):
        record_history(spark, str(tmp_path / "h"), {"id": i, "at": i, "question": "q"})
    assert [r["id"] for r in latest_history(spark.read.parquet(str(tmp_path / "h")), 2).collect()] == ["2", "1"]


def test_retrieval_gate(spark):
    from stratalith.operators.chunks import build_chunks
    from stratalith.operators.index import SCHEMA, hashed_embedder, reindex, retriever

    plain = Engine(spark, star_artifact(), star_tables(spark, SMALL))
    found = plain.frames
    chunks = build_chunks(found["tables"], found["columns"], found["relationships"])
    find = retriever(reindex(chunks, spark.createDataFrame([], SCHEMA), hashed_embedder(), "h").cache())
    gated = Engine(spark, star_artifact(), star_tables(spark, SMALL), retriever=lambda q: find(q, 3), chunk_count=99)
    text = gated.schema_text("Which orders are open?")
    assert "TABLE public.orders" in text and "TABLE public.part" not in text and "o_orderpriority" in text and "example question" in text
    gated.chunk_count = 30
    assert gated.schema_text("Which orders are open?") == plain.schema_text("x")
    gated.chunk_count, gated.retriever = 99, lambda q: find(q, 3).where("false")
    assert gated.schema_text("x") == plain.schema_text("x")


def test_usage_and_history_deletion(spark):
    assert total_usage([{"prompt": 3, "completion": 4}, {"embedding": 5}, {}]) == {"total": 12, "prompt": 3, "completion": 4, "embedding": 5}
    assert total_usage([])["total"] is None
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    assert drop_history(rows, ["a"]).first()["id"] == "b" and drop_history(rows, []).count() == 2


def test_notes_suggestions_settings(spark, tmp_path):
    assert ambiguity_notes("join users and items", ["users"]) and ambiguity_notes("count from invoices", ["users", "items"]) and not ambiguity_notes("count from users", ["users", "items"])
    assert parse_candidates("a\n---\n\n----\nb\n---\nc\n---\nd") == ["a", "b", "c"] and suggest(lambda s, p: "one", "concept", "x", "") == ["one"]
    with pytest.raises(SchemaError):
        suggest_policy(lambda s, p: "text", "")
    links = spark.createDataFrame([("table:a.x#1", "table:a.y#1"), ("table:a.z#1", "table:a.x#1")], "from_id string, to_id string")
    assert [r[0] for r in neighbours(links, "table:a.x").collect()] == ["table:a.y", "table:a.z"]
    concepts = spark.createDataFrame([("c", ["a", "b"])], "id string, links array<string>")
    assert [tuple(r) for r in broken_links(concepts, spark.createDataFrame([("a",)], "id string")).collect()] == [("c", "b")]
    (tmp_path / "stratalith.yaml").write_text("dialect: mysql\nretrieval_k: 5\n")
    found = load_settings(str(tmp_path), {"STRATALITH_RETRIEVAL_K": "7", "STRATALITH_DIALECT": " "}, row_cap=9)
    assert (found.dialect, found.retrieval_k, found.row_cap) == ("mysql", 7, 9)
    with pytest.raises(ConfigError):
        load_settings(str(tmp_path), {"STRATALITH_ROW_CAP": "-1"})
    with pytest.raises(ConfigError):
        required("X", {"X": " "})


def test_subtree_of_a_root_that_refers_to_itself(spark):
    org, docs, team = _id("org"), _id("docs"), _id("team")
    rows = [(0, None), (1, 0), (2, 1), (3, 2), (9, 9), (10, 9), (11, None), *[(i, i - 1) for i in range(101, 180)], (100, 3)]
    tables = {
        org: spark.createDataFrame(rows, "id int, parent_id long"), team: spark.createDataFrame([(7, 3), (8, 11)], "id int, org_id int"),
        docs: spark.createDataFrame([(i, o) for i, (o, _) in enumerate(rows)], "id int, org_id int"),
    }
    policy = tenancy.parse_policy({
        "schemaId": "s", "enforcement": "strict", "scopedTables": [{"id": docs, "scopeThrough": [{"root": org, "column": f"{docs}#org_id"}]}],
        "roots": [{"id": team, "tenantIdColumn": f"{team}#id", "label": "Team", "parent": {"root": org, "foreignKey": f"{team}#org_id"}}, {"id": org, "tenantIdColumn": f"{org}#id", "label": "Org", "parent": {"root": org, "foreignKey": f"{org}#parent_id"}}],
    })
    below = {1, 2, 3, *range(100, 180)}
    for listed, orgs, teams in (("1", below, {7}), ("9", {9, 10}, set()), ("0", {0, *below}, {7})):
        scope = tenancy.parse_scope({"access": {"kind": "subtree", "tenantRoot": org, "rootIds": [listed]}}, policy)
        found = tenancy.allowed_ids(policy, scope, tables.__getitem__)
        assert sorted(r[0] for r in found[org].collect()) == sorted(orgs) and {r[0] for r in found[team].collect()} == teams
        assert {r["org_id"] for r in tenancy.scoped_table(docs, policy, scope, found, tables.__getitem__).collect()} == orgs
    scope = tenancy.parse_scope({"access": {"kind": "ids", "tenantRoot": org, "ids": ["1"]}}, policy)
    assert [r[0] for r in tenancy.allowed_ids(policy, scope, tables.__getitem__)[org].collect()] == [1]


def test_subtree_of_roots_in_a_loop(spark):
    a, b = _id("a"), _id("b")
    tables = {a: spark.createDataFrame([(1, None), (2, "x"), (3, "z")], "id long, up string"), b: spark.createDataFrame([("x", 1), ("y", 2), ("z", 9)], "id string, up int")}
    policy = tenancy.parse_policy({"schemaId": "s", "enforcement": "warn", "roots": [{"id": i, "tenantIdColumn": f"{i}#id", "label": i[-1], "parent": {"root": o, "foreignKey": f"{i}#up"}} for i, o in ((a, b), (b, a))]})
    found = tenancy.allowed_ids(policy, tenancy.parse_scope({"access": {"kind": "subtree", "tenantRoot": a, "rootIds": ["1"]}}, policy), tables.__getitem__)
    assert sorted(r[0] for r in found[a].collect()) == [1, 2] and sorted(r[0] for r in found[b].collect()) == ["x", "y"]


def test_descendants_have_no_last_level(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(90)], "parent int, child int")
    start = spark.createDataFrame([(0,)], "id int")
    assert tenancy.descendants(edges, start).count() == 91
    with pytest.raises(ScopeError):
        tenancy.descendants(edges, start, 5)


def test_sensitive_columns_of_a_statement(spark):
    from stratalith.plans.guard import inspect, sensitive_reads

    tables = star_artifact().physical["tables"]
    reads = lambda sql: [i.split("#")[1] for i in sensitive_reads(inspect(spark, sql), tables)]
    assert reads("select c_custkey, 'c_name' from customer") == [] and reads("select C_NAME from customer") == ["c_name"]
    assert reads("select * from customer") == ["c_name", "c_acctbal"] and reads("select count(*) from customer") == []
    assert reads("with x as (select c_acctbal as b from customer) select b from x") == ["c_acctbal"] and reads("select o_orderkey from orders where exists (select 1 from customer c where c.c_name = 'x')") == ["c_name"]
    assert reads("select s_suppkey from supplier") == ["s_suppkey"] and reads("select part.p_name, c_custkey from part, customer") == [] and reads("select 1 from customer a join customer b using (c_name)") == ["c_name"]
