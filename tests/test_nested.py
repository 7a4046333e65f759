"""Problem 3: flat tables of nested documents."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stratalith.operators.nested import artifact_tables, flatten_documents, infer_schema, parse_schema, read_json

T0 = dt.datetime(2024, 1, 1)


def nodes(spark, payloads, extra=()):
    rows = [(i, p, T0) for i, p in enumerate(payloads)] + list(extra)
    flat = artifact_tables(spark.createDataFrame(rows, "artifact_id long, payload string, received_at timestamp"))
    picked = [t.select("artifact_id", "node_kind", "table_pos", "node_pos", "node_name", "sensitive") for t in flat.values()]
    return sorted([tuple(r) for p in picked for r in p.collect()], key=str), flat


def test_layouts_marks_nulls_and_positions(spark):
    table = {"name": "t", "sensitive": True, "columns": [None, {"name": "a", "sensitive": None}, {"name": "b", "sensitive": False}], "relationships": [{"from": "x", "to": "y"}, None]}
    found, flat = nodes(spark, [json.dumps({"version": 2, "tables": [None, table]}), json.dumps({"bundled": True, "physical": {"tables": [table]}, "tables": {"t.md": "x"}}), json.dumps({"tables": [{"name": "v"}]})])
    assert (0, "table", 1, -1, "t", "true") in found and (0, "column", 1, 1, "a", "none") in found and (0, "column", 1, 2, "b", "false") in found
    assert (0, "relationship", 1, 0, "x", "none") in found and (1, "table", 0, -1, "t", "true") in found and (2, "table", 0, -1, "v", "none") in found
    assert len(found) == 9
    parents = {r["row_id"] for r in flat["tables"].collect()}
    assert {r["parent_id"] for r in flat["columns"].collect()} <= parents


@pytest.mark.parametrize("bad", [None, "", " ", "null", "[]", "3", '"x"', '{"tables": [', '{"tables": []} x', '{"tables": []}{}', "{'tables': []}", '{"tables": "x"}', '{"tables": null}', "{}"])
def test_unreadable_payloads_give_no_rows(spark, bad):
    assert nodes(spark, [bad])[0] == []


def test_redelivered_artifact_counts_once(spark):
    good = json.dumps({"tables": [{"name": "t"}]})
    assert len(nodes(spark, [good], [(0, good, T0 + dt.timedelta(1)), (None, good, T0)])[0]) == 1


def test_conflicting_and_unusual_fields(spark):
    found, flat = nodes(spark, [json.dumps({"tables": [{"name": 'a "b" \'c\'', "columns": [{"name": "x", "od`d.n": 1, "Name": "y"}]}]}), json.dumps({"tables": [{"name": "t", "columns": {"not": "a list"}, "sensitive": "yes"}]})])
    assert [f[4] for f in found if f[1] == "table"] == ['a "b" \'c\'', "t"] and [f[5] for f in found if f[1] == "table"] == ["none", "none"]
    assert len({c.lower() for c in flat["columns"].columns}) == len(flat["columns"].columns)


def test_generic_tables(spark):
    rows = [(1, json.dumps({"a": [{"b": [1, 2], "c": {"d": "x"}}, {"b": []}], "m": 1})), (2, json.dumps({"a": None, "m": "two"}))]
    docs = spark.createDataFrame(rows, "id long, p string").select("id", read_json(F.col("p")).alias("v"))
    flat = flatten_documents(docs, "id", "v")
    assert set(flat) >= {"", "a", "a.b"}
    assert [(r["position"], r["ancestors"], r["value"]) for r in flat["a.b"].orderBy("position").collect()] == [(0, [0], "1"), (1, [0], "2")]
    assert {r["f_m"] for r in flat[""].collect()} == {"1", "two"} and flat["a"].where("`f_c.d` = 'x'").count() == 1


def test_empty_table_and_schema_text(spark):
    assert nodes(spark, [])[0] == []
    empty = spark.createDataFrame([], "id long, p string").select("id", read_json(F.col("p")).alias("v"))
    assert infer_schema(empty, "v").kind in ("object", "VOID")
    tree = parse_schema("OBJECT<`a``b`: ARRAY<OBJECT<c: DECIMAL(3,1)>>, d: VARIANT>")
    assert tree.fields["a`b"].element.fields["c"].kind == "DECIMAL(3,1)" and tree.fields["d"].kind == "VARIANT"


@pytest.mark.parametrize("odd", ['{"tables": "x"}', '{"tables": {}}', '{"tables": ["x"]}', '{"tables": {"columns": [{"name": "no"}]}}', '{"tables": [{"name": 7, "columns": "x", "relationships": [3]}]}', '{"bundled": true, "physical": "x"}', '{"bundled": true, "physical": [1]}'])
def test_a_deviating_document_hides_nothing_of_the_others(spark, odd):
    good = json.dumps({"tables": [{"name": "t", "columns": [{"name": "a", "sensitive": True}], "relationships": [{"from": "x", "to": "y"}]}]})
    found = [f for f in nodes(spark, [good, odd, good])[0] if f[0] != 1]
    assert found == sorted([(i, *r) for i in (0, 2) for r in (("table", 0, -1, "t", "none"), ("column", 0, 0, "a", "true"), ("relationship", 0, 0, "x", "none"))], key=str)


def test_all_deviations_together_and_inside_one_array(spark):
    mixed = json.dumps({"tables": ["x", {"name": "t", "columns": ["y", {"name": "a"}, 3]}, 4]})
    found = nodes(spark, ['{"tables": "x"}', '{"tables": {}}', '{"tables": ["x"]}', mixed])[0]
    assert [f for f in found if f[0] == 3 and f[4]] == [(3, "column", 1, 1, "a", "none"), (3, "table", 1, -1, "t", "none")]


def test_arrays_inside_wide_objects_and_conflicting_paths(spark):
    wide = {f"k{i}": i for i in range(250)} | {"list": [{"b": [1, 2]}]}
    rows = [(1, json.dumps({"m": wide, "a": {"b": [{"c": 5}]}})), (2, json.dumps({"a": [{"b": [{"d": 6}]}]}))]
    flat = flatten_documents(spark.createDataFrame(rows, "id long, p string").select("id", read_json(F.col("p")).alias("v")), "id", "v")
    assert [r["value"] for r in flat["m.list.b"].orderBy("position").collect()] == ["1", "2"] and "f_m" in flat[""].columns and "f_m.k1" not in flat[""].columns
    assert [(r["id"], r["f_d"]) for r in flat["a.b"].collect()] == [(2, 6)] and [(r["id"], r["f_c"]) for r in flat["a.b~2"].collect()] == [(1, 5)]


def flat_of(spark, *documents, **more):
    rows = list(enumerate(map(json.dumps, documents)))
    return flatten_documents(spark.createDataFrame(rows, "id long, p string").select("id", read_json(F.col("p")).alias("v")), "id", "v", **more)


def test_scalar_elements_give_no_rows(spark):
    assert nodes(spark, [json.dumps({"tables": ["x", 1, [2], {"name": "t", "columns": ["y", None, {"name": "a"}]}]})])[0] == [(0, "column", 3, 2, "a", "none"), (0, "table", 3, -1, "t", "none")]


def test_arrays_in_arrays(spark):
    flat = flat_of(spark, {"m": [[1, 2], [3], None, []]}, {"m": [[[4]]]}, {"m": "x"})
    assert sorted((r["id"], r["ancestors"], r["position"], r["value"], r["row_id"]) for r in flat["m[]"].collect()) == [
        (0, [0], 0, "1", "0/m[0][0]"), (0, [0], 1, "2", "0/m[0][1]"), (0, [1], 0, "3", "0/m[1][0]"), (1, [0], 0, "[4]", "1/m[0][0]")]
    assert [(r["id"], r["ancestors"], r["value"]) for r in flat["m[][]"].collect()] == [(1, [0, 0], "4")]


def test_any_field_name(spark):
    names = ["a\\b", "", "it's", 'say "x"', "'\"", "a.b", "a?b", "[0]", "$"]
    row = flat_of(spark, dict(zip(names, range(len(names)))))[""].first()
    assert [row[f"f_{n}"] for n in names] == list(range(len(names)))


def test_maps_in_disguise(spark):
    few = {f"k{i}": [i] for i in range(5)}
    flat = flat_of(spark, {"m": few, "n": {"a": 1, "b": 2, "c": None, "d": {"e": [7]}, "f": 1}}, {"o": 1}, max_fields=4)
    assert sorted((r["entry"], r["value"]) for r in flat["m.*"].collect()) == [(k, f"[{v[0]}]") for k, v in few.items()]
    assert sorted((r["parent_id"], r["ancestors"], r["value"]) for r in flat["m.*[]"].collect()) == sorted((f"0/m.*[{i}]", [i], f"{i}") for i in range(5))
    assert {r["parent_id"] for r in flat["m.*[]"].collect()} == {r["row_id"] for r in flat["m.*"].collect()}
    assert sorted(r["entry"] for r in flat["n.*"].collect()) == ["a", "b", "d", "f"] and [r["value"] for r in flat["n.d.e"].collect()] == ["7"]
    many = flat_of(spark, {f"k{i}": {"list": [i]} for i in range(201)})
    assert many["*"].count() == 201 and many["*.list"].count() == 201 and len(many) == 3
