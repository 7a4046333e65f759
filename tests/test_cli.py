"""Command line."""

import json
import sqlite3

from conftest import SMALL
from stratalith.__main__ import main
from stratalith.operators.index import VectorStore
from stratalith.queries.star import star_artifact
from stratalith.sources.artifact import to_json


def test_introspect_bundle_index_run(spark, tmp_path, capsys):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("create table t(id integer primary key, name text)")
    address, out = str(tmp_path / "a.db"), str(tmp_path / "out")
    assert main(["introspect", "sqlite", address, "--schema-id", "x", "--out", out]) == 0
    assert main(["introspect", "sqlite", address, "--schema-id", "x", "--diff", f"{out}/schema.json"]) == 0 and json.loads(capsys.readouterr().out) == {"changed": False}
    assert main(["bundle", out]) == 0 and json.loads(capsys.readouterr().out)["bundled"] is True
    assert main(["warnings", out]) == 0 and "missing_table_description" in capsys.readouterr().out
    assert main(["index", out, str(tmp_path / "i")]) == 0 and main(["query", out, str(tmp_path / "i"), "column name"]) == 0 and "chunk:table:main.t" in capsys.readouterr().out
    assert main(["check", "drop table t"]) == 1 and main(["check", "select 1"]) == 0 and main(["bundle", str(tmp_path / "none")]) == 1
    star = tmp_path / "star"
    star.mkdir()
    (star / "schema.json").write_text(to_json(star_artifact().physical))
    capsys.readouterr()
    assert main(["run", str(star), SMALL, "select count(*) as n from orders"]) == 0 and json.loads(capsys.readouterr().out)["rows"] == [[1500]]
    assert main(["run", str(star), SMALL, "select * from secret"]) == 1


def test_index_holds_concepts_policy_and_relationships(spark, tmp_path, capsys):
    star, index = tmp_path / "star", str(tmp_path / "i")
    star.mkdir()
    (star / "schema.json").write_text(to_json(star_artifact().physical))
    (star / "concepts.md").write_text("---\nconcepts:\n- id: concept:revenue\n  label: Revenue\n  synonyms: [turnover]\n  links: ['table:public.orders#o_totalprice']\n- id: concept:balance\n  label: Balance\n  description: Sum of c_acctbal.\n---\n")
    policy = "---\nschemaId: star\n---\n# Policy\n\n## Scope rules\n\nOrders follow their customer.\n\n## Hierarchy\n\nRegions hold nations.\n"
    told = lambda: {i for i in (r["id"] for r in VectorStore(spark, index).read().collect()) if not i.startswith("chunk:table:")}
    (star / "tenant-policy.md").write_text(policy)
    assert main(["index", str(star), index]) == 0
    assert told() == {"chunk:concept:revenue", "chunk:tenant-policy#scope-rules", "chunk:tenant-policy#hierarchy"}
    capsys.readouterr()
    assert main(["query", str(star), index, "concept revenue turnover"]) == 0 and "chunk:concept:revenue" in capsys.readouterr().out
    (star / "tenant-policy.md").write_text("---\nschemaId: star\n---\nOrders follow their customer.\n")
    assert main(["index", str(star), index, "--relationships"]) == 0 and told() == {"chunk:concept:revenue", "chunk:tenant-policy#body"}
    assert sum("->" in r["id"] for r in VectorStore(spark, index).read().collect()) == 5


def reply(system, prompt):
    """A model that always says the same."""
    return "```sql\nselect c_mktsegment, count(*) as n from customer where c_acctbal > 0 group by c_mktsegment\n```"


def test_ask_and_templates(spark, tmp_path, capsys):
    star = tmp_path / "star"
    star.mkdir()
    (star / "schema.json").write_text(to_json(star_artifact().physical))
    question = ["ask", str(star), SMALL, "How many customers by segment?", "--model", "test_cli:reply"]
    assert main(question) == 0
    told = capsys.readouterr()
    assert len(json.loads(told.out)["rows"]) == 5 and "reads sensitive table:public.customer#c_acctbal" in told.err
    assert main([*question, "--sql-only"]) == 0 and "select c_mktsegment" in capsys.readouterr().out
    assert main(["templates", "mysql", "views"]) == 0 and "view_definition" in capsys.readouterr().out and main(["templates", "none", "views"]) == 1
