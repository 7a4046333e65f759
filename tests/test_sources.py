"""Artifacts, catalogs, chunks, index, streams."""

import json
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from stratalith.errors import ConnectorError, ParameterError, SchemaError
from stratalith.functions import text as tx
from stratalith.functions.vectors import cosine, hashed_embedding
from stratalith.operators.chunks import build_chunks, packed_paragraphs
from stratalith.operators.index import SCHEMA, VectorStore, batch_embedder, check_k, compare, hashed_embedder, read_vector_file, refresh, reindex, retriever, search, write_vector_file
from stratalith.plans.prompt import ddl_lines, ddl_text
from stratalith.queries.star import _id, star_artifact
from stratalith.sources import artifact as art
from stratalith.sources import catalog as cat
from stratalith.sources.prisma import read_prisma
from stratalith.sources.tables import table
from stratalith.streaming.incremental import append_stream, index_stream, windowed_events

DOC = {"version": 2, "schemaId": "s", "tables": [{"id": "table:public.users", "name": "users", "schema": "public", "columns": [{"id": "table:public.users#id", "name": "id", "type": "uuid", "nullable": False, "primaryKey": True}, {"id": "table:public.users#email", "name": "email", "type": "text", "nullable": True, "sensitive": True}]}]}
NOTE = "---\nid: table:public.users\naliases: [people]\ncolumns:\n  - id: table:public.users#email\n    description: secret\n  - id: table:public.users#gone\n    description: x\n---\n# Users\n\nWho signs\nin.\n\n## Example questions\n\n- Who is new?\n* Whose email?\n\n## Column notes\n\n- `id`: the key\n"


def folder(tmp_path, note=NOTE):
    (tmp_path / "tables").mkdir()
    (tmp_path / "schema.json").write_text(json.dumps(DOC))
    (tmp_path / "tables" / "users.md").write_text(note)
    (tmp_path / "tenant-policy.md").write_text("---\nschemaId: s\nenforcement: strict\nroots:\n  - {id: table:public.users, tenantIdColumn: table:public.users#id, label: User}\n---\n## Scope rules\n\nText.\n")
    return str(tmp_path)


def test_folder_and_bundle_are_the_same(spark, tmp_path):
    loaded = art.load(folder(tmp_path))
    again = art.from_json(art.bundle(str(tmp_path)))
    assert loaded.physical == again.physical and again.policy["schemaId"] == "s" and loaded.descriptions.keys() == again.descriptions.keys()
    said = loaded.descriptions["table:public.users"]
    assert said.description == "Who signs in." and art.questions(said.sections["Example questions"]) == ["Who is new?", "Whose email?"]
    assert dict(art.warnings(loaded))["orphaned_column_id"] == "table:public.users#gone"
    columns = {r["name"]: r for r in art.frames(spark, loaded)["columns"].collect()}
    assert columns["email"]["description"] is None and columns["email"]["sensitive"] and columns["id"]["note"] == "the key"


@pytest.mark.parametrize("note", ["---\nid: x\nsurprise: 1\n---\n", "---\na: [\n---\n", "---\ntracked: true\ntoIgnore: true\n---\n", "---\ncolumns: [{id: a, odd: 1}]\n---\n"])
def test_bad_descriptions_are_fatal(tmp_path, note):
    with pytest.raises(SchemaError):
        art.load(folder(tmp_path, note))


def test_bad_documents():
    for raw in ("{", "[]", '{"version": 1, "tables": []}', '{"version": 2}', json.dumps(DOC | {"tables": []}), json.dumps({"bundled": True, "physical": None})):
        with pytest.raises(SchemaError):
            art.from_json(raw)
    old = art.read_version_1('{"version": 1, "tables": [{"name": "t", "columns": [{"name": "a", "type": "int"}]}]}')
    assert old["tables"][0]["columns"][0]["nullable"] is True
    with pytest.raises(SchemaError):
        art.read_version_1('{"version": 1, "tables": [{"name": "t", "columns": []}, {"name": "t", "columns": []}]}')


def test_merge_keeps_marks_and_writing_is_stable():
    fresh = json.loads(json.dumps(DOC))
    for c in fresh["tables"][0]["columns"]:
        c.pop("sensitive", None)
    fresh["tables"][0]["columns"].append({"id": "table:public.users#new", "name": "new", "type": "text", "nullable": True})
    merged, new = art.merge(fresh, DOC)
    assert [c["sensitive"] for c in merged["tables"][0]["columns"]] == [False, True, False] and new == ["table:public.users#new"]
    assert art.to_json(merged) == art.to_json(json.loads(art.to_json(merged))) and art.to_markdown({"b": [], "a": 1}, "x") == "---\na: 1\n---\nx\n"


def test_editing_markdown():
    body = "# T\n\nOld text\nhere.\n\n## Business context\n\nOld.\n\n## Other\n\nKeep.\n"
    assert "Old." not in (new := art.replace_section(body, "Business context", "New.")) and "Keep." in new and "New." in new
    assert art.replace_section("# T\n", "Business context", "New.").endswith("## Business context\n\nNew.\n")
    assert art.first_paragraph(art.replace_description(body, "Fresh.")) == "Fresh."
    assert art.prune({"columns": [{"id": "a"}, {"id": "b"}]}, {"a"})["columns"] == [{"id": "a"}]
    assert art.sensitive_mentions(["The EMAIL of", None], ["email", "mail"]) == ["email"] and art.draft(art.Artifact(DOC), "table:public.users")["columns"][1]["sensitive"]


def test_sqlite_catalog_to_artifact(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.executescript("create table products(tenant int, sku text, name, unique(name), primary key(sku, tenant)); create table stock(id integer primary key, t int, s text, foreign key(t, s) references products(tenant, sku) on delete cascade); create view v as select sku from products;")
    catalog = cat.read_sqlite(spark, path)
    document = cat.to_artifact(catalog, "shop", "sqlite")
    art.check_physical(document)
    assert [t["name"] for t in document["tables"]] == ["products", "stock", "v"] and document == cat.to_artifact(catalog, "shop", "sqlite")
    links = document["tables"][1]["relationships"]
    assert [(x["from"].split("#")[1], x["to"].split("#")[1]) for x in links] == [("t", "tenant"), ("s", "sku")]
    assert cat.folded_keys(catalog["primary_keys"]).where("table_name = 'products'").first()["columns"] == ["sku", "tenant"]
    assert cat.folded_foreign_keys(catalog["foreign_keys"]).first()["on_delete"] == "cascade"
    assert [t["name"] for t in cat.to_artifact(catalog, "shop", globs=["st?ck"], views=False)["tables"]] == ["stock"] and cat.unmatched_globs(catalog, ["x*", "st*"]) == ["x*"]


def test_export_bundle(spark, tmp_path):
    (tmp_path / "manifest.json").write_text('{"engine": "postgres", "version": 1, "files": {"indexes": "ix.json"}}')
    (tmp_path / "tables.csv").write_text('schema_name,table_name,relkind,row_level_security,comment\npublic,t,r,f,"two\nlines, ""q"""\npg_catalog,x,r,f,\\N\n')
    (tmp_path / "columns.json").write_text(json.dumps([{"schema_name": "public", "table_name": "t", "column_name": "a", "ordinal_position": 1, "data_type": "character varying(9)", "is_nullable": True}]))
    (tmp_path / "ix.json").write_text(json.dumps([{"schema_name": "public", "table_name": "t", "index_name": "i", "is_unique": True, "method": "btree", "columns": ["a,b", None, 'q"'], "expressions": "lower(x)"}]))
    catalog = cat.Connectors().read("export", spark, str(tmp_path))
    assert cat.to_artifact(catalog, "x")["tables"][0]["columns"][0]["type"] == "varchar(9)" and catalog["tables"].where("table_name = 't'").first()["comment"] == 'two\nlines, "q"'
    assert cat.folded_indexes(catalog["indexes"]).first()["columns"] == ["a,b", None, 'q"'] and cat.all_comments(catalog).count() == 1
    for text in ('schema_name\n"x', "schema_name,table_name\na,b\n"):
        (tmp_path / "tables.csv").write_text(text)
        with pytest.raises(ConnectorError):
            cat.read_export(spark, str(tmp_path))
    (tmp_path / "tables.csv").unlink()
    with pytest.raises(ConnectorError):
        cat.read_export(spark, str(tmp_path))
    (tmp_path / "manifest.json").write_text('{"version": 9}')
    with pytest.raises(ConnectorError):
        cat.read_export(spark, str(tmp_path))
    with pytest.raises(ConnectorError):
        cat.Connectors().read("nothing", spark)


def test_prisma(spark, tmp_path):
    (tmp_path / "schema.prisma").write_text('datasource db {\n url = "postgres://secret"\n}\nmodel User {\n id Int @id\n tags String[]\n geo Unsupported("point")?\n role Role @default(USER)\n posts Post[]\n @@map("users")\n}\nmodel Post {\n a Int\n b Int @map("bee")\n user User @relation(fields: [a], references: [id], onDelete: SetNull)\n @@id([a, b])\n}\nenum Role {\n USER\n ADMIN\n}\n')
    catalog = read_prisma(spark, str(tmp_path))
    kinds = {(r["table_name"], r["column_name"]): r["data_type"] for r in catalog["columns"].collect()}
    assert kinds == {("users", "id"): "integer", ("users", "tags"): "text[]", ("users", "geo"): "point", ("users", "role"): "role", ("Post", "a"): "integer", ("Post", "bee"): "integer"}
    key = cat.folded_foreign_keys(catalog["foreign_keys"]).first()
    assert (key["referenced_table_name"], key["columns"], key["on_delete"]) == ("users", ["a"], "set null")
    assert cat.folded_keys(catalog["primary_keys"]).where("table_name = 'Post'").first()["columns"] == ["a", "bee"] and cat.folded_enums(catalog["enums"]).first()["values"] == ["USER", "ADMIN"]


def test_native_introspection_and_addresses(spark):
    document = cat.to_artifact(cat.read_frames(spark, {"orders": table(spark, SMALL, "orders"), "embeddings": table(spark, SMALL, "embeddings")}), "star")
    assert {c["name"]: c["type"] for c in document["tables"][0]["columns"]} == {"vec_id": "bigint", "embedding": "real[]", "label": "integer"}
    assert cat.jdbc_url("mssql://u:p@h:99/db") == "jdbc:sqlserver://h:99;databaseName=db;user=u;password=p"
    assert cat.jdbc_url("Server=tcp:h,1433;Initial Catalog=db;User ID=u;Password=p") == "jdbc:sqlserver://h:1433;databaseName=db;user=u;password=p"
    assert "pg_class" in cat.template("cockroachdb", "tables")
    with pytest.raises(ConnectorError):
        cat.jdbc_url("nothing")
    with pytest.raises(ConnectorError):
        cat.template("mysql", "moons")


def chunks_of(spark, **options):
    found = art.frames(spark, star_artifact())
    return build_chunks(found["tables"], found["columns"], found["relationships"], **options)


def test_chunks(spark):
    rows = {r["id"]: r for r in chunks_of(spark).collect()}
    assert f"chunk:{_id('customer')}#q:1" not in rows and f"chunk:{_id('orders')}#q:2" in rows, "one sensitive mention drops all questions of its table"
    assert not any("supplier" in i and "->" not in i for i in rows) and not any("events" in i for i in rows)
    assert rows[f"chunk:{_id('customer')}"]["text"].split("\n")[:4] == ["# public.customer", "Who buys.", "Aliases: clients, buyers", "Primary entity: customer"]
    assert "c_acctbal" not in rows[f"chunk:{_id('customer')}"]["text"] and rows[f"chunk:{_id('customer')}"]["refs"][0] == _id("customer")
    assert rows[f"chunk:{_id('orders', 'o_orderstatus')}"]["text"].endswith("State of the order\nValues: O, F, P")
    everything = chunks_of(spark, include_sensitive=True, relationships=True)
    assert everything.count() == everything.select("id").distinct().count() > len(rows)


@pytest.mark.parametrize(("text", "parts"), [("", [""]), (None, None), ("a b", ["a b"]), ("aaaa\n\nbbbb\n \ncccc", ["aaaa\n\nbbbb", "cccc"]), ("x" * 30 + "\n\nb", ["x" * 30, "b"]), ("  \n", [""])])
def test_packing(spark, text, parts):
    assert spark.createDataFrame([(text,)], "t string").select(packed_paragraphs(F.col("t"), 12)).first()[0] == parts


def entries(spark, *rows):
    return spark.createDataFrame([(s, i, "table", t, ["table:a"], False) for s, i, t in rows], "schema_id string, id string, type string, text string, refs array<string>, sensitive boolean")


def test_incremental_index(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "index"))
    embed = hashed_embedder(16)
    assert store.version() == 0 and store.read().count() == 0
    store.write(reindex(entries(spark, ("s", "a", "x y"), ("s", "b", "z"), ("t", "a", "other")), store.read(), embed, "h16"))
    now = entries(spark, ("s", "a", "x y"), ("s", "a", "x y"), ("s", "c", "new"))
    assert {(r["schema_id"], r["id"]): r["state"] for r in compare(now, store.read(), "h16").collect()} == {("s", "a"): "reuse", ("s", "b"): "orphan", ("s", "c"): "new"}
    assert {r["state"] for r in compare(now, store.read(), "other").collect()} == {"changed", "orphan", "new"}
    store.write(reindex(now, store.read(), embed, "h16"))
    assert {(r["schema_id"], r["id"]) for r in store.read().collect()} == {("s", "a"), ("s", "c"), ("t", "a")}
    assert store.count(schema_id="s") == 2 and store.count(refs=["table:z"]) == 0 and store.hashes("a").count() == 2
    store.delete(entries(spark, ("s", "c", "")))
    store.upsert(store.read().where("schema_id = 't'").withColumn("text", F.lit("q")))
    assert store.count() == 2 and store.version() == 4
    assert [r["id"] for r in retriever(store.read(), 16)("x y", 1, schema_id="s").collect()] == ["a"]
    told = []
    assert refresh(store, now, embed, "h16", lambda e, c: told.append(e))["n_new"] == 1 and told == ["index_started", "index_finished"] and refresh(store, now, embed, "h16")["stale"] is False
    write_vector_file(store.read(), str(tmp_path / "file"))
    assert read_vector_file(spark, str(tmp_path / "file")).select("id", "embedding").orderBy("text").collect() == store.read().select("id", "embedding").orderBy("text").collect()
    (tmp_path / "file.bin").write_bytes(b"x")
    with pytest.raises(SchemaError):
        read_vector_file(spark, str(tmp_path / "file"))


def test_search_ties_zero_vectors_and_k(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("w", [1.0]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    query = F.array(F.lit(1.0), F.lit(0.0))
    assert [r["id"] for r in search(rows, query, 2).collect()] == ["a", "b"] and search(rows, query, 0).count() == 0
    assert search(rows, F.array(F.lit(0.0), F.lit(0.0)), 5).count() == 0
    for k in (0, 26, True, "3"):
        with pytest.raises(ParameterError):
            check_k(k)


def test_batch_embedder(spark):
    rows = batch_embedder(lambda texts: [[float(len(t)), float(sum(map(ord, t)) % 997)] for t in texts], 2)(entries(spark, ("s", "a", "ab"), ("s", "b", "")))
    assert sorted(r["embedding"] for r in rows.collect()) == [[0.0, 0.0], [2.0, 195.0]]


def test_functions(spark):
    row = spark.createDataFrame([("Sub-Agency", '{a,NULL,"b,c"}', "postgres://u:p@h/d", [3.0, 4.0])], "a string, b string, c string, v array<float>").select(
        tx.underscore_slug(F.col("a")), tx.array_literal(F.col("b")), tx.redact_url(F.col("c")), cosine(F.col("v"), F.col("v")), tx.fnv1a(F.lit("a")), tx.may_be_enum(F.lit("varchar(3)")),
        tx.sqlserver_type(F.lit("nvarchar"), F.lit(80), F.lit(0), F.lit(0)), tx.sqlserver_type(F.lit("varchar"), F.lit(-1), F.lit(0), F.lit(0)), tx.sqlite_type(F.lit(" ")), tx.schema_id_of_path(F.lit("/x/orders.schema/")), F.size(hashed_embedding(F.lit(""), 8)),
    ).first()
    assert list(row) == ["sub_agency", ["a", None, "b,c"], "postgres://h/d", 1.0, 0xE40C292C, True, "nvarchar(40)", "varchar(max)", "BLOB", "orders", 8]


def test_prompt_text(spark):
    found = art.frames(spark, star_artifact())
    text = ddl_text(ddl_lines(found["tables"], found["columns"]))
    assert "TABLE public.orders -- aliases: purchases" in text and "c_acctbal double (NULL) (sensitive)" in text and "events" not in text
    assert "not shown" in ddl_text(ddl_lines(found["tables"], found["columns"], omit=True))


def test_streams(spark, tmp_path):
    source = tmp_path / "events"
    table(spark, SMALL, "events").repartition(2).write.parquet(str(source))
    stream = spark.readStream.schema(table(spark, SMALL, "events").schema).parquet(str(source))
    query = windowed_events(stream).writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("w").collect()) == sorted(windowed_events(table(spark, SMALL, "events")).collect())
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == table(spark, SMALL, "events").count()
    rows = entries(spark, ("s", "a", "x"), ("s", "b", "y"))
    rows.write.parquet(str(tmp_path / "chunks"))
    store = VectorStore(spark, str(tmp_path / "index"))
    index_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "chunks")), store, hashed_embedder(8), "h8", str(tmp_path / "c2")).awaitTermination()
    assert store.count() == 2 and SCHEMA


def test_templates_are_whole_and_parts_have_an_order():
    for engine, parts in cat.TEMPLATES.items():
        assert set(parts) <= set(cat.ROWS) and {"tables", "columns", "primary_keys", "foreign_keys", "unique_constraints", "check_constraints", "indexes", "views"} <= set(parts)
        for part, query in parts.items():
            assert query.count("(") == query.count(")") and query.count("'") % 2 == 0 and ";" not in query, (engine, part)
            assert set(cat.ROWS[part]) <= set(re.findall(r"[a-z_]+", query)), (engine, part)
    assert set(cat.ORDER) == set(cat.ROWS) and all(set(cat.ORDER[p]) <= set(cat.ROWS[p]) for p in cat.ORDER)


def test_system_schemas_by_engine(spark):
    names = ["app", "db_app", "db_owner", "sys", "guest", "pg_toast_1", "pg_temp_3", "information_schema", "INFORMATION_SCHEMA"]
    rows = spark.createDataFrame([(n,) for n in names], "schema_name string")
    left = {e: {r[0] for r in rows.where(~cat.is_system(engine=e)).collect()} for e in ("postgres", "sqlserver", "mysql", "sqlite")}
    assert left["postgres"] == {"app", "db_app", "db_owner", "sys", "guest", "INFORMATION_SCHEMA"} and left["mysql"] == left["sqlite"] == set(names)
    assert left["sqlserver"] == {"app", "db_app", "pg_toast_1", "pg_temp_3", "information_schema"}


def test_runner_gives_typed_and_sorted_parts(spark):
    asked = {q: p for p, q in cat.TEMPLATES["sqlserver"].items()}
    columns = ["schema_name", "table_name", "column_name", "ordinal_position", "data_type", "udt_schema", "udt_name", "is_nullable", "default_expression", "comment", "max_length", "precision", "scale"]
    data = [["dbo", "t", "b", 2, "decimal", "", "decimal", True, None, None, "9", "12", "3"], ["dbo", "t", "a", 1, "nvarchar", "", "nvarchar", False, None, None, "40", "0", "0"]]
    catalog = cat.read_catalog(spark, "sqlserver", lambda q, p: (columns, data) if asked[q] == "columns" else (list(cat.ROWS[asked[q]]), []))
    assert [(r["column_name"], r["data_type"]) for r in catalog["columns"].collect()] == [("a", "nvarchar(20)"), ("b", "decimal(12,3)")] and catalog["enums"].count() == 0
    with pytest.raises(ConnectorError, match="lacks"):
        cat.read_catalog(spark, "mysql", lambda q, p: ([], []))


def test_sqlite_indexes_and_views(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.executescript("create table t (a int, b text unique); create index i1 on t (b, a); create unique index i2 on t (lower(b)); create view v as select a from t;")
    catalog = cat.read_sqlite(spark, path)
    found = {r["index_name"]: (r["is_unique"], r["columns"], r["expressions"]) for r in cat.folded_indexes(catalog["indexes"]).collect()}
    assert found["i1"] == (False, ["b", "a"], None) and found["i2"][:2] == (True, [None]) and "lower(b)" in found["i2"][2]
    assert catalog["views"].first()["definition"].lower().startswith("create view v") and catalog["unique_constraints"].count() == 1
