"""Command line (P40, P42): introspect, bundle, check, index, query, ask."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from stratalith.errors import EngineError


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="stratalith", description="Governed analytics on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("introspect", help="catalog to schema document")
    one.add_argument("provider")
    one.add_argument("address")
    one.add_argument("--schema-id", required=True)
    one.add_argument("--table", action="append", default=[], help="glob; may be repeated")
    target = one.add_mutually_exclusive_group(required=True)
    target.add_argument("--out")
    target.add_argument("--print", action="store_true", dest="show")
    target.add_argument("--diff", help="existing schema.json to compare with")
    commands.add_parser("bundle", help="folder to one JSON text").add_argument("folder")
    commands.add_parser("warnings", help="what a folder leaves undescribed").add_argument("folder")
    commands.add_parser("check", help="verdict on a statement").add_argument("sql")
    for name in ("index", "query"):
        sub = commands.add_parser(name, help="build or search the vector index of a folder")
        sub.add_argument("folder")
        sub.add_argument("index")
        if name == "index":
            sub.add_argument("--relationships", action="store_true", help="index relationships, too")
        if name == "query":
            sub.add_argument("question")
            sub.add_argument("-k", type=int, default=8)
    listed = commands.add_parser("templates", help="catalog queries of an engine")
    listed.add_argument("engine")
    listed.add_argument("part", nargs="?")
    asked = commands.add_parser("ask", help="question to a checked statement and its rows")
    asked.add_argument("folder")
    asked.add_argument("data")
    asked.add_argument("question")
    asked.add_argument("--model", required=True, help="module:function of (system, prompt) that gives the reply")
    asked.add_argument("--scope", help="JSON")
    asked.add_argument("--sql-only", action="store_true")
    run = commands.add_parser("run", help="checked statement over a folder of Parquet tables")
    run.add_argument("folder")
    run.add_argument("data")
    run.add_argument("sql")
    run.add_argument("--scope", help="JSON")
    return parser


def _introspect(args: argparse.Namespace) -> int:
    from stratalith.session import get_session
    from stratalith.sources.artifact import merge, to_json
    from stratalith.sources.catalog import Connectors, to_artifact, unmatched_globs

    catalog = Connectors().read(args.provider, get_session(), args.address)
    for glob in unmatched_globs(catalog, args.table):
        print(f"no table matches {glob}", file=sys.stderr)
    fresh = to_artifact(catalog, args.schema_id, args.provider, globs=args.table)
    place = Path(args.out) / "schema.json" if args.out else Path(args.diff) if args.diff else None
    old = json.loads(place.read_text()) if place and place.exists() else None
    text = to_json(merge(fresh, old)[0])
    if args.show:
        print(text, end="")
    elif args.diff:
        print(json.dumps({"changed": not place.exists() or place.read_text() != text}))
    else:
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(text)
    return 0


def _chunks(spark, folder: str, relationships: bool = False):
    from stratalith.operators.chunks import build_chunks
    from stratalith.sources.artifact import frames, load, told_frames

    artifact = load(folder)
    found, told = frames(spark, artifact), told_frames(spark, artifact)
    return build_chunks(found["tables"], found["columns"], found["relationships"], told["concepts"], told["policy"], relationships=relationships)


def main(argv: list[str] | None = None) -> int:
    """Exit code; results on stdout, everything else on stderr."""
    args = _parser().parse_args(argv)
    try:
        if args.command == "introspect":
            return _introspect(args)
        if args.command == "bundle":
            from stratalith.sources.artifact import bundle

            print(bundle(args.folder), end="")
        elif args.command == "warnings":
            from stratalith.sources.artifact import load, warnings

            for kind, identifier in warnings(load(args.folder)):
                print(kind, identifier)
        elif args.command == "check":
            from stratalith.plans.guard import verdict

            found = verdict(args.sql)
            print(found or "ok")
            return int(found is not None)
        elif args.command in ("index", "query"):
            from stratalith.operators.index import VectorStore, hashed_embedder, reindex, retriever
            from stratalith.session import get_session

            store = VectorStore(get_session(), args.index)
            if args.command == "index":
                store.write(reindex(_chunks(store.spark, args.folder, args.relationships), store.read(), hashed_embedder(), "hashed64"))
                print(store.count())
            else:
                for row in retriever(store.read())(args.question, args.k).collect():
                    print(f"{row['score']:.4f} {row['id']}")
        elif args.command == "templates":
            from stratalith.sources.catalog import TEMPLATES, template

            for part in [args.part] if args.part else TEMPLATES.get(args.engine, {}):
                print(f"-- {part}\n{template(args.engine, part)};\n")
        else:
            from stratalith.plans.execute import Engine, envelope
            from stratalith.session import get_session
            from stratalith.sources.artifact import load
            from stratalith.sources.tables import table

            spark, artifact = get_session(), load(args.folder)
            tables = {t["id"]: table(spark, args.data, t["name"]) for t in artifact.physical["tables"] if Path(args.data, f"{t['name']}.parquet").exists()}
            scope = json.loads(args.scope) if args.scope else None
            if args.command == "ask":
                import importlib

                module, _, name = args.model.partition(":")
                answer = Engine(spark, artifact, tables, model=getattr(importlib.import_module(module), name)).ask(args.question, scope)
                print(answer.sql, file=sys.stdout if args.sql_only else sys.stderr)
                for identifier in answer.sensitive:
                    print(f"reads sensitive {identifier}", file=sys.stderr)
                if args.sql_only:
                    return 0
            else:
                answer = Engine(spark, artifact, tables).run(args.sql, scope)
            print(json.dumps(envelope(answer.frame), default=str))
    except EngineError as error:
        print(f"{error.code}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
