"""Schema artifacts: reading, describing, merging, writing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.errors import SchemaError

# Headings that descriptions may use, compared without case.
SECTIONS = ("Common query language", "Example questions", "Business context", "Column notes")
POLICY_SECTIONS = ("Hierarchy", "Scope rules", "Sensitive interactions")
TABLE_KEYS = {"id", "aliases", "tags", "primaryEntity", "tracked", "toIgnore", "to-ignore", "columns", "sensitive"}
COLUMN_KEYS = {"id", "description", "aliases", "enum", "sensitive"}


@dataclass
class Described:
    """A markdown description: front-matter, body without it, known sections, text after the title."""

    front: dict[str, Any]
    body: str
    sections: dict[str, str]
    description: str


def split_front(text: str) -> tuple[dict[str, Any], str]:
    """Front-matter and body; any error in the front-matter is fatal."""
    found = re.match(r"\A\ufeff?---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\Z)", text, re.S)
    if not found:
        return {}, text
    try:
        front = yaml.safe_load(found[1]) or {}
    except yaml.YAMLError as error:
        raise SchemaError(f"front-matter can't be read: {str(error)[:120]}", "FRONT_MATTER") from None
    if not isinstance(front, dict):
        raise SchemaError("front-matter isn't a mapping", "FRONT_MATTER")
    return front, text[found.end() :]


def read_sections(body: str, known: Iterable[str] = SECTIONS) -> dict[str, str]:
    """Bodies of the known second-level sections."""
    names = {k.lower(): k for k in known}
    parts = re.split(r"(?m)^##[ \t]+(.+?)[ \t]*$", body)
    return {names[h.strip().lower()]: text.strip() for h, text in zip(parts[1::2], parts[2::2]) if h.strip().lower() in names}


def first_paragraph(body: str) -> str:
    """Text after the title up to a blank line or a heading, on one line (X-13)."""
    after = re.split(r"(?m)^#[ \t]+.*$", body, maxsplit=1)[-1]
    lines: list[str] = []
    for line in after.strip().split("\n"):
        if not line.strip() or line.startswith("#"):
            break
        lines.append(line.strip())
    return " ".join(lines)


def parse_description(text: str) -> Described:
    """A table's description (S5, D3, D4): unknown keys are errors, so is a contradiction about tracking."""
    front, body = split_front(text)
    if extra := set(front) - TABLE_KEYS:
        raise SchemaError(f"unknown keys: {', '.join(sorted(extra))}", "FRONT_MATTER")
    columns = front.get("columns") or []
    if any(not isinstance(c, dict) or set(c) - COLUMN_KEYS for c in columns):
        raise SchemaError("unknown keys in a column", "FRONT_MATTER")
    said = {not front[k] if k != "tracked" else bool(front[k]) for k in ("tracked", "toIgnore", "to-ignore") if front.get(k) is not None}
    if len(said) > 1:
        raise SchemaError("the table is both tracked and ignored", "FRONT_MATTER")
    front["tracked"] = said.pop() if said else True
    return Described(front, body, read_sections(body), first_paragraph(body))


def parse_concepts(text: str) -> list[dict[str, Any]]:
    """Concepts with id, label, synonyms, links and description."""
    front, _ = split_front(text)
    out = []
    for c in front.get("concepts") or []:
        if not c.get("id") or not c.get("label"):
            raise SchemaError("a concept has an id and a label", "FRONT_MATTER")
        out.append({"id": c["id"], "label": c["label"], "synonyms": c.get("synonyms") or [], "links": c.get("links") or [], "description": c.get("description")})
    return out


@dataclass
class Artifact:
    """A schema document with its descriptions."""

    physical: dict[str, Any]
    descriptions: dict[str, Described] = field(default_factory=dict)
    concepts: list[dict[str, Any]] = field(default_factory=list)
    policy: dict[str, Any] | None = None
    policy_body: str = ""
    raw: dict[str, str] = field(default_factory=dict)


def check_physical(data: Any) -> dict[str, Any]:
    """The schema document if it is of version 2 and whole; SchemaError otherwise."""
    if not isinstance(data, dict):
        raise SchemaError("a schema document is an object", "ARTIFACT_SHAPE")
    if data.get("version") == 1:
        raise SchemaError("version 1 isn't taken here; see read_version_1", "ARTIFACT_VERSION")
    text = lambda x: isinstance(x, str) and bool(x)
    tables = data.get("tables")
    sound = data.get("version") == 2 and text(data.get("schemaId")) and isinstance(tables, list) and bool(tables)
    for t in tables if sound else ():
        columns = t.get("columns") if isinstance(t, dict) else None
        sound = sound and all(text(t.get(k)) for k in ("id", "name", "schema")) if isinstance(t, dict) else False
        sound = sound and isinstance(columns, list) and bool(columns) and all(isinstance(c, dict) and all(text(c.get(k)) for k in ("id", "name", "type")) and isinstance(c.get("nullable"), bool) for c in columns)
        sound = sound and all(isinstance(r, dict) and text(r.get("from")) and text(r.get("to")) for r in t.get("relationships") or [])
    if not sound:
        raise SchemaError("the schema document isn't whole", "ARTIFACT_SHAPE")
    return data


def read_version_1(raw: str) -> dict[str, Any]:
    """A version-1 document in the same shape (S4, D8): no namespace, nullable unless said; repeated names are errors."""
    data = json.loads(raw)
    if data.get("version") != 1:
        raise SchemaError("not version 1", "ARTIFACT_VERSION")
    names = [t["name"] for t in data["tables"]]
    if len(set(names)) < len(names) or any(len({c["name"] for c in t["columns"]}) < len(t["columns"]) for t in data["tables"]):
        raise SchemaError("a name occurs twice", "DUPLICATE_NAME")
    return {
        "version": 1, "schemaId": data.get("schemaId", "default"),
        "tables": [{"id": t["name"], "name": t["name"], "schema": None, "sensitive": bool(t.get("sensitive")), "relationships": [],
                    "columns": [{"id": f"{t['name']}#{c['name']}", "name": c["name"], "type": c["type"], "nullable": c.get("nullable", True), "primaryKey": c.get("primaryKey", False), "sensitive": bool(c.get("sensitive"))} for c in t["columns"]]} for t in data["tables"]],
    }


def from_json(raw: str) -> Artifact:
    """Artifact of one JSON text: a bare schema document or a bundle."""
    try:
        data = json.loads(raw)
    except ValueError:
        raise SchemaError("not JSON", "ARTIFACT_JSON") from None
    if isinstance(data, dict) and data.get("bundled"):
        return _assemble(check_physical(data.get("physical")), data.get("tables") or {}, data.get("concepts"), data.get("tenantPolicy"))
    return Artifact(check_physical(data))


def _assemble(physical: dict[str, Any], files: Mapping[str, str], concepts: str | None, policy: str | None) -> Artifact:
    out = Artifact(physical, raw=dict(files))
    for name, text in sorted(files.items()):
        described = parse_description(text)
        identifier = described.front.get("id") or next((t["id"] for t in physical["tables"] if t["name"] == name.removesuffix(".md")), name)
        out.descriptions[identifier] = described
    out.concepts = parse_concepts(concepts) if concepts else []
    if policy:
        out.policy, out.policy_body = split_front(policy)
        if not out.policy:
            raise SchemaError("the policy has no front-matter", "POLICY_SHAPE")
        out.raw["tenant-policy.md"] = policy
    if concepts:
        out.raw["concepts.md"] = concepts
    return out


def load(path: str) -> Artifact:
    """Artifact of a folder (schema.json, tables/*.md, concepts.md, tenant-policy.md), a bundle or a bare document."""
    at = Path(path)
    if at.is_dir():
        if not (at / "schema.json").exists():
            raise SchemaError("the folder has no schema.json", "ARTIFACT_MISSING")
        read = lambda p: p.read_text(encoding="utf-8") if p.exists() else None
        files = {p.name: p.read_text(encoding="utf-8") for p in sorted((at / "tables").glob("*.md"))} if (at / "tables").is_dir() else {}
        try:
            physical = check_physical(json.loads((at / "schema.json").read_text(encoding="utf-8")))
        except ValueError:
            raise SchemaError("not JSON", "ARTIFACT_JSON") from None
        return _assemble(physical, files, read(at / "concepts.md"), read(at / "tenant-policy.md"))
    if not at.exists():
        raise SchemaError("no such artifact", "ARTIFACT_MISSING")
    return from_json(at.read_text(encoding="utf-8"))


TABLES = "schema_id string, table_id string, schema string, name string, sensitive boolean, tracked boolean, description string, aliases array<string>, primary_entity string, common_query_language string, questions array<string>, business_context string, position int"
COLUMNS = "schema_id string, table_id string, column_id string, name string, type string, nullable boolean, primary_key boolean, sensitive boolean, description string, aliases array<string>, enum array<string>, note string, position int"
LINKS = "schema_id string, table_id string, from_id string, to_id string, position int"
CONCEPTS = "schema_id string, id string, label string, synonyms array<string>, links array<string>, description string"
POLICY = "schema_id string, section string, body string"


def questions(body: str | None) -> list[str]:
    """Items of a bulleted section (X-14)."""
    return [line.strip()[2:].strip() for line in (body or "").split("\n") if line.strip()[:2] in ("- ", "* ")]


def column_notes(said: Described | None) -> dict[str, str]:
    """Notes of the section on columns, by column name (X-14)."""
    body = said.sections.get(SECTIONS[3], "") if said else ""
    found = re.findall(r"(?m)^\s*-\s*`([^`]+)`\s*[:\-\u2014]\s*(.+?)\s*$", body)
    return dict(reversed(found))


def _sections(said: Described | None) -> tuple[str | None, list[str], str | None]:
    if said is None:
        return None, [], None
    return said.sections.get(SECTIONS[0]), questions(said.sections.get(SECTIONS[1])), said.sections.get(SECTIONS[2]) or None


def frames(spark: SparkSession, artifact: Artifact) -> dict[str, DataFrame]:
    """The artifact as tables ``tables``, ``columns``, ``relationships``.

    Marks come from the schema document only: a column counts as sensitive if it or its table is, and then loses its
    description, aliases and values; what a description says of marks is ignored.
    """
    schema_id = artifact.physical["schemaId"]
    tables, columns, links = [], [], []
    for i, t in enumerate(artifact.physical["tables"]):
        said = artifact.descriptions.get(t["id"])
        front = said.front if said else {}
        noted = {c.get("id"): c for c in front.get("columns") or []}
        hidden = bool(t.get("sensitive"))
        tables.append((schema_id, t["id"], t["schema"], t["name"], hidden, front.get("tracked", True), said.description if said else None, front.get("aliases") or [], front.get("primaryEntity"), *_sections(said), i))
        for j, c in enumerate(t["columns"]):
            mark = hidden or bool(c.get("sensitive"))
            note = {} if mark else noted.get(c["id"], {})
            columns.append((schema_id, t["id"], c["id"], c["name"], c["type"], c["nullable"], bool(c.get("primaryKey")), mark, note.get("description"), note.get("aliases") or [], note.get("enum") or [], None if mark else column_notes(said).get(c["name"]), j))
        links += [(schema_id, t["id"], r["from"], r["to"], j) for j, r in enumerate(t.get("relationships") or [])]
    return {"tables": spark.createDataFrame(tables, TABLES), "columns": spark.createDataFrame(columns, COLUMNS), "relationships": spark.createDataFrame(links, LINKS)}


def told_frames(spark: SparkSession, artifact: Artifact) -> dict[str, DataFrame]:
    """The artifact's ``concepts`` and the known sections of its ``policy`` for chunks; a policy without one is its whole body."""
    schema_id = artifact.physical["schemaId"]
    texts = lambda values: [str(v) for v in values]
    concepts = [(schema_id, str(c["id"]), str(c["label"]), texts(c["synonyms"]), texts(c["links"]), None if c["description"] is None else str(c["description"])) for c in artifact.concepts]
    sections = {name: text for name, text in read_sections(artifact.policy_body, POLICY_SECTIONS).items() if text}
    policy = [(schema_id, name, text) for name, text in (sections or {"": artifact.policy_body.strip()}).items() if text]
    return {"concepts": spark.createDataFrame(concepts, CONCEPTS), "policy": spark.createDataFrame(policy, POLICY)}


def warnings(artifact: Artifact) -> list[tuple[str, str]]:
    """(kind, id): described but absent ids, and tables and columns without a description."""
    tables = {t["id"]: {c["id"] for c in t["columns"]} for t in artifact.physical["tables"]}
    every = set().union(*tables.values()) if tables else set()
    out = [("orphaned_table_id", i) for i in artifact.descriptions if i not in tables]
    out += [("orphaned_column_id", c.get("id")) for d in artifact.descriptions.values() for c in d.front.get("columns") or [] if c.get("id") not in every]
    out += [("orphaned_concept_link", link) for c in artifact.concepts for link in c["links"] if link not in every and link not in tables]
    out += [("missing_table_description", i) for i in tables if i not in artifact.descriptions or not artifact.descriptions[i].description]
    noted = {c.get("id") for d in artifact.descriptions.values() for c in d.front.get("columns") or [] if c.get("description")}
    return out + [("missing_column_description", c) for c in sorted(every - noted)]


def merge_marks(new: DataFrame, old: DataFrame, keys: Sequence[str] = ("column_id",)) -> DataFrame:
    """Columns of a fresh introspection with the marks kept from before and ``is_new`` (J12); ``keys`` tell columns apart."""
    kept = old.select(*keys, F.col("sensitive").alias("_kept")).dropDuplicates(list(keys))
    joined = new.join(kept, list(keys), "left")
    return joined.select(*[c for c in new.columns if c != "sensitive"], F.coalesce("_kept", "sensitive", F.lit(False)).alias("sensitive"), F.col("_kept").isNull().alias("is_new"))


def merge(fresh: dict[str, Any], existing: dict[str, Any] | None) -> tuple[dict[str, Any], list[str]]:
    """A fresh schema document with the marks of the existing one, and the ids of columns that are new."""
    marks = {}
    for t in (existing or {}).get("tables", []):
        marks[t["id"]] = t.get("sensitive")
        marks |= {c["id"]: c.get("sensitive") for c in t["columns"]}
    new = []
    for t in fresh["tables"]:
        t["sensitive"] = bool(marks.get(t["id"], t.get("sensitive")))
        for c in t["columns"]:
            if existing and c["id"] not in marks:
                new.append(c["id"])
            c["sensitive"] = bool(marks.get(c["id"], c.get("sensitive")))
    return fresh, new


def to_json(physical: Mapping[str, Any]) -> str:
    """Byte-stable text of a schema document (K1)."""
    return json.dumps(physical, indent=2, ensure_ascii=False) + "\n"


def to_markdown(front: Mapping[str, Any], body: str) -> str:
    """Description with its front-matter in stable key order; empty fields are left out (K2)."""
    kept = {k: v for k, v in front.items() if v not in (None, [], {}, "")}
    return f"---\n{yaml.safe_dump(kept, sort_keys=True, allow_unicode=True)}---\n{body if body.endswith(chr(10)) else body + chr(10)}"


def bundle(path: str) -> str:
    """A folder as one bundle text, its policy included (K3)."""
    found = load(path)
    files = {k: v for k, v in found.raw.items() if k not in ("concepts.md", "tenant-policy.md")}
    out: dict[str, Any] = {"bundled": True, "physical": found.physical, "tables": files}
    out |= {key: found.raw[name] for key, name in (("concepts", "concepts.md"), ("tenantPolicy", "tenant-policy.md")) if name in found.raw}
    return json.dumps(out, indent=2, ensure_ascii=False, sort_keys=True) + "\n"


def replace_section(body: str, heading: str, text: str) -> str:
    """Body with the section's text replaced, or the section added at the end (X-15)."""
    pattern = re.compile(rf"(?ms)^##[ \t]+{re.escape(heading)}[ \t]*$.*?(?=^##[ \t]|\Z)")
    block = f"## {heading}\n\n{text.strip()}\n\n"
    return pattern.sub(lambda _: block, body, count=1).rstrip() + "\n" if pattern.search(body) else body.rstrip() + "\n\n" + block.rstrip() + "\n"


def replace_description(body: str, text: str) -> str:
    """Body with the paragraph after the title replaced (X-15)."""
    found = re.search(r"(?m)^#[ \t]+.*$", body)
    head, rest = (body[: found.end()], body[found.end() :]) if found else ("", body)
    old = re.match(r"\s*(?:(?!#)[^\n]+\n?)*", rest)
    return f"{head}\n\n{text.strip()}\n\n{rest[old.end():].lstrip()}".lstrip() if head else f"{text.strip()}\n\n{rest[old.end():].lstrip()}"


def prune(front: dict[str, Any], columns: set[str]) -> dict[str, Any]:
    """Front-matter without entries of columns that are gone."""
    return front | {"columns": [c for c in front.get("columns") or [] if c.get("id") in columns]}


def draft(artifact: Artifact, table_id: str) -> dict[str, Any]:
    """Editable view of one table."""
    table = next(t for t in artifact.physical["tables"] if t["id"] == table_id)
    said = artifact.descriptions.get(table_id)
    noted = {c.get("id"): c for c in said.front.get("columns") or []} if said else {}
    hidden = bool(table.get("sensitive"))
    return {
        "id": table_id, "description": said.description if said else "", "aliases": (said.front.get("aliases") or []) if said else [], "sections": dict(said.sections) if said else {},
        "columns": [{"id": c["id"], "type": c["type"], "sensitive": hidden or bool(c.get("sensitive"))} | {k: noted.get(c["id"], {}).get(k) for k in ("description", "aliases", "enum")} for c in table["columns"]],
    }


def sensitive_mentions(texts: Iterable[str], names: Iterable[str]) -> list[str]:
    """Sensitive names that the texts mention as whole words, without case."""
    joined = "\n".join(t for t in texts if t)
    return [n for n in dict.fromkeys(names) if re.search(rf"(?i)\b{re.escape(n)}\b", joined)]
