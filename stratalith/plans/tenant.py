"""Tenant policy and scope.

A policy names tenant roots, how they nest, and how every table hangs on them. A
scope says what the caller may see. Scoped tables are replaced by views that are
semi-joined to the allowed ids before any statement can name them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.errors import GuardError, SchemaError, ScopeError
from stratalith.plans.guard import inspect
from stratalith.session import cut_lineage

# Levels after which the ids found so far are put together.
GATHERED_LEVELS = 16


def table_name(identifier: str) -> str:
    """Bare table name of an id."""
    return identifier.split("#")[0].rsplit(".", 1)[-1].removeprefix("table:")


def column_name(identifier: str) -> str:
    """Column name of a column id."""
    return identifier.rsplit("#", 1)[-1]


def placeholder_name(label: str) -> str:
    """Placeholder of a root's ids (X-7)."""
    return f"tenant_{re.sub('[^a-z0-9]+', '_', label.lower())}_ids"


@dataclass(frozen=True)
class Root:
    """Tenant root table, its id column, and the root above it by a foreign key."""

    id: str
    id_column: str
    label: str
    parent: str | None = None
    foreign_key: str | None = None


@dataclass(frozen=True)
class Path:
    """One way from a table to a root: by a column of its own, or by join steps (from, to)."""

    root: str
    column: str | None = None
    join: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Polymorphic:
    """Table whose rows belong to the root that their type column names."""

    id: str
    type_column: str
    id_column: str
    mapping: Mapping[str, str]


@dataclass(frozen=True)
class Policy:
    """Whole policy of one schema."""

    schema_id: str
    strict: bool
    roots: tuple[Root, ...]
    scoped: Mapping[str, tuple[Path, ...]] = field(default_factory=dict)
    polymorphic: tuple[Polymorphic, ...] = ()
    global_tables: tuple[str, ...] = ()

    def root(self, identifier: str) -> Root:
        """Root by table id."""
        for root in self.roots:
            if root.id == identifier:
                return root
        raise ScopeError(f"no tenant root {identifier}", "UNKNOWN_TENANT_ROOT")


_KEYS = {"schemaId", "enforcement", "roots", "hierarchy", "scopedTables", "polymorphicTables", "globalTables"}


def parse_policy(front: Mapping[str, Any]) -> Policy:
    """Policy from its front-matter; unknown keys, missing ones and wrong shapes are errors, never ignored."""
    try:
        if extra := set(front) - _KEYS:
            raise SchemaError(f"unknown keys in the policy: {', '.join(sorted(extra))}", "POLICY_SHAPE")
        if front["enforcement"] not in ("strict", "warn"):
            raise SchemaError("enforcement is strict or warn", "POLICY_SHAPE")
        edges = {e["child"]: (e["parent"], e["foreignKey"]) for e in front.get("hierarchy") or []}
        roots = []
        for r in front["roots"]:
            own = r.get("parent")
            parent, key = edges.get(r["id"], (own["root"], own["foreignKey"]) if own else (None, None))
            roots.append(Root(r["id"], r["tenantIdColumn"], r["label"], parent, key))
        scoped = {}
        for t in front.get("scopedTables") or []:
            paths = tuple(Path(p["root"], p.get("column"), tuple((s["from"], s["to"]) for s in p.get("join") or ())) for p in t["scopeThrough"])
            if not paths or any((p.column is None) == (not p.join) for p in paths):
                raise SchemaError(f"{t['id']} needs a column or a join for each path", "POLICY_SHAPE")
            scoped[t["id"]] = paths
        polymorphic = tuple(Polymorphic(t["id"], t["typeColumn"], t["idColumn"], dict(t["mapping"])) for t in front.get("polymorphicTables") or [])
    except (KeyError, TypeError) as error:
        raise SchemaError(f"the policy can't be read: {error}", "POLICY_SHAPE") from None
    if not roots:
        raise SchemaError("a policy has at least one root", "POLICY_SHAPE")
    return Policy(front["schemaId"], front["enforcement"] == "strict", tuple(roots), scoped, polymorphic, tuple(front.get("globalTables") or ()))


def cycle(policy: Policy) -> list[str]:
    """Roots on a loop of parents, if there is one."""
    above = {r.id: r.parent for r in policy.roots if r.parent}
    for start in above:
        trail, at = [], start
        while at in above and at not in trail:
            trail.append(at)
            at = above[at]
        if at in trail:
            return trail[trail.index(at) :]
    return []


def policy_warnings(policy: Policy, tables: set[str], columns: set[str]) -> list[tuple[str, str]]:
    """(kind, id) of everything in the policy that the schema or the policy itself doesn't have."""
    roots = {r.id for r in policy.roots}
    wanted: list[tuple[str, str, set[str]]] = []
    for r in policy.roots:
        wanted += [("orphaned_root_id", r.id, tables), ("orphaned_column_id", r.id_column, columns)]
        if r.parent:
            wanted += [("unknown_root_in_hierarchy", r.parent, roots), ("orphaned_fk_id", r.foreign_key or "", columns)]
    for identifier, paths in policy.scoped.items():
        wanted.append(("orphaned_scoped_table_id", identifier, tables))
        for p in paths:
            wanted.append(("unknown_root_in_scope", p.root, roots))
            wanted += [("orphaned_column_id", p.column, columns)] if p.column else [("orphaned_fk_id", c, columns) for step in p.join for c in step]
    for t in policy.polymorphic:
        wanted += [("orphaned_polymorphic_table_id", t.id, tables), ("orphaned_column_id", t.type_column, columns), ("orphaned_column_id", t.id_column, columns)]
        wanted += [("unknown_root_in_mapping", root, roots) for root in t.mapping.values()]
    wanted += [("orphaned_global_table_id", t, tables) for t in policy.global_tables]
    found = [(kind, identifier) for kind, identifier, known in wanted if identifier not in known]
    loop = cycle(policy)
    return found + ([("hierarchy_cycle", ",".join(loop))] if loop else [])


def classify(policy: Policy) -> dict[str, str]:
    """Class of every table that the policy names; later kinds win."""
    out = {r.id: "root" for r in policy.roots}
    out |= {t: "inherited" if any(p.join for p in paths) else "scoped" for t, paths in policy.scoped.items()}
    out |= {t.id: "polymorphic" for t in policy.polymorphic}
    return out | {t: "global" for t in policy.global_tables}


def coverage(tables: DataFrame, policy: Policy) -> DataFrame:
    """(table_id, classification) of all tables, ``unknown`` for those the policy doesn't name."""
    spark = tables.sparkSession
    known = spark.createDataFrame(list(classify(policy).items()), "table_id string, classification string")
    return tables.select("table_id").distinct().join(F.broadcast(known), "table_id", "left").select("table_id", F.coalesce("classification", F.lit("unknown")).alias("classification"))


@dataclass(frozen=True)
class Scope:
    """What a caller may see: ids by root, with or without descendants, or everything for a reason.

    ``filters`` restrict single tables further: table id to (column, operator, value) conditions.
    """

    kind: str
    ids: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    reason: str | None = None
    filters: Mapping[str, tuple[tuple[str, str, Any], ...]] = field(default_factory=dict)
    context: Mapping[str, str] = field(default_factory=dict)


def parse_scope(raw: Mapping[str, Any] | None, policy: Policy) -> Scope:
    """Checked scope (P20). Without one nothing may be read; ids are never empty; a global scope has a reason."""
    if raw is None:
        raise ScopeError("the policy needs a scope", "MISSING_SCOPE")
    try:
        access = raw["access"]
        kind = access["kind"]
        if kind == "global":
            if not str(access.get("reason") or "").strip():
                raise ScopeError("a global scope needs a reason", "GLOBAL_WITHOUT_REASON")
            parts: list[tuple[str, list[str]]] = []
        elif kind == "ids":
            parts = [(access["tenantRoot"], access["ids"])]
        elif kind == "subtree":
            parts = [(access["tenantRoot"], access["rootIds"])]
        elif kind == "multi_root":
            parts = [(s["tenantRoot"], s["ids"]) for s in access["scopes"]]
        else:
            raise ScopeError("no such kind of scope", "INVALID_SCOPE_SHAPE")
        if kind != "global" and (not parts or any(not isinstance(ids, (list, tuple)) or not ids or not all(isinstance(i, str) for i in ids) for _, ids in parts)):
            raise ScopeError("a scope has ids, as texts", "INVALID_SCOPE_SHAPE")
        filters = {}
        for identifier, f in (raw.get("tenantFilters") or {}).items():
            conditions = tuple((c["column"], c["operator"], c["value"]) for c in f["conditions"])
            if not conditions or any(o not in ("=", "!=", "IN", "NOT IN") for _, o, _ in conditions):
                raise ScopeError("a filter has conditions with =, !=, IN or NOT IN", "INVALID_SCOPE_SHAPE")
            filters[identifier] = conditions
    except (KeyError, TypeError, AttributeError):
        raise ScopeError("the scope can't be read", "INVALID_SCOPE_SHAPE") from None
    known = {r.id for r in policy.roots}
    merged: dict[str, tuple[str, ...]] = {}
    for root, ids in parts:
        if root not in known:
            raise ScopeError(f"no tenant root {root}", "UNKNOWN_TENANT_ROOT")
        merged[root] = (*merged.get(root, ()), *ids)
    return Scope(kind, merged, access.get("reason"), filters, raw.get("context") or {})


def resolve_placeholders(sql_names: list[str], policy: Policy, scope: Scope) -> dict[str, tuple[str, ...]]:
    """Ids of each ``tenant_<root>_ids`` placeholder (J14, U7); one whose root isn't in the scope is an error, not left in place."""
    by_name = {placeholder_name(r.label): r.id for r in policy.roots}
    out = {}
    for name in dict.fromkeys(sql_names):
        if name not in by_name:
            raise ScopeError(f"no root has the placeholder :{name}", "UNKNOWN_PLACEHOLDER")
        ids = scope.ids.get(by_name[name])
        if not ids:
            raise ScopeError(f"the scope has no ids for :{name}", "EMPTY_SCOPE")
        out[name] = ids
    return out


Read = Callable[[str], DataFrame]


def allowed_ids(policy: Policy, scope: Scope, read: Read) -> dict[str, DataFrame]:
    """Per reachable root, the distinct ``id`` values that the scope allows.

    ``ids`` and ``multi_root`` mean the ids as listed; ``subtree`` adds all descendants, level by level down the
    hierarchy of roots (no more levels than there are roots; a root that refers to itself, or roots that refer to each
    other in a loop, are followed until they close). ``read`` gives a table by its id. Scale: root tables are small beside what hangs on
    them; each level is one semi-join on the foreign key.
    """
    out: dict[str, DataFrame] = {}
    for root_id, ids in scope.ids.items():
        root = policy.root(root_id)
        column = F.col(column_name(root.id_column))
        rows = read(root_id)
        kind = rows.schema[column_name(root.id_column)].dataType
        out[root_id] = rows.where(column.isin([F.lit(i).try_cast(kind) for i in dict.fromkeys(ids)])).select(column.alias("id")).distinct()
    if scope.kind != "subtree":
        return out
    for root_id in scope.ids:
        if loop := _loop(policy, root_id):
            out |= _closed(policy, loop, out, read)
    for _ in policy.roots:
        for root in policy.roots:
            if root.parent in out and root.id not in out:
                rows = read(root.id).select(F.col(column_name(root.id_column)).alias("id"), F.col(column_name(root.foreign_key)).alias("_up"))
                out[root.id] = rows.join(out[root.parent].withColumnRenamed("id", "_up"), "_up", "left_semi").select("id").distinct()
    return out


def _loop(policy: Policy, root_id: str) -> list[str]:
    """Roots on the loop of parents that a root lies on, itself first; none if it lies on no loop."""
    above = {r.id: r.parent for r in policy.roots}
    trail, at = [root_id], above.get(root_id)
    while at and at not in trail:
        trail.append(at)
        at = above.get(at)
    return trail if at == root_id else []


def _closed(policy: Policy, loop: list[str], out: Mapping[str, DataFrame], read: Read) -> dict[str, DataFrame]:
    """Ids of each root of a loop that can be reached from the ids that ``out`` has."""
    kinds = {r: read(r).schema[column_name(policy.root(r).id_column)].dataType for r in loop}
    mark = {r: f"{i}|" for i, r in enumerate(loop)}
    key = lambda r, value: F.concat(F.lit(mark[r]), value.try_cast(kinds[r]).cast("string"))
    edges = start = None
    for root in map(policy.root, loop):
        one = read(root.id).select(key(root.parent, F.col(column_name(root.foreign_key))).alias("parent"), key(root.id, F.col(column_name(root.id_column))).alias("child"))
        edges = one if edges is None else edges.unionAll(one)
        if root.id in out:
            listed = out[root.id].select(key(root.id, F.col("id")).alias("id"))
            start = listed if start is None else start.unionAll(listed)
    reached = descendants(edges, start)
    return {r: reached.where(F.col("id").startswith(mark[r])).select(F.substr("id", F.lit(len(mark[r]) + 1)).cast(kinds[r]).alias("id")) for r in loop}


def descendants(edges: DataFrame, start: DataFrame, levels: int | None = None) -> DataFrame:
    """Ids reachable from ``start(id)`` over ``edges(parent, child)``, themselves included, to the last level; loops end.

    With ``levels``, what lies deeper is an error, never left out. Scale: one join and one anti-join a level, each on
    what the level before found; the edges are read once.
    """
    edges = cut_lineage(edges.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct())
    level = cut_lineage(start.select("id").distinct())
    reached, depth = level, 0
    while True:
        below = level.join(edges, level["id"] == edges["parent"]).select(F.col("child").alias("id")).distinct()
        level = cut_lineage(below.join(reached, "id", "left_anti"))
        if level.isEmpty():
            return reached
        depth += 1
        if levels is not None and depth > levels:
            raise ScopeError(f"the hierarchy is deeper than {levels} levels", "HIERARCHY_TOO_DEEP")
        reached = reached.unionAll(level)
        if depth % GATHERED_LEVELS == 0:
            reached = cut_lineage(reached)


def _condition(rows: DataFrame, name: str, operator: str, value: Any) -> Column:
    """The values take the column's type, so that the filter reaches the scan; one that can't equals nothing. Null columns pass no filter."""
    column, kind = F.col(name), rows.schema[name].dataType
    inside = column.isin([F.lit(v).try_cast(kind) for v in (value if isinstance(value, (list, tuple)) else [value])])
    return inside if operator in ("=", "IN") else column.isNotNull() & ~F.coalesce(inside, F.lit(False))


def scoped_table(identifier: str, policy: Policy, scope: Scope, ids: Mapping[str, DataFrame], read: Read) -> DataFrame:
    """The rows of one table that the scope allows.

    Roots and scoped tables are semi-joined to the allowed ids, inherited tables along their join path, polymorphic ones by
    type and id; several paths are alternatives. Global tables pass whole; so does everything in a global scope; a table
    the policy doesn't class, or whose roots the scope doesn't reach, gives no rows. Filters restrict further.
    """
    rows = read(identifier)
    kind = classify(policy).get(identifier, "unknown")
    if scope.kind == "global" or kind == "global":
        out = rows
    elif kind == "root":
        column = column_name(policy.root(identifier).id_column)
        out = _semi(rows, column, ids.get(identifier))
    elif kind in ("scoped", "inherited"):
        paths = [p for p in policy.scoped[identifier] if p.root in ids]
        keep = [_along(rows, p, policy, ids, read) for p in paths]
        if not keep:
            out = rows.where("false")
        elif len(keep) == 1:
            out = keep[0](rows)
        else:
            marked = rows.withColumn("_row", F.monotonically_increasing_id())
            hit = [k(marked).select("_row") for k in keep]
            every = hit[0]
            for other in hit[1:]:
                every = every.unionAll(other)
            out = marked.join(every.distinct(), "_row", "left_semi").drop("_row")
    elif kind == "polymorphic":
        spec = next(t for t in policy.polymorphic if t.id == identifier)
        parts = [(value, ids[root]) for value, root in spec.mapping.items() if root in ids]
        if not parts:
            out = rows.where("false")
        else:
            pairs = None
            kinds = {c: rows.schema[column_name(c)].dataType for c in (spec.type_column, spec.id_column)}
            for value, allowed in parts:
                one = allowed.select(F.lit(value).try_cast(kinds[spec.type_column]).alias("_type"), F.col("id").try_cast(kinds[spec.id_column]).alias("_id"))
                pairs = one if pairs is None else pairs.unionAll(one)
            on = (rows[column_name(spec.type_column)] == pairs["_type"]) & (rows[column_name(spec.id_column)] == pairs["_id"])
            out = rows.join(pairs, on, "left_semi")
    else:
        out = rows.where("false")
    for column, operator, value in scope.filters.get(identifier, ()):
        out = out.where(_condition(out, column_name(column), operator, value))
    return out


def _semi(rows: DataFrame, column: str, allowed: DataFrame | None) -> DataFrame:
    if allowed is None:
        return rows.where("false")
    renamed = allowed.withColumnRenamed("id", "_allowed")
    return rows.join(renamed, rows[column] == renamed["_allowed"], "left_semi")


def _along(rows: DataFrame, path: Path, policy: Policy, ids: Mapping[str, DataFrame], read: Read) -> Callable[[DataFrame], DataFrame]:
    """Semi-join along a path, from the root's end back to the table."""
    if path.column:
        return lambda df: _semi(df, column_name(path.column), ids[path.root])
    allowed = ids[path.root]
    root = policy.root(path.root)
    steps = list(path.join)
    last_table, last_column = steps[-1][1].split("#")[0], column_name(steps[-1][1])
    if last_table != path.root or last_column != column_name(root.id_column):
        middle = _semi(read(last_table), column_name(root.id_column), allowed) if last_table == path.root else read(last_table)
        allowed = middle.select(F.col(last_column).alias("id")).distinct()
    for before, after in zip(reversed(steps[:-1]), reversed(steps[1:])):
        middle = _semi(read(after[0].split("#")[0]), column_name(after[0]), allowed)
        allowed = middle.select(F.col(column_name(before[1])).alias("id")).distinct()
    return lambda df: _semi(df, column_name(steps[0][0]), allowed)


def guard_findings(spark: SparkSession, sql: str, policy: Policy, scope: Scope) -> list[dict]:
    """What the policy objects to in a statement, by the relations its plan reads.

    Unclassed tables are always objected to; scoped ones only if the scope reaches none of their roots,
    since rows outside the scope aren't in the views anyway.
    """
    if scope.kind == "global":
        return []
    classes = {table_name(t): (t, c) for t, c in classify(policy).items()}
    out = []
    for relation in inspect(spark, sql).relations:
        name = relation.split(".")[-1]
        identifier, kind = classes.get(name, (name, "unknown"))
        if kind == "unknown":
            out.append({"code": "UNKNOWN_TABLE_REFERENCED", "table": identifier})
        elif kind in ("scoped", "inherited") and scope.kind != "subtree" and not any(p.root in scope.ids for p in policy.scoped[identifier]):
            out.append({"code": "MISSING_TENANT_PREDICATE", "table": identifier})
    return out


def enforce(findings: list[dict], policy: Policy) -> list[dict]:
    """Raise under strict enforcement, return as warnings otherwise."""
    if findings and policy.strict:
        raise GuardError(f"{len(findings)} objections of the tenant policy", findings[0]["code"], findings)
    return findings


def describe_policy(policy: Policy, scope: Scope) -> str:
    """Prompt block: how tables hang on tenants, and what the caller sees."""
    lines = ["Tenants:"]
    for r in policy.roots:
        lines.append(f"- {r.label} ({table_name(r.id)}.{column_name(r.id_column)})" + (f", below {policy.root(r.parent).label}" if r.parent else ""))
    for identifier, paths in sorted(policy.scoped.items()):
        ways = [column_name(p.column) if p.column else " then ".join(f"{column_name(a)} = {column_name(b)}" for a, b in p.join) for p in paths]
        lines.append(f"- {table_name(identifier)} belongs to a tenant by {' or '.join(ways)}")
    for t in policy.polymorphic:
        lines.append(f"- {table_name(t.id)} belongs by {column_name(t.type_column)} and {column_name(t.id_column)}: {', '.join(f'{k} is {table_name(v)}' for k, v in sorted(t.mapping.items()))}")
    if policy.global_tables:
        lines.append("- shared by all: " + ", ".join(sorted(map(table_name, policy.global_tables))))
    seen = scope.reason if scope.kind == "global" else ", ".join(f"{len(ids)} of {policy.root(root).label}" for root, ids in scope.ids.items())
    lines.append(f"The caller sees {scope.kind}: {seen}. Tables already hold only these rows.")
    lines += [f"Caller's {k}: {v}" for k, v in sorted(scope.context.items())]
    return "\n".join(lines)
