"""Running an accepted statement over scoped views, and what comes back."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.errors import EngineError, GenerationError, StatementError
from stratalith.plans import tenant as tenancy
from stratalith.plans.dialects import DIALECTS, Dialect
from stratalith.plans.guard import explain, inspect, sensitive_reads, validate
from stratalith.plans.lexer import placeholders, same_statement, tenant_placeholders
from stratalith.plans.logs import EventLog
from stratalith.plans.parameters import Parameter, Prepared, bind, fence, parse_manifest, statement_of
from stratalith.plans.prompt import ambiguity_notes, build_prompt, check_inputs, ddl_lines, ddl_text, referenced_tables
from stratalith.sources.artifact import Artifact, frames

MODES = ("schema_only", "bounded_results")
ROW_CAP = 500
RETRIEVAL_THRESHOLD = 30
HISTORY_KEPT, HISTORY_SHOWN = 200, 50
Model = Callable[[str, str], str | tuple[str, dict]]


@dataclass
class Answer:
    """Outcome of a question: statement, parameters, checks, and the lazily run result."""

    sql: str
    frame: DataFrame
    named_sql: str | None = None
    parameters: tuple[Parameter, ...] = ()
    prepared: Prepared | None = None
    explanation: Any = None
    findings: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    sensitive: list[str] = field(default_factory=list)


def envelope(frame: DataFrame, cap: int = ROW_CAP) -> dict[str, Any]:
    """At most ``cap`` rows, and whether there were more; the limit is part of the plan."""
    began = time.time()
    try:
        rows = frame.limit(cap + 1).collect()
    except Exception as error:  # noqa: BLE001 - what the engine says goes to the caller as data
        return {"ok": False, "error": str(error).split("\n")[0][:300]}
    return {"ok": True, "columns": frame.columns, "rows": [list(r) for r in rows[:cap]], "row_count": min(len(rows), cap), "duration_ms": int((time.time() - began) * 1000), "truncated": len(rows) > cap}


class Engine:
    """Governed access to a set of tables.

    ``tables`` maps table ids to frames. With a policy, every run needs a scope; statements see views that hold only
    the scope's rows, in a session of their own in which nothing else can be named.
    """

    def __init__(self, spark: SparkSession, artifact: Artifact, tables: Mapping[str, DataFrame], policy: tenancy.Policy | None = None, model: Model | None = None, dialect: str | None = None, log: EventLog | None = None, retriever: Callable[..., DataFrame] | None = None, chunk_count: int | None = None, on_usage: Callable[[dict], None] | None = None, on_resolve: Callable[[Answer], None] | None = None) -> None:
        self.spark, self.artifact, self.tables, self.model = spark, artifact, dict(tables), model
        self.policy = policy or (tenancy.parse_policy(artifact.policy) if artifact.policy else None)
        self.dialect: Dialect = DIALECTS.get(dialect or "spark", DIALECTS["spark"])
        self.log = log
        self.retriever, self.chunk_count = retriever, chunk_count
        self.on_usage, self.on_resolve = on_usage, on_resolve
        self.frames = frames(spark, artifact)

    def _say(self, event: str, **fields: Any) -> None:
        if self.log:
            self.log.emit(event, **fields)

    def scope(self, raw: Mapping[str, Any] | tenancy.Scope | None) -> tenancy.Scope | None:
        """Checked scope; fails closed if there is a policy."""
        if self.policy is None or isinstance(raw, tenancy.Scope):
            return raw if isinstance(raw, tenancy.Scope) else None
        try:
            out = tenancy.parse_scope(raw, self.policy)
        except EngineError as error:
            self._say("scope_rejected", code=error.code)
            raise
        self._say("scope_checked", kind=out.kind)
        return out

    def scoped(self, scope: tenancy.Scope | None) -> dict[str, DataFrame]:
        """Every table as the scope shows it, by bare name."""
        read = self.tables.__getitem__
        if self.policy is None or scope is None:
            return {tenancy.table_name(i): df for i, df in self.tables.items()}
        ids = tenancy.allowed_ids(self.policy, scope, read)
        return {tenancy.table_name(i): tenancy.scoped_table(i, self.policy, scope, ids, read) for i in self.tables}

    def run(self, sql: str, scope: Mapping[str, Any] | tenancy.Scope | None = None, values: Mapping[str, Any] | None = None) -> Answer:
        """Check a statement and run it over the scoped views. Values are bound as arguments, never pasted into the text."""
        checked = self.scope(scope)
        text = validate(sql, self.dialect)
        arguments = dict(values or {})
        names = [p.name for p in tenant_placeholders(text)]
        if names:
            if self.policy is None or checked is None:
                raise StatementError("tenant placeholders need a policy", "UNRESOLVED_PLACEHOLDER")
            arguments |= {n: list(v) for n, v in tenancy.resolve_placeholders(names, self.policy, checked).items()}
        text, positional = _positional(text, arguments)
        reading = inspect(self.spark, text)
        known = {tenancy.table_name(i).lower() for i in self.tables}
        if strange := [r for r in reading.relations if r.lower() not in known]:
            raise StatementError(f"{len(strange)} relations aren't among the tables", "UNKNOWN_RELATION")
        findings: list[dict] = []
        if self.policy is not None and checked is not None:
            findings = tenancy.enforce(tenancy.guard_findings(self.spark, text, self.policy, checked), self.policy)
        sensitive = sensitive_reads(reading, self.artifact.physical["tables"])
        if sensitive:
            self._say("sensitive_columns_read", n=len(sensitive))
        return Answer(text, self._frame(text, positional, checked, reading.relations), explanation=explain(text), findings=findings, sensitive=sensitive)

    def _frame(self, text: str, positional: list[Any], scope: tenancy.Scope | None, relations: tuple[str, ...]) -> DataFrame:
        session = self.spark.newSession()
        session.conf.set("spark.sql.runSQLOnFiles", "false")
        session.conf.set("spark.sql.session.timeZone", self.spark.conf.get("spark.sql.session.timeZone"))
        wanted = {r.lower() for r in relations}
        for name, frame in self.scoped(scope).items():
            if name.lower() in wanted:
                _in_session(session, frame).createOrReplaceTempView(name)
        return session.sql(text, args=positional) if positional else session.sql(text)

    def prepare(self, named: str, parameters: tuple[Parameter, ...]) -> Prepared:
        """Statement to be bound later."""
        return Prepared(self.dialect.id, validate(named, self.dialect), parameters)

    def schema_text(self, question: str) -> str:
        """Schema for the prompt.

        Whole if there is no retriever, at most 30 chunks, or nothing found; else the tracked tables that the found chunks refer to, with
        all their columns in schema order, followed by the found concepts, questions, relationships and rules.
        """
        whole = lambda only=None: ddl_text(ddl_lines(self.frames["tables"], self.frames["columns"], omit=True, only=only))
        if self.retriever is None or (self.chunk_count is not None and self.chunk_count <= RETRIEVAL_THRESHOLD):
            self._say("retrieval_skipped")
            return whole()
        self._say("retrieval_started")
        hits = self.retriever(question)
        only = referenced_tables(hits)
        if only.isEmpty():
            self._say("retrieval_skipped")
            return whole()
        others = [r["text"] for r in hits.where("NOT sensitive AND type NOT IN ('table', 'column')").orderBy("type", "id").select("text").collect()]
        self._say("retrieval_finished", others=len(others))
        return "\n\n".join([whole(only), *others])

    def ask(self, question: str, scope: Mapping[str, Any] | None = None, mode: str = "schema_only", parameters: bool = True, generator: Callable[[str, str], str] | None = None) -> Answer:
        """Question to answer: scope, prompt, model, checks, run (P1). A custom generator's statement is checked like any other."""
        if mode not in MODES:
            raise EngineError(f"mode is one of {', '.join(MODES)}", "UNKNOWN_MODE")
        self._say("run_started", mode=mode)
        checked = self.scope(scope)
        if self.policy is not None and checked is None:
            raise EngineError("unreachable without a scope", "MISSING_SCOPE")
        check_inputs(question, len(self.artifact.physical["tables"]))
        named_tables = self.artifact.physical["tables"]
        notes = ambiguity_notes(question, [t["name"] for t in named_tables], [c["name"] for t in named_tables for c in t["columns"]])
        tenants = tenancy.describe_policy(self.policy, checked) if self.policy and checked else None
        if generator is not None:
            reply = f"```sql\n{generator(question, self.dialect.id)}\n```"
        else:
            if self.model is None:
                raise GenerationError("there is no model", "NO_MODEL")
            prompt = build_prompt(question, self.schema_text(question), self.dialect, notes, tenants, parameters)
            self._say("prompt_built", chars=len(prompt))
            try:
                reply = self.model("You write SQL.", prompt)
            except Exception as error:  # noqa: BLE001 - a model fails in its own ways
                raise GenerationError(f"the model failed: {type(error).__name__}", "MODEL_FAILED") from error
            if not isinstance(reply, str):  # a reply with what it took
                reply, usage = reply
                if self.on_usage:
                    self.on_usage(usage)
        sql = statement_of(reply)
        if sql is None:
            raise StatementError("the reply has no statement", "SQL_EMPTY")
        named, declared, prepared = None, (), None
        if parameters:
            named, declared, prepared = self._extras(reply, sql)
        if prepared is not None:
            answer = self.run(named, checked or scope, {p.name: p.value for p in declared})
            answer.named_sql, answer.parameters, answer.prepared = named, declared, prepared
        else:
            answer = self.run(sql, checked or scope)
        answer.notes = notes
        self._say("run_finished", findings=len(answer.findings))
        if self.on_resolve:
            self.on_resolve(answer)
        return answer

    def _extras(self, reply: str, sql: str) -> tuple[str | None, tuple[Parameter, ...], Prepared | None]:
        """Parameters of the reply, all or none; they must bind back to the very statement."""
        named = fence(reply, "sql-unbound")
        if named is None:
            return None, (), None
        try:
            declared = parse_manifest(reply)
            prepared = self.prepare(named, declared)
            bound = bind(prepared, {p.name: p.value for p in declared}, self.dialect)
            if not same_statement(bound.literal, validate(sql, self.dialect)):
                raise StatementError("both forms differ", "INCONSISTENT")
        except EngineError as error:
            self._say("parameters_dropped", code=error.code)
            return None, (), None
        self._say("parameters_kept", n=len(declared))
        return named, declared, prepared


def _in_session(session: SparkSession, frame: DataFrame) -> DataFrame:
    """The same plan, owned by another session of the application."""
    moved = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, frame._jdf.queryExecution().analyzed())
    return DataFrame(moved, session)


def _positional(text: str, values: Mapping[str, Any]) -> tuple[str, list[Any]]:
    """Statement with ``?`` for each placeholder that has a value, lists spread out, and the values in order."""
    out, order, at = [], [], 0
    for p in placeholders(text, backslash=True):
        if p.name not in values:
            raise StatementError(f"no value for :{p.name}", "UNRESOLVED_PLACEHOLDER")
        value = values[p.name]
        items = list(value) if isinstance(value, (list, tuple)) else [value]
        out += [text[at : p.start], ", ".join("?" * len(items))]
        order += items
        at = p.end
    return "".join(out) + text[at:], order


def record_history(spark: SparkSession, path: str, entry: Mapping[str, Any]) -> None:
    """Append one entry."""
    spark.createDataFrame([(str(entry["id"]), float(entry["at"]), str(entry["question"]), str(entry.get("sql") or ""))], "id string, at double, question string, sql string").write.mode("append").parquet(path)


def latest_history(history: DataFrame, n: int = HISTORY_SHOWN) -> DataFrame:
    """Newest entries first, at most as many as are shown."""
    return history.orderBy(F.desc("at"), F.desc("id")).limit(max(0, min(n, HISTORY_KEPT)))


def drop_history(history: DataFrame, ids: list[str]) -> DataFrame:
    """History without the given entries (K5)."""
    return history.where(~F.col("id").isin(ids)) if ids else history


def total_usage(requests: list[Mapping[str, int | None]]) -> dict[str, int | None]:
    """Token usage summed over requests; a kind that no request states stays None."""
    kinds = ("total", "prompt", "completion", "embedding")
    filled = [dict(r) | {"total": r.get("total") if r.get("total") is not None else _sum([r.get("prompt"), r.get("completion")]) or r.get("embedding")} for r in requests]
    return {k: _sum([r.get(k) for r in filled]) for k in kinds}


def _sum(values: list[int | None]) -> int | None:
    there = [v for v in values if v is not None]
    return sum(there) if there else None
