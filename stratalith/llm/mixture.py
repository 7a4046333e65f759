"""Mixing sources to target shares of tokens (problem 7).

Tokens are aggregated per source, repetition rates derived from targets and caps, and
each document is emitted floor(rate) times, plus once more with the probability of
the fraction, drawn from a hash of its id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm.bpe import DEFAULT_VOCABULARY, count_column
from stratalith.session import cut_lineage

MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Rate:
    """Plan for one source."""

    source: str
    target_share: float
    max_repeats: int
    tokens: int
    rate: float


def source_key(column: str):
    """Sources are compared without case and surrounding blanks."""
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def repetition_rates(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: int) -> list[Rate]:
    """Rates that bring the mixture to ``total`` tokens with shares as near the targets as the caps allow.

    A source whose target can't be met even at its cap is emitted at the cap; what it lacks is
    given to the other sources in proportion to their targets, again under their caps.
    If every source is at its cap the mixture stays smaller than ``total``.
    """
    rates: dict[str, float] = {s: 0.0 for s, _, _ in targets}
    open_sources = {s: (share, cap) for s, share, cap in targets if tokens.get(s, 0) > 0 and share > 0 and cap > 0}
    left = float(total)
    while open_sources:
        weight = sum(share for share, _ in open_sources.values())
        wanted = {s: left * share / weight / tokens[s] for s, (share, _) in open_sources.items()}
        full = [s for s, (_, cap) in open_sources.items() if wanted[s] >= cap]
        if not full:
            rates |= wanted
            break
        for s in full:
            rates[s] = float(open_sources.pop(s)[1])
            left -= rates[s] * tokens[s]
    return [Rate(s, share, cap, tokens.get(s, 0), rates[s]) for s, share, cap in targets]


def plan_mixture(counts: DataFrame, targets: DataFrame) -> list[Rate]:
    """Rates per source; one row per source reaches the driver, from a partially aggregated sum."""
    listed = targets.where("source IS NOT NULL").select(source_key("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("cap"))
    merged = listed.groupBy("source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(merged) > MAX_SOURCES:
        raise ValueError("the list of targets is not a small closed list")
    wanted = [(r["source"], r["share"], r["cap"]) for r in merged]
    known = counts.withColumn("source", F.when(F.col("source").isin([w[0] for w in wanted]), F.col("source")))
    tokens = {r["source"]: r["n"] for r in known.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    return repetition_rates(wanted, tokens, sum(v or 0 for v in tokens.values()))


def token_counts(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source key, n_tokens) of all documents, written once: both passes below read it."""
    counted = count_column(documents, "text", ["doc_id", "source"], vocabulary)
    return cut_lineage(counted.select("doc_id", source_key("source").alias("source"), "n_tokens"))


def emit_copies(counts: DataFrame, rates: list[Rate], seed: int = 17) -> DataFrame:
    """Each document floor(rate) times and once more with the fraction's probability.

    The draw is a hash of seed and doc_id, so it is the same on every run and every cluster, and
    rows of one doc_id share it. Documents of other or null source are not in the mixture.
    """
    spark = counts.sparkSession
    plan = spark.createDataFrame([(r.source, r.rate) for r in rates], "source string, rate double")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**53)) / F.lit(float(2**53))
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return (
        counts.join(F.broadcast(plan), "source").withColumn("copies", copies).where("copies > 0")
        .select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    )


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, seed: int = 17) -> DataFrame:
    """The mixture as (doc_id, source, n_tokens, copy_no).

    About as many tokens as all documents together (null sources included in that size), each
    source with its target share as far as ``max_repeats`` allows. No document occurs more
    often than that: the rate never exceeds it. Null and empty texts have no tokens and are
    emitted at their source's rate like others. Targets without documents get nothing;
    targets listed twice are summed, with the smaller cap. A row of ``documents`` is a document.

    Scale: documents are read and counted once; the counts (some 30 bytes a document)
    are the only thing kept; the sum per source is pre-aggregated, so a source with a
    third of all rows is no hot spot; emission has no shuffle.
    """
    counts = token_counts(documents, vocabulary)
    return emit_copies(counts, plan_mixture(counts, targets), seed)


def mixture_report(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, seed: int = 17) -> DataFrame:
    """Per source: target and reached share, cap, tokens before and after, rate, documents and most copies.

    Documents outside the targets are reported under a null source with target 0.
    """
    counts = token_counts(documents, vocabulary)
    rates = plan_mixture(counts, targets)
    spark = documents.sparkSession
    plan = spark.createDataFrame([(r.source, r.target_share, r.max_repeats, r.rate) for r in rates], "source string, target_share double, max_repeats int, rate double")
    listed = [r.source for r in rates]
    before = counts.withColumn("source", F.when(F.col("source").isin(listed), F.col("source"))).groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("n_documents"))
    after = emit_copies(counts, rates, seed).groupBy("source").agg(F.sum("n_tokens").alias("mixture_tokens"), F.count(F.lit(1)).alias("n_copies"), F.max("copy_no").alias("most_copies"))
    rows = before.join(F.broadcast(plan), before["source"].eqNullSafe(plan["source"]), "full").select(
        F.coalesce(before["source"], plan["source"]).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
        F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
    )
    joined = rows.join(after, "source", "left").fillna(0, ["mixture_tokens", "n_copies", "most_copies"])
    total = joined.agg(F.sum("mixture_tokens").alias("all_tokens"))
    return joined.crossJoin(F.broadcast(total)).withColumn("reached_share", F.try_divide(F.col("mixture_tokens"), F.col("all_tokens"))).drop("all_tokens")
