"""Suggestions for descriptions (P35, P37, J15, J20, O7, X-23)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.errors import GenerationError, SchemaError
from stratalith.functions.text import table_of
from stratalith.plans.tenant import Policy, parse_policy

TARGETS = ("table_description", "column_description", "common_query_language", "example_questions", "business_context", "concept")
MAX_CANDIDATES, MAX_NEIGHBOURS = 3, 4
Model = Callable[[str, str], str]


def neighbours(links: DataFrame, table_id: str, most: int = MAX_NEIGHBOURS) -> DataFrame:
    """Tables joined to one by a relationship in either direction, by id, at most ``most``."""
    ends = links.select(table_of(F.col("from_id")).alias("a"), table_of(F.col("to_id")).alias("b"))
    both = ends.unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where((F.col("a") == table_id) & (F.col("b") != table_id)).select(F.col("b").alias("table_id")).distinct().orderBy("table_id").limit(most)


def parse_candidates(reply: str, most: int = MAX_CANDIDATES) -> list[str]:
    """Texts between lines of dashes."""
    return [p.strip() for p in re.split(r"(?m)^-{3,}\s*$", reply) if p.strip()][:most]


def suggest(model: Model, target: str, name: str, context: str, n: int = MAX_CANDIDATES) -> list[str]:
    """One to three texts for a place in a description."""
    if target not in TARGETS:
        raise GenerationError(f"target is one of {', '.join(TARGETS)}", "UNKNOWN_TARGET")
    n = max(1, min(n, MAX_CANDIDATES))
    found = parse_candidates(model("You describe database schemas.", f"Write {n} alternatives for the {target.replace('_', ' ')} of {name}, parted by lines of ---.\n\n{context}"), n)
    if not found:
        raise GenerationError("the model gave no text", "EMPTY_REPLY")
    return found


def suggest_policy(model: Model, ddl: str) -> Policy:
    """Policy that a model drafts as bare JSON; checked like any other."""
    reply = model("You draft tenant policies as JSON.", f"Schema:\n{ddl}\n\nReply with the policy's front-matter as JSON only.")
    try:
        return parse_policy(json.loads(reply))
    except ValueError:
        raise SchemaError("the draft isn't JSON", "POLICY_SHAPE") from None


def broken_links(concepts: DataFrame, known: DataFrame) -> DataFrame:
    """(id, link) of concept links that lead nowhere."""
    return concepts.select("id", F.explode("links").alias("link")).join(known.select(F.col("id").alias("link")).distinct(), "link", "left_anti").select("id", "link")
