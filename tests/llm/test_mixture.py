"""Problem 7: rates, caps, shares, and the same draws on any partitions."""

from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm.mixture import mixture, mixture_report, repetition_rates

SOURCES = st.lists(st.tuples(st.floats(0, 1), st.integers(0, 5), st.integers(0, 10**6)), min_size=1, max_size=8)


def test_rates():
    plan = {r.source: r.rate for r in repetition_rates([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2)], {"a": 800, "b": 150, "c": 10}, 1000)}
    assert plan["c"] == 2 and plan["a"] <= 1 and plan["b"] <= 4
    assert abs(plan["a"] * 800 + plan["b"] * 150 + 20 - 1000) < 1e-6 and abs(plan["a"] * 800 / (plan["b"] * 150) - 5 / 3) < 1e-6
    assert [r.rate for r in repetition_rates([("a", 1.0, 2)], {"a": 10}, 100)] == [2] and [r.rate for r in repetition_rates([("a", 1.0, 2)], {}, 100)] == [0]
    assert repetition_rates([], {}, 0) == []


def test_mixture_keeps_caps_and_shares(spark):
    rows = [(i, "word " * 20, " Big" if i % 2 else "big ") for i in range(2000)] + [(10_000 + i, "word " * 20, "SMALL") for i in range(100)] + [(20_000, None, "big"), (20_001, "x", None), (20_002, "x", "other")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.8, 1), ("Small", 0.2, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    found = mixture(documents, targets).collect()
    assert found and {r["source"] for r in found} == {"big", "small"}
    copies = [(r["doc_id"], r["copy_no"]) for r in found]
    assert len(set(copies)) == len(copies) and max(r["copy_no"] for r in found if r["source"] == "small") == 3 and all(r["copy_no"] == 1 for r in found if r["source"] == "big")
    assert sorted(copies) == sorted((r["doc_id"], r["copy_no"]) for r in mixture(documents.repartition(7), targets).collect())
    report = {r["source"]: r for r in mixture_report(documents, targets).collect()}
    assert set(report) == {"big", "small", "absent", None} and abs(sum(r["reached_share"] for r in report.values()) - 1) < 1e-9
    assert report["small"]["most_copies"] == 3 and report["absent"]["mixture_tokens"] == 0 and report[None]["n_documents"] == 2
    assert sum(r["n_tokens"] for r in found) == sum(r["mixture_tokens"] for r in report.values())
    assert mixture(documents.limit(0), targets).collect() == [] and mixture(documents, targets.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(SOURCES, st.integers(0, 10**7))
def test_rates_keep_caps_and_size(sources, total):
    tokens = {str(i): n for i, (_, _, n) in enumerate(sources)}
    plan = repetition_rates([(str(i), share, cap) for i, (share, cap, _) in enumerate(sources)], tokens, total)
    assert all(0 <= r.rate <= r.max_repeats + 1e-9 for r in plan)
    size = sum(r.rate * r.tokens for r in plan)
    usable = [r for r in plan if r.tokens and r.target_share > 0 and r.max_repeats]
    assert size <= total * (1 + 1e-9) + 1e-6
    assert all(r.rate >= r.max_repeats - 1e-9 for r in usable) or abs(size - total) <= 1e-6 * max(1, total)


def test_odd_targets_and_ids(spark):
    documents = spark.createDataFrame([(1, "a b c", "x", "clash"), (1, "a b c", "x", "clash"), (None, "a", "x", "c"), (2, "", "X ", "c")], "doc_id long, text string, source string, n_tokens string")
    targets = spark.createDataFrame([("x", 0.5, 3), (" X", 0.5, 2), (None, 0.3, 9), ("y", None, None)], "source string, target_share double, max_repeats int")
    found = mixture(documents, targets).collect()
    assert max(r["copy_no"] for r in found) <= 2 and {r["source"] for r in found} == {"x"}
    assert {r["source"]: (r["target_share"], r["max_repeats"]) for r in mixture_report(documents, targets).collect()} == {"x": (1.0, 2), "y": (0.0, 0)}
