"""Problem 8: held-out accuracy, calibration, decoding, odd input."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from stratalith.llm.subject import Chain, assign_areas, train

WORDS = {
    "farm": "plough harvest cattle meadow seed tractor barley".split(), "law": "court judge statute appeal verdict plaintiff".split(), "sea": "sailor harbour anchor vessel tide cargo".split(),
}
SCHEMA = "doc_id long, source string, text string, area string, terms string"


def make(n, seed):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        areas = rng.sample(sorted(WORDS), rng.choice([1, 1, 2]))
        words = [w for a in areas for w in rng.choices(WORDS[a], k=12)] + rng.choices("the of and with into upon thing made part".split(), k=30)
        if rng.random() < 0.3:
            words.append(rng.choice(WORDS[rng.choice(sorted(WORDS))]))
        rng.shuffle(words)
        rows.append((seed * 100_000 + i, rng.choice([None, "Feed ", "feed", "court"]), " ".join(words), "clash", "clash"))
        truth[seed * 100_000 + i] = set(areas)
    return rows, truth


def areas(spark):
    return spark.createDataFrame([(a, None) for a in WORDS], "area string, scope_note string")


def labelled(spark, truth, noise=0.0):
    rng = random.Random(9)
    rows = [(d, rng.choice(sorted(WORDS)) if rng.random() < noise else a, None, dt.datetime(2024, 1, 1)) for d, s in truth.items() for a in s]
    return spark.createDataFrame(rows + rows[:5] + [(rows[0][0], "unknown", None, None), (None, "law", None, None), (10**9, "law", None, None)], "doc_id long, area string, labeller string, labelled_at timestamp")


def test_held_out_accuracy_with_wrong_labels(spark):
    seen, truth = make(500, 1)
    new, hidden = make(300, 2)
    chain = train(spark.createDataFrame(seen, SCHEMA), labelled(spark, truth, 0.1), areas(spark))
    got = {}
    for r in assign_areas(spark.createDataFrame(new, SCHEMA), chain).collect():
        got.setdefault(r["doc_id"], set()).add(r["area"])
    assert np.mean([got.get(d) == s for d, s in hidden.items()]) > 0.95


def test_odd_documents(spark):
    seen, truth = make(60, 3)
    chain = train(spark.createDataFrame(seen, SCHEMA), labelled(spark, truth), areas(spark))
    odd = [(1, None, None, "", ""), (2, "x", "", "", ""), (3, "x", " \n\t　", "", ""), (4, None, "harvest " * 200_000, "", ""), (5, None, "\U0001f600\x00", "", "")]
    found = assign_areas(spark.createDataFrame(odd + odd[3:4], SCHEMA), chain).collect()
    assert {r["doc_id"] for r in found} <= {4, 5} and [r["area"] for r in found if r["doc_id"] == 4] == ["farm", "farm"]
    assert assign_areas(spark.createDataFrame([], SCHEMA), chain).collect() == []


def test_no_labels_and_no_areas(spark):
    seen, truth = make(5, 4)
    documents = spark.createDataFrame(seen, SCHEMA)
    bare = train(documents, labelled(spark, truth).limit(0), areas(spark))
    assert assign_areas(documents, bare).count() >= 0
    none = train(documents, labelled(spark, truth), areas(spark).limit(0))
    assert assign_areas(documents, none).collect() == []


def test_same_result_on_other_partitions(spark):
    seen, truth = make(80, 5)
    documents, labels = spark.createDataFrame(seen, SCHEMA), labelled(spark, truth)
    one = assign_areas(documents, train(documents, labels, areas(spark))).orderBy("doc_id", "area").collect()
    two = assign_areas(documents.repartition(5), train(documents.repartition(7), labels.repartition(3), areas(spark))).orderBy("doc_id", "area").collect()
    assert one == two


def test_beam_finds_the_best_combination():
    rng = np.random.default_rng(0)
    k = 6
    chain = Chain([str(i) for i in range(k)], {}, {}, rng.normal(size=(4, k)), rng.normal(size=k), np.triu(rng.normal(size=(k, k)), 1), np.ones(k), np.zeros(k))
    x = rng.normal(size=(40, 4)).astype(np.float32)
    base = x @ chain.weights + chain.bias
    every = np.array([[b >> j & 1 for j in range(k)] for b in range(1, 2**k)], float)
    logit = base[:, None, :] + every @ chain.links
    score = (np.where(every, -np.logaddexp(0, -logit), -np.logaddexp(0, logit))).sum(2)
    assert (chain.decode(x, beam=64) == every[score.argmax(1)].astype(bool)).all()
    assert F is not None
