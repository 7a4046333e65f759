"""Subject areas of documents (problem 8), by a calibrated classifier chain.

A chain of logistic models over term, source and structure features is fitted on a
bounded sample of the hand-given labels. Each link also sees the areas decided before
it, which models their co-occurrence; its logits are calibrated on folds it wasn't
fitted on. Beam search decodes the most probable combination of areas.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.session import cut_lineage, spread

MAX_LABELLED = 8_000
LEAST_SCORE = 1.0
MAX_AREAS = 500
BEAM = 8
FOLDS = 3
BLOCK = 512
SURE = 2.5
_TERM = re.compile("[a-z\u00df-\u024f\u0370-\u04ff]{3,}|[\u30a0-\u30ff]{2,}|[\u4e00-\u9fff]{2,}")
_HEADING = re.compile(r"(?m)^\s*(?:==.*==|<\w+>|\u3010.*\u3011|\w+:?)\s*$")
_CLAIM = re.compile(r"(?mi)^\s*(?:claim\s+)?\d+\s*[.):\uff0e]")
STRUCTURE = 6


def structure(text: str) -> list[float]:
    """Length, lines, headings, numbered lines, share of digits and of wide characters."""
    n = max(1, len(text))
    wide = sum(map(text.count, "\u306e\u3092\u306b\u306f\u304c"))
    return [np.log1p(n) / 10, np.log1p(text.count("\n")) / 5, len(_HEADING.findall(text)) / 10, len(_CLAIM.findall(text)) / 20, min(1.0, sum(map(text.count, "0123456789")) * 10 / n), min(1.0, wide * 5 / n)]


def terms(text: str) -> list[str]:
    """Terms of a text, in order, with repeats."""
    return _TERM.findall(text.lower())


def source_name(value: str | None) -> str:
    """Source without case and surrounding blanks; empty if null."""
    return (value or "").strip().lower()


@dataclass
class Chain:
    """Fitted chain. ``weights`` (features, areas), ``links`` (areas, areas) from earlier to later areas."""

    areas: list[str]
    index: dict[str, int]
    sources: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    links: np.ndarray
    slope: np.ndarray
    offset: np.ndarray

    def features(self, texts: list[str], sources: list[str | None]) -> np.ndarray:
        """Feature rows."""
        found = [terms(t) for t in texts]
        counts = np.array([len(f) for f in found])
        get = self.index.get
        flat = np.fromiter((get(w, -1) for f in found for w in f), np.int64, int(counts.sum()))
        row, seen = np.repeat(np.arange(len(texts)), counts)[flat >= 0], flat[flat >= 0]
        return feature_rows(row, seen, np.ones(len(seen)), len(texts), len(self.index), [structure(t) for t in texts], [self.sources.get(source_name(s), -1) for s in sources], len(self.sources))

    def decode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The most probable combination of each row that the beam finds, as booleans."""
        base = x @ self.weights + self.bias
        n, k = base.shape
        score = np.zeros((n, 1))
        taken = np.zeros((n, 1, k), np.float32)
        for j in range(k):
            logit = self.slope[j] * (base[:, j, None] + taken @ self.links[:, j]) + self.offset[j]
            yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
            both = np.concatenate([score + no, score + yes], axis=1)
            width = both.shape[1]
            keep = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            score = np.take_along_axis(both, keep, 1)
            parent = keep % (width // 2)
            taken = np.take_along_axis(taken, parent[:, :, None], 1)
            taken[:, :, j] = keep >= width // 2
        best = taken[:, 0, :].copy()
        none = np.flatnonzero(~best.any(axis=1))
        if k and score.shape[1] > 1:
            best[none] = taken[none, 1, :]  # a document is about something: the next best, which isn't empty
        return best > 0


def feature_rows(row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, n_terms: int, shape: list[list[float]], source: list[int], n_sources: int) -> np.ndarray:
    """Logarithms of term counts, then source marks and structure.

    Counts aren't scaled to the text's length: a second area must not weaken the first.
    """
    counts = np.log1p(np.bincount(row * n_terms + term, weights=count, minlength=n * n_terms).reshape(n, n_terms).astype(np.float32))
    marks = np.zeros((n, n_sources), np.float32)
    at = np.array(source, np.int64).reshape(-1)
    if n_sources:
        marks[np.flatnonzero(at >= 0), at[at >= 0]] = 0.2
    return np.hstack([counts, marks, np.array(shape, np.float32).reshape(n, STRUCTURE)]).astype(np.float32)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 150, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links at once: each sees the true earlier areas. Adam on the ridge-penalised log loss."""
    n, k = y.shape
    mask = np.triu(np.ones((k, k), np.float32), 1)
    mean = y.sum(0) / max(1, n)
    p = [np.zeros((x.shape[1], k), np.float32), np.log((mean + 1e-3) / (1 - mean + 1e-3)).astype(np.float32), np.zeros((k, k), np.float32)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        z = x @ p[0] + p[1] + y @ (p[2] * mask)
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / max(1, n)
        g = [x.T @ r + ridge * p[0] / 10, r.sum(0), (y.T @ r) * mask + ridge * p[2]]
        step = rate * (1 - t / (steps + 1))
        for i in range(3):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.99 * v[i] + 0.01 * g[i] ** 2
            p[i] -= step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return p[0], p[1], p[2] * mask


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of held-out logits (guarded Newton steps on smoothed targets)."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(a: float, b: float) -> float:
        v = a * z + b
        return float((np.logaddexp(0, v) - t * v).sum() + 0.5 * ((a - 1) ** 2 + b * b))

    a, b = 1.0, 0.0
    best = loss(a, b)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = q * (1 - q)
        ga, gb = ((q - t) * z).sum() + (a - 1), (q - t).sum() + b
        haa, hab, hbb = (w * z * z).sum() + 1, (w * z).sum(), w.sum() + 1
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = 1.0
        while step > 1e-4 and loss(a - step * da, b - step * db) > best:
            step /= 2
        if step <= 1e-4:
            break
        a, b = a - step * da, b - step * db
        best = loss(a, b)
    return (a, b) if a > 0.05 else (1.0, 0.0)


@dataclass
class Sample:
    """Labelled documents: which of the chosen terms each holds how often, its structure, source and areas."""

    row: np.ndarray
    term: np.ndarray
    count: np.ndarray
    shape: list[list[float]]
    sources: list[str]
    labels: list[set[str]]


def fit_chain(sample: Sample, names: list[str], areas: list[str]) -> Chain:
    """Chain from a sample over the terms ``names``; ``areas`` come in the order of the chain.

    Hand-given labels are partly wrong or incomplete: where the held-out prediction
    is sure of the opposite (odds of 12 to 1), it replaces the label before the last fit.
    """
    n = len(sample.labels)
    y = np.array([[a in s for a in areas] for s in sample.labels], np.float32).reshape(n, len(areas))
    known = {s: i for i, s in enumerate(sorted(s for s, c in Counter(sample.sources).items() if s and c >= 5))}
    x = feature_rows(sample.row, sample.term, sample.count, n, len(names), sample.shape, [known.get(s, -1) for s in sample.sources], len(known))
    index = {name: i for i, name in enumerate(names)}
    fold = np.arange(n) % FOLDS

    def held_out(target: np.ndarray) -> np.ndarray:
        out = np.zeros_like(y)
        for f in range(FOLDS):
            if (fold != f).any() and (fold == f).any():
                w, b, u = _fit(x[fold != f], target[fold != f])
                out[fold == f] = x[fold == f] @ w + b + target[fold == f] @ u
        return out

    def calibrated(z: np.ndarray, target: np.ndarray) -> list[tuple[float, float]]:
        return [_calibrate(z[:, j].astype(np.float64), target[:, j]) for j in range(len(areas))]

    first = held_out(y)
    odds = np.stack([a * first[:, j] + b for j, (a, b) in enumerate(calibrated(first, y))], 1) if len(areas) else first
    y = np.where(odds > SURE, 1, np.where(odds < -SURE, 0, y)).astype(np.float32)
    fits = calibrated(held_out(y), y)
    w, b, u = _fit(x, y)
    return Chain(areas, index, known, w, b, u, np.array([f[0] for f in fits]), np.array([f[1] for f in fits]))


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([source_name(s) for s in batch.column("source").to_pylist()], pa.string()), pa.array([terms(t) for t in texts], pa.list_(pa.string())), pa.array([structure(t) for t in texts], pa.list_(pa.float64()))],
            names=["doc_id", "source", "terms", "shape"],
        )


def _counted(chosen: list[str]):
    """Lists of terms as places in ``chosen`` with how often each occurs."""
    index = {name: i for i, name in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(index[w] for w in words if w in index) for words in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("place", "source", "shape", "areas")] + [pa.array([list(f.keys()) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))],
                names=["place", "source", "shape", "areas", "terms", "counts"],
            )

    return run


def train(documents: DataFrame, labels: DataFrame, areas: DataFrame, max_labelled: int = MAX_LABELLED, least_score: float = LEAST_SCORE) -> Chain:
    """Chain fitted on at most about ``max_labelled`` labelled documents, drawn by a hash of their id.

    Labels repeated by several labellers count once; labels of unknown areas or documents, and null ones, are ignored.
    Each area's name and scope note count as a document of that area. The features are all terms of at least two of these
    documents that are distributed over some area otherwise than by chance (squared deviation over expectation of at least
    ``least_score``), and all sources of at least five.

    Scale: terms are counted and chosen on the executors; the chosen terms, and how often each labelled document has
    them, go to the driver. That is bounded by ``max_labelled``, whatever the number of documents.
    """
    spark = documents.sparkSession
    notes = {r["area"]: r["scope_note"] for r in areas.where("area IS NOT NULL").select("area", "scope_note").limit(MAX_AREAS + 1).collect()}
    if len(notes) > MAX_AREAS:
        raise ValueError("the list of areas is not a small closed list")
    by_document = labels.where("doc_id IS NOT NULL").where(F.col("area").isin(list(notes))).groupBy("doc_id").agg(F.array_sort(F.collect_set("area")).alias("areas"))
    share = min(1.0, max_labelled / max(1, labels.select(F.count_distinct("doc_id")).first()[0]))
    drawn = by_document.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2**31)) / F.lit(float(2**31)) < share)
    last = documents.select("doc_id", "source", "text").join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi")
    texts = last.groupBy("doc_id").agg(F.max(F.struct("text", "source")).alias("r")).select("doc_id", "r.source", "r.text")
    known = texts.mapInArrow(_term_lists, "doc_id long, source string, terms array<string>, shape array<double>").join(F.broadcast(drawn), "doc_id")
    place = F.xxhash64(F.lit(9), "doc_id")
    noted = [(2**63 - 1, "", terms(f"{a} {notes[a] or ''}"), list(map(float, structure(notes[a] or ""))), [a]) for a in notes]
    extra = spark.createDataFrame(noted, "place long, source string, terms array<string>, shape array<double>, areas array<string>")
    lists = cut_lineage(known.select(place.alias("place"), "source", "terms", "shape", "areas").unionByName(extra))

    has = {a: F.count_if(F.array_contains("areas", a)) for a in notes}
    sums = lists.agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"a{i}") for i, c in enumerate(has.values())]).first()
    total = max(1, sums["n"])
    scored = lists.select("areas", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), *[c.alias(f"a{i}") for i, c in enumerate(has.values())])
    chance = [F.col("df") * F.lit(sums[f"a{i}"] / total) for i in range(len(has))]
    away = [(F.col(f"a{i}") - e) ** 2 / (e + 1) for i, e in enumerate(chance)]
    score = F.greatest(F.lit(0.0), F.lit(0.0), *away)
    chosen = [r["term"] for r in scored.where((F.col("df") >= (2 if total > 40 else 1)) & (score >= least_score)).select("term").orderBy("term").collect()]

    rows = lists.mapInArrow(_counted(chosen), "place long, source string, shape array<double>, areas array<string>, terms array<int>, counts array<int>").toArrow()
    order = np.lexsort((np.array([",".join(a) for a in rows.column("areas").to_pylist()]), rows.column("place").to_numpy())) if rows.num_rows else np.zeros(0, np.int64)
    rows = rows.take(pa.array(order)).combine_chunks()
    column = lambda name: rows.column(name).combine_chunks()
    flat = lambda name: np.asarray(column(name).flatten().to_numpy(zero_copy_only=False), np.int64)
    lengths = column("terms").value_lengths().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int64)
    sample = Sample(np.repeat(np.arange(rows.num_rows), lengths), flat("terms"), flat("counts"), column("shape").to_pylist(), column("source").to_pylist(), [set(a) for a in column("areas").to_pylist()])
    frequency = {a: sums[f"a{i}"] for i, a in enumerate(has)}
    return fit_chain(sample, chosen, sorted(notes, key=lambda a: (-frequency[a], a)))


def assign_areas(documents: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, area) of every area that a document is about, from its whole text.

    Null texts and those of white space have none; a document without any known term may have
    none. Rows with the same doc_id give their areas once each. Scale: one narrow Arrow pass;
    the chain (its terms by the number of areas) is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.areas, object)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                texts = part.column("text").to_pylist()
                real = [i for i, t in enumerate(texts) if t and not t.isspace()]
                if not real:
                    continue
                source = part.column("source").to_pylist()
                found = model.decode(model.features([texts[i] for i in real], [source[i] for i in real]))
                row, area = np.nonzero(found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(np.array(real, np.int64)[row])), pa.array(names[area].tolist(), pa.string())], names=["doc_id", "area"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")).mapInArrow(run, "doc_id long, area string")
