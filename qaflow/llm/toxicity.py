"""Toxicity as ordinal regression with cumulative links.

Features are the words of a text (lower case, letters and digits) and their first 4 to 6 letters, present or not; the ``FEATURES`` words whose
presence tells most about the label (G-squared over the training rows) are kept. One weight vector is shared by all
thresholds: ``P(grade <= k) = sigmoid(threshold_k - w.x)``, fitted by damped Newton steps with an L2 penalty. The
expected severity is the sum over ``k`` of ``P(grade > k)``.

Grades are the labels' ``severity`` column if there is one. Binary labels give grade 0, and split the toxic rows by the
number of distinct words they hold that stand in toxic rows only: up to the median grade 1, above it grade 2.

The classifier is fitted on at most ``SAMPLE`` labelled documents (those of smallest id hash, so the choice does not
depend on layout), counted by Spark; at most ``FEATURES`` words and ``SAMPLE`` short rows reach the driver. Scoring is
one map-only pass over whole texts.

Defined cases: null and empty texts have no words and get the score of none; labels that are null, contradict each
other (the larger grade holds) or name no document are tolerated; without a toxic training row nothing is toxic;
repeated rows are scored alike; a null ``doc_id`` is passed through; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import or_empty, small_batches

SAMPLE, FEATURES, MIN_ROWS, PENALTY = 20_000, 512, 3, 0.05
PREFIXES = (4, 5, 6)  # inflected and compound forms share these
WORD = re.compile(r"[^\W_]+")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class OrdinalModel:
    """``words`` with their ``weights``, and ascending ``thresholds``."""

    def __init__(self, words: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = dict(zip(words, map(float, weights), strict=True)), thresholds

    def grades(self, text: str | None) -> np.ndarray:
        """``P(grade > k)`` for each threshold."""
        words = set(WORD.findall((text or "").lower()))
        words.update([w[:k] + "*" for w in words for k in PREFIXES if len(w) > k])
        score = sum(sorted(self.weights[w] for w in words & self.weights.keys()))
        return _sigmoid(score - self.thresholds)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, penalty: float = PENALTY, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model. Every grade from 0 to the largest must occur."""
    top, n = int(grade.max()), len(grade)
    share = np.array([(grade <= k).mean() for k in range(top)])
    p = np.concatenate([np.zeros(x.shape[1]), np.log(share / (1 - share))])
    inf = 1e9

    def parts(p: np.ndarray):
        w, th = p[: x.shape[1]], p[x.shape[1] :]
        s = x @ w
        ext = np.concatenate([[-inf], th, [inf]])
        hi, lo = _sigmoid(ext[grade + 1] - s), _sigmoid(ext[grade] - s)
        hi, lo = np.where(grade == top, 1.0, hi), np.where(grade == 0, 0.0, lo)
        return hi, lo, np.maximum(hi - lo, 1e-12)

    def loss(p: np.ndarray) -> float:
        if (np.diff(p[x.shape[1] :]) <= 0).any():
            return np.inf
        return -np.log(parts(p)[2]).sum() / n + penalty / n * (p[: x.shape[1]] ** 2).sum()

    now = loss(p)
    for _ in range(steps):
        hi, lo, mass = parts(p)
        dh, dl = hi * (1 - hi), lo * (1 - lo)
        # derivatives of -log(mass) by the two ends of the interval; the score shifts both
        gh, gl = -dh / mass, dl / mass
        slope = np.concatenate([x.T @ -(gh + gl), [gh[grade == k].sum() + gl[grade == k + 1].sum() for k in range(top)]]) / n
        slope[: x.shape[1]] += 2 * penalty / n * p[: x.shape[1]]
        # curvature of the cumulative parts (Fisher-like, positive)
        curve = np.maximum(dh + dl, 1e-6)
        hess = np.zeros((len(p), len(p)))
        hess[: x.shape[1], : x.shape[1]] = (x * curve[:, None]).T @ x
        for k in range(top):
            c = np.where(grade == k, dh, 0) + np.where(grade == k + 1, dl, 0)
            hess[x.shape[1] + k, x.shape[1] + k] = c.sum()
            hess[x.shape[1] + k, : x.shape[1]] = hess[: x.shape[1], x.shape[1] + k] = -(x.T @ c)
        hess = hess / n + np.diag(np.concatenate([np.full(x.shape[1], 2 * penalty / n), np.full(top, 1e-6)]))
        step = np.linalg.lstsq(hess, slope, rcond=None)[0]
        size = 1.0
        while size > 1e-6 and not (after := loss(p - size * step)) < now:
            size /= 2
        if size <= 1e-6:
            break
        p, done, now = p - size * step, now - after < 1e-9, after
        if done:
            break
    return p[: x.shape[1]], p[x.shape[1] :]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> OrdinalModel:
    graded = "severity" in labels.columns
    y = F.col("severity" if graded else "toxic").cast("int")
    rows = labels.filter(F.col("doc_id").isNotNull() & y.isNotNull()).groupBy("doc_id").agg(F.max(y).alias("y"))
    # of the labels that name a document: labels of other documents do not use up the sample
    rows = rows.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    words = F.array_distinct(F.regexp_extract_all(F.lower(or_empty()), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    # one row for each id, however often it stands in docs
    some = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "y", words.alias("w"))
    heads = [F.transform(F.filter("w", lambda x, k=k: F.length(x) > k), lambda x, k=k: F.concat(F.substring(x, 1, k), F.lit("*"))) for k in PREFIXES]
    some = some.withColumn("w", F.array_distinct(F.concat("w", *heads))).persist()
    bad = (F.col("y") > 0).cast("int")
    counts = some.select(F.count(F.lit(1)), F.sum(bad)).first()
    n, pos = counts[0], counts[1] or 0
    nothing = OrdinalModel([], np.zeros(0), np.array([35.0, 36.0]))
    if not pos or pos == n:
        some.unpersist()
        return nothing
    df = some.select(bad.alias("b"), F.explode("w").alias("word")).groupBy("word").agg(F.sum("b").alias("a"), F.count(F.lit(1)).alias("d")).filter(F.col("d") >= MIN_ROWS)
    # G-squared of word and label
    a, d = F.col("a").cast("double"), F.col("d").cast("double")
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    g2 = cell(a, d * pos / n) + cell(d - a, d * (n - pos) / n) + cell(pos - a, (n - d) * pos / n) + cell(n - pos - d + a, (n - d) * (n - pos) / n)
    top = df.withColumn("g", F.round(g2, 9)).orderBy(F.desc("g"), "word").limit(features).collect()
    keys = [r["word"] for r in top]
    only = [r["word"] for r in top if r["a"] == r["d"]]
    got = some.select("doc_id", "y", F.array_intersect("w", F.lit(keys)).alias("w")).collect()
    some.unpersist()
    at = {w: i for i, w in enumerate(keys)}
    x, grade = np.zeros((len(got), len(keys))), np.array([r["y"] for r in got])
    for i, r in enumerate(sorted(got, key=lambda r: (r["doc_id"], r["w"]))):
        x[i, [at[w] for w in r["w"]]] = 1
        grade[i] = r["y"]
    if not graded:
        hits = x[:, [at[w] for w in only]].sum(1) if only else np.zeros(len(got))
        grade = np.where(grade > 0, 1 + (hits > np.median(hits[grade > 0])), 0)
    grade = np.unique(grade, return_inverse=True)[1]
    if grade.max() == 0:
        return nothing
    return OrdinalModel(keys, *fit_ordinal(x, grade))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, p_toxic, expected_severity, toxic`` of every row."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            above = [m.grades(t.as_py()) for t in batch.column("text")]
            p = [float(a[0]) for a in above]
            extra = [pa.array(p, pa.float64()), pa.array([float(a.sum()) for a in above], pa.float64()), pa.array([v >= 0.5 for v in p], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *extra], names=["doc_id", "p_toxic", "expected_severity", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, p_toxic double, expected_severity double, toxic boolean")


def without_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that are not toxic."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            yield batch.filter(pa.array([bool(m.grades(t.as_py())[0] < 0.5) for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
