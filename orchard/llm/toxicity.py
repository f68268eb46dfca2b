"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes
log-count ratios.

Features are the presence of hashed character n-grams (``ORDERS``) of the
lower-cased text with runs of white space as one space.  Over all labelled
rows outside the held-out part, the number of texts of each class that have a
feature gives its log-count ratio r, taken as 0 where the classes' shares
differ by less than ``LEAST_Z`` standard errors: among millions of ratios
smaller differences are chance.  That bound is no tuned value: it follows from
the number of ratios and the error allowed over all of them (``FAMILY_ERROR``).  Only the other features leave the cluster.  A text's features are r where present.
A logistic regression on these scaled features gives the score.

The ratios cover all labelled training rows; the regression is fitted on a
sample of about ``fit_rows`` of them for each class, a documented bound,
weighted back to the classes' shares, in one task (its size is bounded by
``fit_rows`` texts).  Labels, language, source and id are never features.

Defined cases: null and empty texts have no feature and get the score of the
intercept; without training rows of both classes the score is the share of
label 1 (0.5 without any); several labels of one id: the largest; null labels
do not count; rows that repeat an id are scored one by one; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.llm.common import broadcast_if_small, held_out, mix64
from orchard.session import cut_lineage

ORDERS = (3, 4, 5, 6)
BITS = 22
SIZE = 1 << BITS
SMOOTHING = 1.0
#: Chance that any of the SIZE ratios counts although the classes do not differ;
#: the least difference in standard errors follows from it (5.97).
FAMILY_ERROR = 0.01
LEAST_Z = NormalDist().inv_cdf(1 - FAMILY_ERROR / (2 * SIZE))
RIDGE = 1e-4
STEPS = 200
THRESHOLD = 0.3
_SPACE = re.compile(r"\s+")


def _hashes(text: str | None) -> np.ndarray:
    """Feature numbers of a text, repeats included."""
    s = " " + _SPACE.sub(" ", (text or "").lower()).strip() + " "
    c = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
    found = [np.zeros(0, np.int32)]
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n or len(s) <= 2:
            break
        h = h[:len(c) - n + 1] * np.uint64(0x5851F42D4C957F2D) + c[n - 1:] + np.uint64(1)
        if n in ORDERS:
            found.append((mix64(h) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    return np.unique(_hashes(text))


class Vocabulary:
    """The features that count, as sorted numbers; only these are shipped, a
    worker builds its lookup table once."""

    def __init__(self, kept: np.ndarray):
        self.kept, self._at = kept.astype(np.int32), None

    def __getstate__(self):
        return {"kept": self.kept, "_at": None}

    def positions(self, text: str | None) -> np.ndarray:
        """Sorted distinct positions in ``kept`` of the features of a text."""
        if self._at is None:
            self._at = np.full(SIZE, -1, np.int32)
            self._at[self.kept] = np.arange(len(self.kept), dtype=np.int32)
        at = self._at[_hashes(text)]
        return np.unique(at[at >= 0])


class ToxicityModel:
    """Weight of each feature that counts (ratio and coefficient multiplied)
    and intercept."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, intercept: float):
        self.vocabulary, self.weights, self.intercept = vocabulary, weights, intercept

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[self.vocabulary.positions(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _class_counts(rows: DataFrame, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features whose class shares differ by LEAST_Z standard errors or more,
    sorted, and their texts of each class.  texts: texts of each class."""

    def part(batches):
        count = np.zeros((2, SIZE), np.int32)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                count[label, features(text.as_py())] += 1
        at = np.flatnonzero(count.any(0))
        for first in range(0, len(at), 1 << 16):
            a = at[first:first + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.astype(np.int32)), pa.array(count[0, a].astype(np.int64)),
                 pa.array(count[1, a].astype(np.int64))], names=["feature", "n0", "n1"])

    t0, t1 = (F.lit(float(t)) for t in texts)
    common = (F.col("n0") + F.col("n1")) / (t0 + t1)
    error = F.sqrt(common * (1 - common) * (1 / t0 + 1 / t1))
    sums = rows.select("label", "text").mapInArrow(part, "feature int, n0 long, n1 long").groupBy("feature").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # the features within chance stay in the cluster
    kept = sums.where(F.abs(F.col("n1") / t1 - F.col("n0") / t0) >= LEAST_Z * F.greatest(error, F.lit(1e-12))
                      ).toPandas().sort_values("feature")
    return kept["feature"].to_numpy(), kept[["n0", "n1"]].to_numpy(float).T


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray,
                 ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients on ratio-scaled presence features by Adam on the whole
    sample; returns (ratio x coefficient, intercept)."""
    ends = np.cumsum([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    flat = np.concatenate(rows)
    x = ratio[flat].astype(np.float32)
    beta, b = np.full(len(ratio), 0.02), float(np.log((weights * labels).sum() / (weights * (1 - labels)).sum()))
    m, v, mb, vb = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    weights = weights / weights.sum()
    for step in range(1, STEPS + 1):
        sums = np.concatenate([[0.0], np.cumsum(x * beta[flat])])
        z = sums[ends] - sums[ends - np.diff(np.concatenate([[0], ends]))] + b
        error = weights * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels)
        g = np.bincount(flat, error[row] * x, len(ratio)) + RIDGE * beta
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
        beta -= rate * m / (np.sqrt(v) + 1e-9)
        b -= rate * mb / (np.sqrt(vb) + 1e-9)
    return ratio * beta, b


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000) -> ToxicityModel:
    """A model of ``labels.toxic``, from rows that are not held out."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("label")).where("label in (0, 1)")
    marks = cut_lineage(marks)
    rows = docs.where(~held_out()).select("doc_id", "text").join(broadcast_if_small(marks, 24), "doc_id").select(
        "label", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("lot"))
    texts = np.zeros(2)
    for r in rows.groupBy("label").count().collect():
        texts[r["label"]] = r["count"]
    if texts.min() == 0:
        share = texts[1] / texts.sum() if texts.sum() else 0.5
        return ToxicityModel(Vocabulary(np.zeros(0)), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    kept, count = _class_counts(rows, texts)
    vocabulary = Vocabulary(kept)
    part = (count + SMOOTHING) / (texts[:, None] + 2 * SMOOTHING)
    ratio = np.log(part[1] / part[0])
    rate = np.minimum(1.0, fit_rows / texts)
    sample = rows.where(F.col("lot") < F.when(F.col("label") == 1, F.lit(float(rate[1]))).otherwise(float(rate[0])))

    def extract(batches):
        for batch in batches:
            f = [vocabulary.positions(t.as_py()) for t in batch.column(1)]
            if f:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in f])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(f)))],
                    names=["label", "features"])

    def fit(batches):
        labels, found = [], []
        for batch in batches:
            labels.extend(batch.column(0).to_pylist())
            found.extend(x.values.to_numpy() for x in batch.column(1))
        y = np.array(labels, float)
        beta, b = fit_logistic(found, y, np.where(y == 1, 1 / rate[1], 1 / rate[0]), ratio)
        yield pa.RecordBatch.from_arrays([pa.array([beta.tobytes()]), pa.array([b])], names=["w", "b"])

    # extracted by many tasks and written; the one task that fits reads about 2 x fit_rows feature lists
    extracted = cut_lineage(sample.select("label", "text").mapInArrow(extract, "label int, features array<int>"))
    out = extracted.coalesce(1).mapInArrow(fit, "w binary, b double").first()
    return ToxicityModel(vocabulary, np.frombuffer(out["w"], float).astype(np.float32), out["b"])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""

    def part(batches):
        for batch in batches:
            s = np.array([model.score(t.as_py()) for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()),
                 pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        part, "doc_id long, held_out boolean, score double, predicted int")
