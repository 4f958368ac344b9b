"""Quality by ordinal cumulative-link regression on graded ratings.

Words, the shapes of words and whether they stand alone are hashed into
``2 ** bits`` buckets with one shared weight each; ordered thresholds cut the
sum into grades: P(grade > k) = logistic(w . x - t_k) with t_0 < t_1 < ...
This gives the expected grade and the probability of a grade of at least
``good`` (the tail), by which documents are selected.

The regression is fitted on at most ``max_rows`` labelled documents that aren't
held out (the bound of the sample); scoring is one pass over whole texts
without a shuffle.  Grades are the integers in ``labels.quality``, as many as
there are.

Defined cases: a null or empty text has no features and gets the thresholds'
own grade distribution; null ratings don't count; with fewer than two grades
every tail probability is 1 and the grade is the one known (0 if none); repeated rows get equal
results; extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import TokenIds, bounded_sample, fold, kept_rows, one_text, sigmoid, small_batches, strings

BITS = 17
_UPPER, _LOWER, _DIGIT, _OTHER = re.compile(r"[^\W\d_a-z]+"), re.compile(r"[a-z]+"), re.compile(r"\d+"), re.compile(r"([^\w\s])\1*")


class Buckets(dict):
    """Word -> its buckets: the lower-cased word and its shape."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit, self.ids = limit, TokenIds(BITS)

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= self.limit:
            self.clear()
        shape = _OTHER.sub(r"\1", _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", word)) if word.isascii() else ("X" if word.isupper() else "x") + re.sub(r"\w", "", word)))
        self[word] = out = (self.ids["w:" + word.lower()], self.ids["s:" + shape[:8]])
        return out


def features(text: str, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Shares of words and shapes; each kind has a length of 1."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    pairs = np.array([buckets[w] for w in words])
    ats, values = [], []
    for k in (0, 1):
        at, n = np.unique(pairs[:, k], return_counts=True)
        v = np.sqrt(n)
        ats.append(at)
        values.append(v / np.linalg.norm(v))
    lines = [x for x in text.split("\n") if x.strip()]
    # how much is said again, by lines and by words
    again = (1 - len(set(lines)) / max(1, len(lines)), 1 - len(ats[0]) / len(words))
    own = [buckets.ids[f"again:{k}"] for k in (0, 1)] + [buckets.ids[f"length:{int(np.log2(len(words)))}"]]
    return np.concatenate([*ats, own]), np.concatenate([*values, np.array([*again, 0.5])])


class GradeModel:
    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def beyond(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k but the last."""
        return sigmoid(s[:, None] - self.thresholds[None, :])

    def judge(self, s: np.ndarray, good: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of a grade of at least ``good`` (default: the highest)."""
        if len(self.grades) < 2:
            return np.full(len(s), float(self.grades[0] if self.grades else 0)), np.ones(len(s))
        p = self.beyond(s)
        expected = self.grades[0] + p @ np.diff(self.grades)
        k = sum(g < (self.grades[-1] if good is None else good) for g in self.grades)
        return expected, np.ones(len(s)) if k == 0 else np.zeros(len(s)) if k == len(self.grades) else p[:, k - 1]


def fit_ordinal(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, grades: list[int], bits: int = BITS, epochs: int = 12, rate: float = 0.3, l2: float = 1e-5) -> GradeModel:
    """Adaptive-gradient descent on the cumulative-link loss; thresholds stay ordered as a first one plus positive steps."""
    k = len(grades) - 1
    w, seen = np.zeros(1 << bits), np.full(1 << bits, 1e-2)
    share = np.array([(y > j).mean() for j in range(k)]).clip(0.02, 0.98)
    first = -np.log(share / (1 - share))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    theta_seen = np.full(k, 1e-2)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            at, v = x[i]
            t = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
            s = v @ w[at]
            p = np.concatenate([[1.0], sigmoid(s - t), [0.0]])
            # d log(p_y - p_{y+1}) / ds is 1 - p_y - p_{y+1}
            a, b = p[y[i]], p[y[i] + 1]
            g = -(1.0 - a - b)
            grad = g * v + l2 * w[at]
            seen[at] += grad * grad
            w[at] -= rate * grad / np.sqrt(seen[at])
            dt, mass = np.zeros(k), max(a - b, 1e-9)
            if y[i] > 0:
                dt[y[i] - 1] += a * (1 - a) / mass
            if y[i] < k:
                dt[y[i]] -= b * (1 - b) / mass
            steps = np.concatenate([[dt.sum()], np.exp(theta[1:]) * np.cumsum(dt[::-1])[::-1][1:]])
            theta_seen += steps * steps
            theta -= 0.1 * rate * steps / np.sqrt(theta_seen)
    return GradeModel(grades, w, theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))]))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 4000) -> GradeModel:
    small_batches(documents.sparkSession)
    graded = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y is not null").where(fold("id") != 0).groupBy("id").agg(F.max("y").alias("y"))
    docs = one_text(documents.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(bounded_sample(graded, "id", max_rows)), "id"), "y").select("id", "y", "text")

    def featurise(batches):
        buckets = Buckets()
        for b in batches:
            x = [features(t, buckets) for t in strings(b["text"])]
            yield pa.RecordBatch.from_pydict({"id": b["id"], "y": b["y"], "at": pa.array([a for a, _ in x], pa.list_(pa.int64())), "v": pa.array([v for _, v in x], pa.list_(pa.float64()))})

    got = docs.mapInArrow(featurise, "id long, y int, at array<long>, v array<double>").toArrow()
    grades = sorted(set(got["y"].to_pylist()))
    if len(grades) < 2:
        return GradeModel(grades, np.zeros(1 << BITS), np.zeros(0))
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    x = [(np.asarray(got["at"][i].as_py(), np.int64), np.asarray(got["v"][i].as_py(), float)) for i in order]
    y = np.searchsorted(grades, got["y"].to_numpy()[order])
    return fit_ordinal(x, y, grades)


def grade(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 4000) -> DataFrame:
    """doc_id, expected_grade, tail (probability of the best grade) and kept of every row, in one pass."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, max_rows))

    def rate(batches):
        buckets = Buckets()
        for b in batches:
            expected, tail = judge(strings(b["text"]), shared.value, buckets)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=["doc_id", "expected_grade", "tail"])

    out = documents.select("doc_id", "text").mapInArrow(rate, StructType([documents.schema["doc_id"], StructField("expected_grade", DoubleType()), StructField("tail", DoubleType())]))
    return out.withColumn("kept", F.col("tail") >= threshold)


def judge(texts: list[str], model: GradeModel, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade, and probability of the best grade, of each text."""
    return model.judge(np.array([v @ model.weights[at] for at, v in (features(t, buckets) for t in texts)], float), None)


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 4000) -> DataFrame:
    """The rows, all columns, whose tail probability is at least ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, max_rows))

    def good():
        buckets = Buckets()
        return lambda texts: (judge(texts, shared.value, buckets)[1] >= threshold).tolist()

    return kept_rows(documents, good)
