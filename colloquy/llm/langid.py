"""Language ID: sparse multinomial logistic regression on TF-IDF letter n-grams.

A text's features are the letter n-grams (1 to 3) of its lower-cased letters,
anything else read as one space, hashed into ``2 ** bits`` buckets, with
sub-linear counts times inverse document frequency, scaled to length 1.  The
document frequencies come from every learnable document.  The weights are
fitted by follow-the-regularised-leader (proximal) with an elastic-net penalty
on at most ``max_rows`` documents, a documented bound; one temperature is then
fitted on a tenth of these that the weights never saw.  Prediction is one pass
over whole texts without a shuffle.

Defined cases: a text that is null, empty or without a letter is ``und`` with
score 0; with no learnable row every text is ``und``; ties go to the label that
sorts first; repeated rows get equal results; extra columns are ignored; an
empty table gives an empty result.  One label learnt: every text with a letter
has that label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, small_batches, strings

BITS = 16
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
OTHERS = regex.compile(r"[^\p{L}\p{M}]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def ngrams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their counts."""
    c = np.frombuffer(f" {OTHERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    shift, parts, h = np.uint64(64 - bits), [], np.zeros(len(c), np.uint64)
    for n in range(3):
        if len(c) <= n:
            break
        # the hash of n + 1 letters that end at each place, from that of the n before
        h = (h[:-1] if n else h) * _MIX[1] + (c[n:] + np.uint64(n + 1)) * _MIX[0]
        h ^= h >> np.uint64(29)
        parts.append((h * _MIX[2]) >> shift)
    counts = np.bincount(np.concatenate(parts).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(counts)) * idf[at]
    return v / (np.linalg.norm(v) + 1e-12)


class FtrlSoftmax:
    """FTRL-proximal per coordinate with L1 and L2 penalties, for several classes."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, v: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = softmax(v @ w)
        g[y] -= 1.0
        g = v[:, None] * g
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class LanguageModel:
    def __init__(self, names: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.names, self.idf, self.weights, self.temperature = names, idf, weights, temperature

    def scores(self, text: str) -> np.ndarray:
        at, counts = ngrams(text)
        return softmax(weigh(at, counts, self.idf).astype(np.float32) @ self.weights[at] / self.temperature)

    def predict(self, text: str) -> tuple[str, float]:
        if not self.names or not LETTER.search(text):
            return UNDETERMINED, 0.0
        p = self.scores(text)
        k = int(p.argmax())
        return self.names[k], float(p[k])


def _frequencies(batches):
    total, rows = np.zeros(1 << BITS, np.int64), 0
    for b in batches:
        for text in strings(b["text"]):
            total[ngrams(text)[0]] += 1
            rows += 1
    yield pa.RecordBatch.from_pydict({"rows": [rows], "df": pa.array([total.tolist()], pa.list_(pa.int64()))})


def fit(documents: DataFrame, max_rows: int = 3000, epochs: int = 3) -> LanguageModel:
    """Learn from text and lang of rows that aren't held out; lang and id are never features."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").alias("id"), "text", "lang").where("lang is not null and text is not null").where(fold("id") != 0)
    # a row for each scan task; summed by place, so one row reaches the driver
    counted = docs.select("text").mapInArrow(_frequencies, "rows long, df array<long>")
    placed = counted.select("rows", F.posexplode("df").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).toArrow()
    df, rows = np.zeros(1 << BITS), 0
    if placed.num_rows:
        df[placed["at"].to_numpy()] = placed["n"].to_numpy()
        rows = placed["rows"][0].as_py()
    idf = np.log((1.0 + rows) / (1.0 + df)) + 1.0

    def featurise(batches):
        for b in batches:
            x = [ngrams(t) for t in strings(b["text"])]
            yield pa.RecordBatch.from_pydict({"id": b["id"], "lang": b["lang"], "at": pa.array([a for a, _ in x], pa.list_(pa.int32())), "n": pa.array([n for _, n in x], pa.list_(pa.int64()))})

    chosen = bounded_sample(docs.select("id", F.xxhash64("text", "lang").alias("h")).distinct(), "id", max_rows)
    seen = docs.join(F.broadcast(chosen), (docs.id == chosen.id) & (F.xxhash64(docs.text, docs.lang) == chosen.h), "left_semi")
    # repetitions are learnt once, so at most max_rows rows are fetched
    got = seen.dropDuplicates(["id", "text", "lang"]).mapInArrow(featurise, "id long, lang string, at array<int>, n array<long>").toArrow()
    if not got.num_rows:
        return LanguageModel([], idf, np.zeros((1 << BITS, 0), np.float32), 1.0)
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    lang = got["lang"].to_pylist()
    names = sorted(set(lang))
    y = np.array([names.index(lang[i]) for i in order])
    x = [(a := np.asarray(got["at"][i].as_py()), weigh(a, np.asarray(got["n"][i].as_py()), idf)) for i in order]
    rng = np.random.default_rng(11)
    shuffled = rng.permutation(len(x))
    apart = shuffled[: len(x) // 10]
    model = FtrlSoftmax(1 << BITS, len(names))
    for _ in range(epochs):
        for i in rng.permutation(shuffled[len(x) // 10 :]):
            model.learn(*x[i], y[i])
    w = model.weights(slice(None))
    temperature = 1.0
    if len(apart):
        s = np.array([x[i][1] @ w[x[i][0]] for i in apart])
        loss = lambda t: -np.log(softmax(s / t)[np.arange(len(apart)), y[apart]] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return LanguageModel(names, idf, w.astype(np.float32), temperature)


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for b in batches:
            out = [shared.value.predict(t) for t in strings(b["text"])]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "lang_pred": pa.array([p for p, _ in out], pa.string()), "score": pa.array([s for _, s in out], pa.float64())})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
