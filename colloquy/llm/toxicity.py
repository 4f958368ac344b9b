"""Toxicity by class-conditional Kneser-Ney models over the letters of expressions.

Each class (toxic, ordinary) has an interpolated Kneser-Ney model of the next
letter given up to ``ORDER - 1`` letters before it, from the start of a word.
Orders of at most ``SHARED_ORDER`` letters are counted over both classes
together, so a rare or unseen expression backs off to shared counts, where the
classes agree and its ratio is 1.  A word's log-likelihood ratio sums over its
letters; a document is judged by the length-normalised ratio of the whole text
and of its strongest expressions, and a logistic curve maps these to 0..1.

Fitting uses at most ``max_rows`` labelled documents of either class, of those
that aren't held out (the bound of the sample); counts come from three
quarters of them and the curve from the rest.  Scoring is one pass over all
documents without a shuffle, whole texts at a time.

Defined cases: a null or empty text, or one without a word, has the features of
no evidence and gets the curve's value there; null labels don't count; repeated
rows get equal scores; an empty table gives an empty result; with labels of one
class only every score is that class's rate, without labels every score is close to 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_sample, fold, kept_rows, logistic_fit, one_text, sigmoid, small_batches, strings

ORDER, SHARED_ORDER = 6, 3
TOP = 3
WORD = re.compile(r"\w+")
FEATURES = ("mean ratio", *(f"strongest {i + 1}" for i in range(TOP)), "log words")


class KneserNeyRatio:
    """log P(word | toxic) - log P(word | ordinary), by letters.

    ``counts`` maps a word to its (ordinary, toxic) counts.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], order: int = ORDER, shared: int = SHARED_ORDER):
        self.order, self.shared = order, shared
        # n-grams of the highest order keep token counts; so do those at the start of a word
        level: dict[int, dict[str, list[float]]] = {k: defaultdict(lambda: [0.0, 0.0]) for k in range(1, order + 1)}
        for word, by in counts.items():
            s = f"\x02{word}\x03"
            for i in range(1, len(s)):
                g = s[max(0, i - order + 1) : i + 1]
                c = level[len(g)][g]
                c[0] += by[0]
                c[1] += by[1]
        # the others count how many letters may stand before them
        for k in range(order, 1, -1):
            for g, by in level[k].items():
                c = level[k - 1][g[1:]]
                for y in (0, 1):
                    c[y] += by[y] > 0
        self.gram: dict[str, float] = {}
        self.context: dict[str, float] = {}
        lower: dict[str, tuple[float, float]] = {}
        floor = 1.0 / (len(level[1]) + 1)
        for k in range(1, order + 1):
            rows = {g: (sum(c), sum(c)) for g, c in level[k].items()} if k <= shared else level[k]
            total: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
            once, twice = [0, 0], [0, 0]
            for g, c in rows.items():
                t = total[g[:-1]]
                for y in (0, 1):
                    t[y] += c[y]
                    t[2 + y] += c[y] > 0
                    once[y] += c[y] == 1
                    twice[y] += c[y] == 2
            d = [max(0.1, min(0.95, once[y] / (once[y] + 2 * twice[y]))) if once[y] else 0.75 for y in (0, 1)]
            here: dict[str, tuple[float, float]] = {}
            for g, c in rows.items():
                t, below = total[g[:-1]], lower.get(g[1:], (floor, floor)) if k > 1 else (floor, floor)
                here[g] = tuple((max(c[y] - d[y], 0.0) + d[y] * t[2 + y] * below[y]) / t[y] if t[y] else below[y] for y in (0, 1))
            if k > shared:
                self.gram.update((g, math.log(p[1] / p[0])) for g, p in here.items())
                self.context.update((h, math.log((d[1] * t[3] / t[1] if t[1] else 1.0) / (d[0] * t[2] / t[0] if t[0] else 1.0))) for h, t in total.items())
            lower = here

    def word(self, word: str) -> float:
        s, total = f"\x02{word}\x03", 0.0
        gram, context, order, shared = self.gram, self.context, self.order, self.shared
        for i in range(shared, len(s)):
            for a in range(max(0, i - order + 1), i - shared + 1):
                r = gram.get(s[a : i + 1])
                if r is not None:
                    total += r
                    break
                total += context.get(s[a:i], 0.0)
        return total


class Ratios(dict):
    """Word -> ratio, remembered; forgets all when it grows large."""

    def __init__(self, model: KneserNeyRatio, limit: int = 300_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        self[word] = out = self.model.word(word)
        return out


def features(text: str, ratios: Ratios) -> list[float]:
    words = WORD.findall(text.lower())
    if not words:
        return [0.0] * (TOP + 2)
    r = np.fromiter(map(ratios.__getitem__, words), np.float64, len(words))
    top = np.sort(np.partition(r, -TOP)[-TOP:] if len(r) > TOP else np.concatenate([r, np.full(TOP - len(r), min(0.0, r.min()))]))[::-1]
    return [r.mean(), *top, math.log1p(len(words))]


class ToxicityModel:
    def __init__(self, ratio: KneserNeyRatio, curve: np.ndarray):
        self.ratio, self.curve = ratio, curve

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.hstack([x, np.ones((len(x), 1))]) @ self.curve)


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 4000) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled rows of either class that aren't held out."""
    spark = documents.sparkSession
    y = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(fold("id") != 0).groupBy("id").agg(F.max("y").alias("y"))
    rows = bounded_sample(y.where("y = 1"), "id", max_rows).unionByName(bounded_sample(y.where("y = 0"), "id", max_rows))
    # the sample is bounded by max_rows, so it may be sent to every scan; of an id with several texts one is learnt
    small_batches(spark)
    docs = one_text(documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "id"), "y")
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(4))

    def tally(batches):
        for b in batches:
            by = (Counter(), Counter())
            for text, y in zip(strings(b["text"]), b["y"].to_pylist()):
                by[y].update(WORD.findall(text.lower()))
            words = list(by[0] | by[1])
            yield pa.RecordBatch.from_pydict({"w": pa.array(words, pa.string()), "n0": pa.array([by[0][w] for w in words], pa.int64()), "n1": pa.array([by[1][w] for w in words], pa.int64())})

    counted = docs.where(part != 0).mapInArrow(tally, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = counted.toArrow()
    counts = {w: (a, b) for w, a, b in zip(*(table[c].to_pylist() for c in ("w", "n0", "n1")))}
    ratio = KneserNeyRatio(counts)
    shared = spark.sparkContext.broadcast(ratio)

    def rate(batches):
        ratios = Ratios(shared.value)
        for b in batches:
            x = [features(t, ratios) for t in strings(b["text"])]
            yield pa.RecordBatch.from_pydict({"y": b["y"], "x": pa.array(x, pa.list_(pa.float64()))})

    seen = docs.where(part == 0).select("y", "text").mapInArrow(rate, "y int, x array<double>").toArrow()
    x, y1 = np.array(seen["x"].to_pylist(), float).reshape(-1, TOP + 2), np.array(seen["y"].to_pylist(), float)
    if len(set(y1)) < 2:
        p = (y1.sum() + 0.5) / (len(y1) + 1) if len(y1) else 1e-6
        return ToxicityModel(ratio, np.array([0.0] * (TOP + 2) + [math.log(p / (1 - p))]))
    # scaled features make the ridge even; the scale is folded into the weights
    mean, std = x.mean(0), x.std(0) + 1e-9
    w = logistic_fit((x - mean) / std, y1, l2=1.0)
    return ToxicityModel(ratio, np.append(w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum()))


def _scores(texts: list[str], model: ToxicityModel, ratios: Ratios) -> np.ndarray:
    return model.score(np.array([features(t, ratios) for t in texts], float).reshape(-1, TOP + 2))


def score(documents: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All columns of ``documents`` and ``toxicity`` (double, 0 to 1), in one pass."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = documents.schema
    out = schema.fieldNames() + ["toxicity"]
    if len(set(out)) < len(out):
        raise ValueError("documents has a column named toxicity; rename or drop it first")

    def rate(batches):
        ratios = Ratios(shared.value.ratio)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_scores(strings(b[text]), shared.value, ratios), pa.float64())], names=out)

    return documents.mapInArrow(rate, StructType([*schema.fields, StructField("toxicity", DoubleType())]))


def classify(documents: DataFrame, labels: DataFrame, max_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``."""
    model = fit(documents, labels, max_rows)
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 4000) -> DataFrame:
    """The rows of ``documents``, all columns, whose score is under ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, max_rows))

    def ordinary():
        ratios = Ratios(shared.value.ratio)
        return lambda texts: (_scores(texts, shared.value, ratios) < threshold).tolist()

    return kept_rows(documents, ordinary)
