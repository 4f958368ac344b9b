"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed by source, language and topic.  Weights a(source) * b(language)
* c(topic) are raked until the weighted tokens meet all three target marginals.
A source's row holds its tokens by (language, topic), so fitting a(source) is
local to a row and an iteration is one aggregation over source rows that
returns languages x topics sums; sources may be any number.  Then every
document is kept with probability min(1, scale * weight).  The scale is the
largest for which cells that ask for more than 1 hold at most ``slack`` of the
target mass (or less, for a token budget): these rare cells are kept whole, so a
tiny source can't dictate how much of all others is kept, and the kept tokens
meet the targets in expectation but for that share.  With a slack of 0 no
probability passes 1.

Every language, topic and source has a factor of its own, however many there
are; the factors are tables that cells and documents are joined with.  The driver
holds the languages, the topics and the tokens of the pairs of them that occur.
Target shares default to the observed shares to the power ``alpha``, scaled to
sum 1; given targets are dicts of shares (languages, topics) or a DataFrame
(source, share).

Defined cases: a null source, language or text reads as ``unknown``, ``und``
and empty; a text without words has 0 tokens and its source's, language's and
topic's weight; a source whose tokens are all 0 has weight 1 before the common factors; a share for a
level that has no tokens is dropped and the rest scaled; repeated rows get equal draws;
an empty table gives an empty result; extra columns stay in ``sample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, unpacked

#: Target mass in cells that may be kept whole though they ask for more; steps of a factor of 2 for finding them.
SLACK, STEPS = 0.01, 256
#: Levels (sources, languages, topics) whose factors are sent to every task; beyond it they are joined by a shuffle.
BROADCAST_LEVELS = 200_000
_ROOM = float(2**52)


def tokens_of(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def genre(text: Column, tokens: Column) -> Column:
    """A topic by form, for tables that have no topic column."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("licen") | low.contains("copyright"), "legal")
        .when(low.contains("@") | low.contains("://"), "contact")
        .when(tokens < 150, "short").when(tokens < 1000, "medium").otherwise("long")
    )


def _prepared(documents: DataFrame, topic: Column | None) -> dict[str, Column]:
    """Tokens, source, language and topic of a document."""
    n = tokens_of(F.col("text"))
    return {
        "tokens": n, "source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("und")),
        "topic": F.coalesce((genre(F.col("text"), n) if topic is None else topic).cast("string"), F.lit("none")),
    }


def _shares(observed: dict[str, float], target: dict[str, float] | None, alpha: float) -> list[float]:
    raw = [(observed[k] ** alpha if observed[k] > 0 else 0.0) if target is None else (target.get(k, 0.0) if observed[k] > 0 else 0.0) for k in observed]
    total = sum(raw)
    if total <= 0:
        return [1.0 / max(1, len(raw))] * len(raw)
    return [x / total for x in raw]


class Calibration:
    """Factors of sources, languages and topics (DataFrames: level, factor), how many there are of each, and the scale."""

    def __init__(self, factors: dict[str, DataFrame], sizes: dict[str, int], scale: float, iterations: int, gap: float):
        self.factors, self.sizes, self.scale, self.iterations, self.gap = factors, sizes, scale, iterations, gap


def _levels(cells: DataFrame, of: str) -> dict[str, float]:
    """Tokens by level, in the order of names."""
    return {r[0]: r[1] for r in cells.groupBy(of).agg(F.sum("n").alias("n")).orderBy(of).collect()}


def _known(df: DataFrame, table: DataFrame, size: int, of: str, name: str) -> DataFrame:
    """``df`` with what ``table`` (level, value) says about the level in its column ``of``, as ``name``."""
    table = table.toDF(of, name)
    return df.join(F.broadcast(table) if size <= BROADCAST_LEVELS else table, of)


def rake(documents: DataFrame, alpha: float = 0.7, langs: dict | None = None, topics: dict | None = None, sources: DataFrame | None = None, topic: Column | None = None, budget_tokens: float | None = None, tolerance: float = 1e-7, max_iterations: int = 60, slack: float = SLACK) -> Calibration:
    spark = documents.sparkSession
    cells = documents.select(*[c.alias(n) for n, c in _prepared(documents, topic).items()]).groupBy("source", "lang", "topic").agg(F.sum("tokens").cast("double").alias("n"))
    cells = materialize(cells)
    levels = [_levels(cells, c) for c in ("lang", "topic")]
    names = [list(x) for x in levels]
    total = sum(levels[0].values())
    if not names[0]:
        return Calibration({}, {}, 1.0, 0, 0.0)
    goal_l, goal_t = ([s * total for s in _shares(x, t, alpha)] for x, t in zip(levels, (langs, topics)))
    # a row for each source: its tokens by (language, topic), only those that it has
    numbers = [spark.createDataFrame(list(zip(x, range(len(x)))), "level string, at int") for x in names]
    placed = _known(_known(cells, numbers[0], len(names[0]), "lang", "l"), numbers[1], len(names[1]), "topic", "t")
    rows = placed.groupBy("source").agg(F.collect_list(F.struct("l", "t", "n")).alias("v"), F.sum("n").alias("t"))
    if sources is None:
        rows = rows.withColumn("g", F.when(F.col("t") > 0, F.pow("t", F.lit(alpha))).otherwise(0.0))
    else:
        given = sources.select(F.col("source"), F.col("share").cast("double").alias("share"))
        rows = rows.join(given, "source", "left").withColumn("g", F.when(F.col("t") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0)).drop("share")
    rows = materialize(rows.select("source", "g", F.array_sort("v").alias("v")))
    whole, n_sources = rows.agg(F.sum("g"), F.count(F.lit(1))).first()
    b, c = [1.0] * len(names[0]), [1.0] * len(names[1])

    def with_factors(df: DataFrame) -> DataFrame:
        """The factors of languages and topics as two arrays: one packed row goes to every task."""
        return df.crossJoin(F.broadcast(spark.createDataFrame([(b, c)], "b array<double>, c array<double>")))

    def cell_factor(x: Column) -> Column:
        return F.get(F.col("b"), x["l"]) * F.get(F.col("c"), x["t"])

    own = F.aggregate("v", F.lit(0.0), lambda s, x: s + x["n"] * cell_factor(x))
    factor = F.when(own > 0, F.col("g") / F.lit(whole or 1.0) * F.lit(total) / own).otherwise(F.lit(1.0))

    done, gap = 0, 0.0
    for done in range(1, max_iterations + 1):
        # a sum for each pair of a language and a topic that occurs
        got = with_factors(rows).select(factor.alias("a"), F.explode("v").alias("x")).groupBy("x.l", "x.t").agg(F.sum(F.col("a") * F.col("x.n")).alias("n")).collect()
        sums = {(r["l"], r["t"]): r["n"] * b[r["l"]] * c[r["t"]] for r in got}
        gap = 0.0
        for k, (factors, goals) in enumerate(((b, goal_l), (c, goal_t))):
            seen = [0.0] * len(goals)
            for place, n in sums.items():
                seen[place[k]] += n
            by = [g / s if s > 0 else 1.0 for g, s in zip(goals, seen)]
            gap = max([gap, *(abs(x - 1) for x, g in zip(by, goals) if g > 0)])
            for i, x in enumerate(by):
                factors[i] *= x
            sums = {place: n * by[place[k]] for place, n in sums.items()}
        if gap < tolerance:
            break
    fitted = materialize(with_factors(rows).select("source", factor.alias("factor"), F.transform("v", lambda x: F.struct(x["n"].alias("n"), cell_factor(x).alias("w"))).alias("v")))
    weights = fitted.select("factor", F.explode("v").alias("x")).select((F.col("factor") * F.col("x.w")).alias("w"), F.col("x.n").alias("n")).where("n > 0 and w > 0")
    # mass by steps of the weight's logarithm, from the largest down: a bounded number of rows
    steps = weights.groupBy(F.floor(F.log2("w") * STEPS).alias("k")).agg(F.sum(F.col("w") * F.col("n")).alias("mass"), F.max("w").alias("w")).orderBy(F.desc("k")).collect()
    most, mass = steps[0]["w"] if steps else 0.0, 0.0
    for r in steps:
        most, mass = r["w"], mass + r["mass"]
        if mass > slack * total:
            break
    scale = 1.0 / most if most else 1.0
    if budget_tokens is not None and total:
        scale = min(scale, budget_tokens / total)
    factors = {k: spark.createDataFrame(list(zip(x, f)), "level string, factor double") for k, x, f in (("lang", names[0], b), ("topic", names[1], c))}
    return Calibration({"source": fitted.select("source", "factor"), **factors}, {"source": n_sources, "lang": len(names[0]), "topic": len(names[1])}, scale, done, gap)


def weigh(documents: DataFrame, c: Calibration, topic: Column | None = None, seed: int = 17) -> DataFrame:
    """row (all columns of the table), tokens, source, lang, topic, weight, probability and kept."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(2**52)) / F.lit(_ROOM)
    docs = packed(documents, **_prepared(documents, topic), draw=draw)
    if not c.factors:
        return docs.withColumns({"weight": F.lit(1.0), "probability": F.lit(1.0), "kept": F.lit(True)}).drop("draw")
    for of, table in c.factors.items():
        docs = _known(docs, table, c.sizes[of], of, f"of_{of}")
    docs = docs.withColumn("weight", F.col("of_source") * F.col("of_lang") * F.col("of_topic"))
    docs = docs.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(c.scale)))
    return docs.select("row", "tokens", "source", "lang", "topic", "weight", "probability", (F.col("draw") < F.col("probability")).alias("kept"))


def mix(documents: DataFrame, **how) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and kept of every row."""
    w = weigh(documents, rake(documents, **how), how.get("topic"))
    return w.select(F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", F.col("tokens").alias("n_tokens"), "weight", "probability", "kept")


def sample(documents: DataFrame, **how) -> DataFrame:
    """The kept rows, all columns."""
    return unpacked(weigh(documents, rake(documents, **how), how.get("topic")).where("kept"))
