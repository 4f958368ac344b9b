"""Scores: word and character errors, diarization errors, ROUGE, confusion, tables by condition."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import text as T
from .scans import percentiles

# types as objects: workers import this module, and only a driver can parse their names
ERRORS = StructType([StructField(n, IntegerType()) for n in ("substitutions", "deletions", "insertions", "hits", "reference_length", "hypothesis_length")])


def word_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance of two arrays of words, inside the JVM: a fold over rows of the table."""
    first = F.sequence(F.lit(0), F.size(hyp))

    def row(acc: Column, word: Column) -> Column:
        def cell(r: Column, j: Column) -> Column:
            cost = F.when(F.element_at(hyp, j) == word, 0).otherwise(1)
            diagonal = F.element_at(acc, j) + cost
            return F.concat(r, F.array(F.least(diagonal, F.element_at(acc, j + 1) + 1, F.element_at(r, -1) + 1)))

        return F.aggregate(F.sequence(F.lit(1), F.size(hyp)), F.array(F.element_at(acc, 1) + 1), cell)

    folded = F.aggregate(ref, first, row, lambda acc: F.element_at(acc, -1))
    return F.when(F.size(hyp) == 0, F.size(ref)).otherwise(folded)


#: Cells (words by words) of pairs that are worked side by side; a larger pair is worked by itself, row by row.
SMALL_CELLS = 4096
# a cell in one long, highest bits first: cost, preference among equals, substitutions, deletions, insertions
_COST, _SECOND, _SUB, _DEL, _INS = 1 << 50, 1 << 48, 1 << 32, 1 << 16, 1
_PLAIN = (1 << 63) - 1 - 3 * _SECOND


def _side_by_side(refs: list[list[int]], hyps: list[list[int]]) -> np.ndarray:
    """S, D, I of pairs of word numbers: each cell of the tables is one step for all pairs.

    Cells carry their counts, so no table is kept and nothing traced back; of equal costs a hit or
    substitution comes before a deletion, and that before an insertion.
    """
    n, m = (np.array([len(x) for x in side]) for side in (refs, hyps))
    a, b = (np.full((size.max(initial=0), len(refs)), fill, np.int64) for size, fill in ((n, -1), (m, -2)))
    for k, (x, y) in enumerate(zip(refs, hyps)):
        a[: len(x), k], b[: len(y), k] = x, y
    row = np.repeat(np.arange(len(b) + 1, dtype=np.int64)[:, None] * (_COST + _INS), len(refs), axis=1)
    last = np.where(n == 0, row[m, np.arange(len(refs))], 0)
    for i in range(len(a)):
        new = np.empty_like(row)
        new[0] = row[0] + (_COST + _DEL)
        diagonal = row[:-1] + np.where(b == a[i], 0, _COST + _SUB)
        above = np.minimum(diagonal, row[1:] + (_COST + _DEL + _SECOND))
        for j in range(len(b)):
            new[j + 1] = np.minimum(above[j], new[j] + (_COST + _INS + 2 * _SECOND)) & _PLAIN
        row = new
        done = np.flatnonzero(n == i + 1)
        last[done] = row[m[done], done]
    return np.stack([last >> 32 & 0xFFFF, last >> 16 & 0xFFFF, last & 0xFFFF], axis=1)


def _row_by_row(ref: list[int], hyp: list[int]) -> tuple[int, int, int]:
    """S, D, I of one pair, in space that grows with one text: a row at a time, runs of insertions by a running minimum."""
    b, at = np.array(hyp, np.int64), np.arange(len(hyp) + 1)
    cost, counts = at.copy(), np.zeros((3, len(hyp) + 1), np.int64)
    counts[2] = at
    for w in ref:
        step = (b != w).astype(np.int64)
        diagonal, up = cost[:-1] + step, cost[1:] + 1
        best = np.concatenate([cost[:1] + 1, np.minimum(diagonal, up)])
        by_diagonal = np.concatenate([[False], diagonal <= up])
        from_left = np.concatenate([counts[:, :1], counts[:, :-1]], axis=1)
        new = np.where(by_diagonal, from_left, counts)
        new[0, 1:] += by_diagonal[1:] * step
        new[1] += ~by_diagonal
        # the last cell to the left from which a run of insertions is as cheap as from any
        ahead = best - at
        least = np.minimum.accumulate(ahead)
        source = np.maximum.accumulate(np.where(ahead == least, at, 0))
        cost, counts = best[source] + at - source, new[:, source]
        counts[2] += at - source
    return tuple(int(x) for x in counts[:, -1])


@pandas_udf(ERRORS)
def word_errors(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Substitutions, deletions, insertions, hits; ties go to hit, substitution, deletion, insertion; an empty reference has no errors."""
    ids: dict[str, int] = {}
    pairs = [tuple([ids.setdefault(w, len(ids)) for w in (t or "").split()] for t in pair) for pair in zip(ref, hyp)]
    n, m = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    out = np.zeros((len(pairs), 3), np.int64)
    some = np.flatnonzero(n > 0)
    small = some[n[some] * m[some] <= SMALL_CELLS]
    # pairs of like size together, so that little is padded
    small = small[np.lexsort((m[small], n[small]))]
    for k in range(0, len(small), 512):
        part = small[k : k + 512]
        out[part] = _side_by_side([pairs[i][0] for i in part], [pairs[i][1] for i in part])
    for i in some[n[some] * m[some] > SMALL_CELLS]:
        out[i] = _row_by_row(*pairs[i])
    return pd.DataFrame(dict(zip(ERRORS.fieldNames(), (*out.T, n - out[:, 0] - out[:, 1], n, m)))).astype("int32")


def wer(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", preprocess: bool = True) -> DataFrame:
    """WER, MER, WIL, CER and the counts of each pair; an empty reference scores 1 against words, else 0."""
    a, b = (T.normalize_wer(F.coalesce(F.col(c), F.lit(""))) if preprocess else F.coalesce(F.col(c), F.lit("")) for c in (ref, hyp))
    rows = pairs.withColumns({"__r": a, "__h": b}).withColumn("__e", word_errors("__r", "__h"))
    e = {k: F.col(f"__e.{k}") for k in ("substitutions", "deletions", "insertions", "hits", "reference_length", "hypothesis_length")}
    wrong = e["substitutions"] + e["deletions"] + e["insertions"]
    n, p, h = e["reference_length"], e["hypothesis_length"], e["hits"]
    empty = F.when(p > 0, 1.0).otherwise(0.0)
    letters = F.length("__r")
    return rows.withColumns({
        "wer": F.when(n == 0, empty).otherwise(wrong / n), "mer": F.when(n == 0, empty).otherwise(wrong / (h + wrong)),
        "wil": F.when(n == 0, empty).when(p == 0, 1.0).otherwise(1 - (h / n) * (h / p)),
        "cer": F.when(letters == 0, empty).otherwise(F.levenshtein("__r", "__h") / letters), **e,
    }).drop("__r", "__h", "__e")


def simple_cer(ref: Column, hyp: Column) -> Column:
    """Letters without spaces: edit distance over the reference's length; 0 for an empty reference and hypothesis."""
    a, b = (F.replace(x, F.lit(" "), F.lit("")) for x in (ref, hyp))
    return F.when(F.length(a) == 0, F.when(F.length(b) > 0, 1.0).otherwise(0.0)).otherwise(F.levenshtein(a, b) / F.length(a))


def simple_wer(ref: Column, hyp: Column) -> Column:
    """Words of lower-cased texts: edit distance over the reference's length; without reference words 1 against words, else 0."""
    a, b = (T.words(F.lower(x)) for x in (ref, hyp))
    return F.when(F.size(a) == 0, F.when(F.size(b) > 0, 1.0).otherwise(0.0)).otherwise(word_distance(a, b) / F.size(a))


def zipped(refs: DataFrame, hyps: DataFrame, order: str, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Pairs by ordinal: order, ref, hyp; raises where one side has a row that the other lacks."""
    both = refs.select(order, ref, F.lit(True).alias("__a")).join(hyps.select(order, hyp, F.lit(True).alias("__b")), order, "full")
    whole = F.assert_true(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.lit("references and hypotheses must have the same length"))
    return both.where(whole.isNull()).drop("__a", "__b")


def wide_results(results: DataFrame) -> DataFrame:
    """condition, sample and the fields of the structs wer_result, der_result (either may be null) as columns."""
    fields = lambda c: [f.name for f in results.schema[c].dataType.fields]
    w, d = fields("wer_result"), fields("der_result")
    return results.select(*[c for c in results.columns if c not in ("wer_result", "der_result")], *[F.col(f"wer_result.{c}").alias(c) for c in w], *[F.col(f"der_result.{c}").alias(c if c not in w else f"der_{c}") for c in d])


def component_means(results: DataFrame, by: str = "condition") -> DataFrame:
    """Mean diarization components and summed word errors of each condition."""
    return results.groupBy(by).agg(*[F.avg(c).alias(f"avg_{c}") for c in ("missed_speech", "false_alarm", "speaker_confusion")], *[F.sum(c).alias(f"total_{c}") for c in ("substitutions", "deletions", "insertions")])


def run_totals(runs: DataFrame, ok: Column, seconds: str) -> DataFrame:
    """Files, successes, their share in percent, total and mean time of a batch."""
    n = F.count(F.lit(1))
    return runs.agg(n.alias("files"), F.count_if(ok).alias("ok"), F.when(n > 0, F.count_if(ok) * 100.0 / n).otherwise(0.0).alias("success_rate"), F.sum(seconds).alias("total_time"), F.avg(seconds).alias("avg_time"))


def batch_totals(runs: DataFrame, by: str, ok: Column, amount: str) -> DataFrame:
    """Files, successes, sum and mean of ``amount`` for each value of ``by``."""
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.count_if(ok).alias("ok"), F.sum(amount).alias("total"), F.avg(amount).alias("mean"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """metric, count, mean, std (of a sample), min, quartiles and max of each column, a row a column; nulls don't count.

    The columns become rows of (metric, value), so one pass gives all of them and no buffer holds a column.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("r")).select("r.metric", "r.value")
    moments = long.groupBy("metric").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return moments.join(box_stats(long, "value", "metric"), "metric").select("metric", "count", "mean", "std", "min", "q1", "median", "q3", "max")


def files_per_group(files: DataFrame, by: str, size: str) -> DataFrame:
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("size"))


def epoch_speakers(predictions: DataFrame) -> DataFrame:
    """Of each epoch: share of rows whose predicted speaker is right (over all rows), mean WER and CER, four places."""
    right = F.coalesce((F.col("speaker") == F.col("pred_spk")).cast("double"), F.lit(0.0))
    return predictions.groupBy(F.coalesce(F.col("epoch").cast("string"), F.lit("all")).alias("epoch")).agg(F.round(F.avg(right), 4).alias("speaker_accuracy"), F.round(F.avg("wer"), 4).alias("wer"), F.round(F.avg("cer"), 4).alias("cer"))


def metric_means(rows: DataFrame, metrics: str, names: list[str]) -> DataFrame:
    """Mean of each named entry of a map of metrics; a missing one counts as 0."""
    return rows.agg(*[F.avg(F.coalesce(F.try_element_at(metrics, F.lit(n)), F.lit(0.0))).alias(n) for n in names])


def nested_counts(pairs: DataFrame, ref: str, pred: str) -> DataFrame:
    """ref and a map of pred to its count."""
    return confusion(pairs, ref, pred).groupBy("ref").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pred", "n")))).alias("counts"))


def metadata_lines(metadata: Column) -> Column:
    """``key: value`` lines of a map of strings, sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), "\n")


def wer_totals(scored: DataFrame) -> DataFrame:
    """Micro (all errors over all words) and macro (mean of the pairs) word error rate."""
    wrong, n = F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions")), F.sum("reference_length")
    return scored.agg(F.when(n > 0, wrong / n).otherwise(0.0).alias("micro_wer"), F.avg("wer").alias("macro_wer"), F.stddev_pop("wer").alias("std_wer"), F.min("wer").alias("min_wer"), F.max("wer").alias("max_wer"), F.count(F.lit(1)).alias("pairs"), *[F.sum(c).alias(f"total_{c}") for c in ("substitutions", "deletions", "insertions", "hits")])


def _micros(c: Column) -> Column:
    return F.round(c * 1_000_000).cast("long")


def _spans(ref: DataFrame, hyp: DataFrame, collar: float, meeting: str) -> DataFrame:
    """meeting, t, until (microseconds), r, h: how many speakers of either side are active between neighbouring boundaries.

    References shrink by the collar at both ends.  A speaker's own segments are united first, so the running sums
    count speakers; rows are two for each segment, however long it is.
    """
    from .segments import merge_regions

    def steps(d: DataFrame, shrink: float, r: int, h: int) -> DataFrame:
        cut = d.select(meeting, "speaker_id", _micros(F.col("start") + shrink).alias("start"), _micros(F.col("end") - shrink).alias("end")).where("end > start")
        one = merge_regions(cut, 0, [meeting, "speaker_id"])
        step = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d"))))
        return one.select(meeting, step.alias("s")).select(meeting, F.col("s.t").alias("t"), (F.col("s.d") * r).alias("r"), (F.col("s.d") * h).alias("h"))

    w = Window.partitionBy(meeting).orderBy("t")
    at = steps(ref, collar, 1, 0).unionByName(steps(hyp, 0.0, 0, 1)).groupBy(meeting, "t").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    return at.select(meeting, "t", F.lead("t").over(w).alias("until"), F.sum("r").over(w).alias("r"), F.sum("h").over(w).alias("h")).where("until is not null")


def _der(ref: DataFrame, hyp: DataFrame, spans: DataFrame, seconds: Column, meeting: str) -> DataFrame:
    """Errors of ``seconds`` for each span, over the reference's duration; confusion weighs the share of surplus speakers."""
    r, h = F.col("r"), F.col("h")
    part = lambda c, weight=F.lit(1.0): F.sum(F.when(c, seconds * weight).otherwise(0.0))
    errors = spans.groupBy(meeting).agg(
        part((r > 0) & (h == 0)).alias("m"), part((r == 0) & (h > 0)).alias("f"), part((r > 0) & (h > 0) & (r != h), F.abs(r - h) / F.greatest(r, h)).alias("x"),
    )
    total = ref.groupBy(meeting).agg(F.sum(F.col("end") - F.col("start")).alias("d"), F.countDistinct("speaker_id").alias("nr"))
    heard = hyp.groupBy(meeting).agg(F.countDistinct("speaker_id").alias("nh"))
    every = total.join(heard, meeting, "full").join(errors, meeting, "left")
    d = F.coalesce("d", F.lit(0.0))
    share = lambda c: F.when(d > 0, F.coalesce(c, F.lit(0.0)) / d).otherwise(0.0)
    return every.select(
        meeting, d.alias("total_duration"), share(F.col("m")).alias("missed_speech"), share(F.col("f")).alias("false_alarm"), share(F.col("x")).alias("speaker_confusion"),
        F.least(F.lit(1.0), share(F.coalesce("m", F.lit(0.0)) + F.coalesce("f", F.lit(0.0)) + F.coalesce("x", F.lit(0.0)))).alias("der"),
        F.coalesce("nr", F.lit(0)).alias("num_speakers_ref"), F.coalesce("nh", F.lit(0)).alias("num_speakers_hyp"),
    )


def der_grid(ref: DataFrame, hyp: DataFrame, collar: float = 0.25, frame_ms: int = 10, meeting: str = "meeting_id") -> DataFrame:
    """Diarization error by frames whose middles lie within segments; components are shares of the reference's duration.

    Frames begin at a meeting's first start.  They aren't made: of each span between boundaries the middles are
    counted, so the cost is that of the segments, not of their length.  A meeting without a reference scores 0.
    """
    begins = ref.select(meeting, "start").unionByName(hyp.select(meeting, "start")).groupBy(meeting).agg(_micros(F.min("start")).alias("t0"))
    frame = frame_ms * 1000
    # middles before x: those k >= 0 with t0 + frame k + frame / 2 < x
    before = lambda x: F.greatest(F.ceil((F.col(x) - F.col("t0") - frame / 2) / frame), F.lit(0))
    spans = _spans(ref, hyp, collar, meeting).join(begins, meeting)
    return _der(ref, hyp, spans, (before("until") - before("t")) * (frame_ms / 1000), meeting)


def der_sweep(ref: DataFrame, hyp: DataFrame, collar: float = 0.25, meeting: str = "meeting_id") -> DataFrame:
    """As ``der_grid`` with exact times in place of frames."""
    return _der(ref, hyp, _spans(ref, hyp, collar, meeting), (F.col("until") - F.col("t")) / 1_000_000, meeting)


def der_totals(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean error and mean components, by condition or over all."""
    return scored.groupBy(*(by or [])).agg(*[F.avg(c).alias(f"avg_{c}") for c in ("der", "missed_speech", "false_alarm", "speaker_confusion")], F.count(F.lit(1)).alias("n"))


def _grams(words: pa.ListArray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and words (a column for each) of all n-grams of a side, and how many grams each row has."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, many = np.cumsum(sizes) - sizes, np.maximum(sizes - n + 1, 0)
    row = np.repeat(np.arange(len(sizes)), many)
    place = starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return row, codes[place[:, None] + np.arange(n)], many


def _gram_f1(ref: pa.Array, hyp: pa.Array, n: int) -> pa.Array:
    """Both sides' grams of a batch are numbered together and counted by row and number."""
    a, b = ref.flatten(), hyp.flatten()
    codes = pc.fill_null(pa.concat_arrays([a, b]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    (row_a, gram_a, n_a), (row_b, gram_b, n_b) = _grams(ref, codes[: len(a)], n), _grams(hyp, codes[len(a) :], n)
    number = np.zeros(len(row_a) + len(row_b), np.int64)
    for column in np.concatenate([gram_a, gram_b]).T:
        number = np.unique(number * (len(codes) + 1) + column + 1, return_inverse=True)[1]
    pair = np.concatenate([row_a, row_b]) * (len(number) + 1) + number
    (x, times_x), (y, times_y) = (np.unique(p, return_counts=True) for p in (pair[: len(row_a)], pair[len(row_a) :]))
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = np.bincount(both // (len(number) + 1), np.minimum(times_x[i], times_y[j]), len(n_a))
    return pa.array(np.where((n_a == 0) | (n_b == 0), 0.0, 2.0 * common / np.maximum(n_a + n_b, 1)), pa.float64())


@arrow_udf(DoubleType())
def _rouge_n(ref: pa.Array, hyp: pa.Array, n: pa.Array) -> pa.Array:
    # parts of a batch, so that long texts don't meet in one count
    if not len(ref):
        return pa.array([], pa.float64())
    size = n[0].as_py()
    return pa.concat_arrays([_gram_f1(ref.slice(k, 1024), hyp.slice(k, 1024), size) for k in range(0, len(ref), 1024)])


def rouge_n(ref: Column, hyp: Column, n: int) -> Column:
    """F1 of the n-gram multisets of two arrays of words, in time that grows with the words; 0 where a side has none."""
    return _rouge_n(ref, hyp, F.lit(n))


@pandas_udf(DoubleType())
def rouge_l(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """F1 by the longest common subsequence of words, with a bit for each word of the hypothesis; 0 where a side has none."""
    def one(a: str, b: str) -> float:
        x, y = (a or "").split(), (b or "").split()
        places: dict[str, int] = {}
        for k, w in enumerate(y):
            places[w] = places.get(w, 0) | 1 << k
        every = same = (1 << len(y)) - 1
        for w in x:
            if here := places.get(w):
                up = same & here
                same = (same + up | same - up) & every
        return 2.0 * (len(y) - same.bit_count()) / (len(x) + len(y)) if x and y else 0.0

    return pd.Series([one(a, b) for a, b in zip(ref, hyp)], dtype="float64")


def confusion(pairs: DataFrame, ref: str, pred: str) -> DataFrame:
    return pairs.where(F.col(ref).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(ref).alias("ref"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(pairs: DataFrame, ref: str, pred: str) -> DataFrame:
    rows = pairs.where(F.col(ref).isNotNull() & F.col(pred).isNotNull())
    return rows.agg(F.avg((F.col(ref) == F.col(pred)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def condition_summary(results: DataFrame, metric: str, by: str = "condition", population: bool = False) -> DataFrame:
    std = F.stddev_pop(metric) if population else F.stddev_samp(metric)
    return results.groupBy(by).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), std.alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"))


def overall_and_condition(results: DataFrame, metric: str, by: str = "condition") -> DataFrame:
    """One pass for the lines by condition and the overall line."""
    return results.groupingSets([[F.col(by)], []], F.col(by)).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max")).withColumn(by, F.coalesce(by, F.lit("ALL")))


def best_and_worst(results: DataFrame, metric: str, by: str = "condition") -> DataFrame:
    means = results.groupBy(by).agg(F.avg(metric).alias("m"))
    return means.agg(F.min_by(by, F.struct("m", by)).alias("best"), F.max_by(by, F.struct("m", by)).alias("worst"))


def pivot_metric(results: DataFrame, metric: str, rows: str, columns: str, values: list, order: str | None = None) -> DataFrame:
    """The first metric (by ``order``, else the least) by row and column, without rows that have none; the columns are given, so no pass looks for them."""
    got = results.where(F.col(metric).isNotNull()).groupBy(rows).pivot(columns, values).agg(F.min_by(metric, order or metric))
    return got.where(F.coalesce(*[F.col(f"`{v}`") for v in values]).isNotNull())


def box_stats(results: DataFrame, metric: str, by: str = "condition") -> DataFrame:
    """Least, quartiles and largest by condition; no buffer grows with a condition's rows."""
    ends = results.groupBy(F.col(by).alias("__by")).agg(F.min(metric).alias("min"), F.max(metric).alias("max"))
    q = percentiles(results, [by], metric, [0.25, 0.5, 0.75]).select(F.col(by).alias("__of"), "q")
    out = ends.join(q, F.col("__by").eqNullSafe(F.col("__of")), "left")
    return out.select(F.col("__by").alias(by), "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def epoch_summary(predictions: DataFrame) -> DataFrame:
    """Mean WER and CER and count of each epoch; a missing epoch reads as ``all``."""
    return predictions.groupBy(F.coalesce(F.col("epoch").cast("string"), F.lit("all")).alias("epoch")).agg(F.avg("wer").alias("wer"), F.avg("cer").alias("cer"), F.count(F.lit(1)).alias("count"))


def preferred(rows: DataFrame, key: str, name: str, exact: str, part: str) -> DataFrame:
    """Of each key the row whose name is ``exact``, else holds ``part``, else comes first."""
    w = Window.partitionBy(key).orderBy((F.col(name) == exact).desc(), F.col(name).contains(part).desc(), F.col(name))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
