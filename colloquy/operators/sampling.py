"""Samples and small joins of evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def least_by_hash(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The k rows of least hash of the key, ties by key, whatever the partitions.

    Rows are counted by the upper 16 bits of the hash (65,536 counts at most reach the driver); all below the range
    that holds the k-th are taken where they are, and only that range is ordered.
    """
    h = F.xxhash64(F.lit(seed), key)
    upper = F.shiftright(h, 48)
    counts, taken, cut = rows.groupBy(upper.alias("u")).count().orderBy("u").collect(), 0, None
    for r in counts:
        if taken + r["count"] >= k:
            cut = r["u"]
            break
        taken += r["count"]
    if cut is None:
        return rows
    return rows.where(upper < cut).unionByName(rows.where(upper == cut).orderBy(h, key).limit(k - taken))


def fraction(rows: DataFrame, key: str, share: float, cap: int | None = None, seed: int = 42) -> DataFrame:
    """max(1, int(n * share)) rows, at most ``cap``: those of least hash."""
    k = max(1, int(rows.count() * share))
    return least_by_hash(rows, key, k if cap is None else min(k, cap), seed)


def offset_sample(rows: DataFrame, key: str, skip: int, k: int, seed: int = 42) -> DataFrame:
    """k rows by hash from those behind the first ``skip`` by key."""
    return rows.orderBy(key).offset(skip).orderBy(F.xxhash64(F.lit(seed), key), key).limit(k)


def by_stem(audio: DataFrame, texts: DataFrame, annotations: DataFrame) -> DataFrame:
    """Audio with its transcript and annotation of the same stem; both may be missing."""
    return audio.join(texts.select("stem", F.col("path").alias("transcript")), "stem", "left").join(annotations.select("stem", F.col("path").alias("rttm")), "stem", "left")


def group_members(groups: DataFrame, actions: DataFrame, meeting: str) -> DataFrame:
    """Actions whose task is the group's, or holds its text; the meeting is the equi key."""
    g = groups.where("rep <> ''").select(F.col(meeting).alias("__m"), "rep")
    return actions.join(g, (F.col(meeting) == F.col("__m")) & ((F.col("task") == F.col("rep")) | F.col("task").contains(F.col("rep")))).drop("__m")


def words_to_turns(words: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """Runs of one speaker's words (meeting, speaker_id, word, start, end) with their true ends."""
    w = Window.partitionBy(meeting).orderBy("start", "end", "word")
    rows = words.withColumns({"n": F.row_number().over(w), "new": (F.coalesce(F.lag("speaker_id").over(w), F.lit("")) != F.col("speaker_id")).cast("int")})
    rows = rows.withColumn("turn", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    packed = F.array_sort(F.collect_list(F.struct("n", "word")))
    return rows.groupBy(meeting, "turn", "speaker_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), packed.alias("p")).select(meeting, "turn", "speaker_id", "start", "end", F.array_join(F.transform("p", lambda r: r["word"]), " ").alias("text"))
