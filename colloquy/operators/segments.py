"""Segments of speech: statistics, turns, islands, windows, overlaps, interval joins.

A segment table has a meeting key, an ordinal and, where times matter, ``start``
and ``end`` in seconds.  Meetings are the grain of every window and join, so
work spreads over meetings; an interval join keeps the meeting as its equi key.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import format_timestamp, words_per_minute
from .scans import BLOCK, parted, running, scan


def speaker_stats(segments: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """Words, seconds and segments of each speaker of each meeting, in order of appearance."""
    return segments.groupBy(meeting, "speaker_id").agg(
        F.sum(T.word_count(F.col("text"))).alias("word_count"), F.sum(F.col("end") - F.col("start")).alias("duration"),
        F.count(F.lit(1)).alias("segment_count"), F.min("seg_idx").alias("first_seen"),
    )


def transcription_stats(segments: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    out = segments.groupBy(meeting).agg(
        F.count(F.lit(1)).alias("total_segments"), F.sum(T.word_count(F.col("text"))).alias("total_words"),
        F.sum(F.col("end") - F.col("start")).alias("total_duration"), F.countDistinct("speaker_id").alias("num_speakers"),
    )
    return out.withColumn("words_per_minute", words_per_minute(F.col("total_words"), F.col("total_duration")))


def transcription_summary(segments: DataFrame) -> DataFrame:
    """One row over all segments, zeros for none: totals, words a minute, and ``speakers``, a map to words, seconds and segments.

    Sums are by speaker first, so the row is built from as many parts as there are speakers.
    """
    by = segments.groupBy("speaker_id").agg(
        F.sum(T.word_count(F.col("text"))).alias("word_count"), F.sum(F.col("end") - F.col("start")).alias("duration"), F.count(F.lit(1)).alias("segment_count"),
    )
    known = F.when(F.col("speaker_id").isNotNull(), F.struct("speaker_id", F.struct("word_count", "duration", "segment_count")))
    total = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero))
    out = by.agg(
        total("segment_count", 0).alias("total_segments"), total("word_count", 0).alias("total_words"), total("duration", 0.0).alias("total_duration"),
        F.map_from_entries(F.array_sort(F.collect_list(known))).alias("speakers"),
    )
    return out.withColumn("words_per_minute", F.when(F.col("total_duration") > 0, words_per_minute(F.col("total_words"), F.col("total_duration"))).otherwise(0.0))


def overlap_stats(segments: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """Of segments with ``is_overlap``: total, overlapped and average seconds of each speaker."""
    d = F.col("end") - F.col("start")
    return segments.groupBy(meeting, "speaker_id").agg(
        F.sum(d).alias("total_duration"), F.count(F.lit(1)).alias("segment_count"),
        F.sum(F.when(F.col("is_overlap"), d).otherwise(0.0)).alias("overlap_duration"), F.avg(d).alias("avg_duration"),
    )


def islands(rows: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """Adds ``island``: a running count of rows for which ``starts`` holds, within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("island", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w))


def speaker_turns(segments: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """Runs of one speaker: cleaned non-empty texts (marks and one leading filler go) joined, with the last end and the rows' ordinals."""
    t = T.squeeze(F.regexp_replace(F.regexp_replace(F.col("text"), T.MARKS, ""), T.LEADING_FILLER, ""))
    rows = segments.withColumn("text", t).where("text <> ''")
    w = Window.partitionBy(meeting).orderBy("seg_idx")
    rows = rows.withColumn("before", F.lag("speaker_id").over(w))
    rows = islands(rows, [meeting], ["seg_idx"], F.col("before") != F.col("speaker_id"))
    packed = F.array_sort(F.collect_list(F.struct("seg_idx", "text", "end")))
    out = rows.groupBy(meeting, "island", "speaker_id").agg(F.min("start").alias("start"), packed.alias("rows"))
    return out.select(
        meeting, F.col("island").alias("turn_idx"), "speaker_id", "start", F.element_at("rows", -1)["end"].alias("end"),
        F.array_join(F.transform("rows", lambda r: r["text"]), " ").alias("text"), F.transform("rows", lambda r: r["seg_idx"]).alias("indices"),
    )


def merge_segments(segments: DataFrame, gap: float = 0.5, meeting: str = "meeting_id") -> DataFrame:
    """Consecutive segments of one speaker that start within ``gap`` of the end so far become one.

    Where there is a ``confidence``, each segment's is averaged with that of all before it, in order: the last counts half,
    the one before a quarter, and the first as much as the second.
    """
    w = Window.partitionBy(meeting).orderBy("start", "seg_idx")
    rows = segments.withColumn("before", F.lag("speaker_id").over(w))
    rows = islands(rows, [meeting], ["start", "seg_idx"], F.col("before") != F.col("speaker_id")).withColumnRenamed("island", "run")
    past = Window.partitionBy(meeting, "run").orderBy("start", "seg_idx")
    rows = rows.withColumn("reach", F.max("end").over(past.rowsBetween(Window.unboundedPreceding, -1)))
    rows = islands(rows, [meeting, "run"], ["start", "seg_idx"], F.col("start") - F.col("reach") > gap)
    out = [F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("merged")]
    if "confidence" in segments.columns:
        one = Window.partitionBy(meeting, "run", "island")
        left = F.row_number().over(one.orderBy(F.desc("start"), F.desc("seg_idx")))
        rows = rows.withColumn("halvings", left - (left == F.count(F.lit(1)).over(one)).cast("int"))
        out.append(F.sum(F.col("confidence") * F.pow(F.lit(0.5), "halvings")).alias("confidence"))
    return rows.groupBy(meeting, "run", "island", "speaker_id").agg(*out).drop("run", "island")


def merge_regions(regions: DataFrame, gap: float, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Regions of any speaker that start within ``gap`` of the end so far become one; a long key is scanned in parts."""
    order = ["start", "end"]
    rows = scan(parted(regions.select(*keys, *order), keys, "start", block), keys, order, maxima={"reach": F.col("end")})
    fresh = F.coalesce(F.col("start") - F.col("reach") > gap, F.lit(True)).cast("long")
    rows = rows.withColumn("fresh", fresh)
    # the island's number: fresh rows before, and this one
    rows = scan(rows, keys, order, {"earlier": F.col("fresh")})
    return rows.groupBy(*keys, (F.col("earlier") + F.col("fresh")).alias("island")).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def smooth_segments(segments: DataFrame, shortest: float = 1.0, meeting: str = "meeting_id") -> DataFrame:
    """A short row between two rows of one speaker takes that speaker, left to right, earlier changes counting.

    Each row depends on the change before it, so a meeting is a group and one pass over its rows.
    """
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["start", "seg_idx"])
        who, short = g["speaker_id"].to_list(), (g["end"] - g["start"] < shortest).to_list()
        for i in range(1, len(who) - 1):
            if short[i] and who[i - 1] is not None and who[i - 1] == who[i + 1]:
                who[i] = who[i - 1]
        return g.assign(speaker_id=who)

    kind = dict(segments.dtypes)[meeting]
    rows = segments.select(meeting, F.col("start").cast("double").alias("start"), F.col("seg_idx").cast("long").alias("seg_idx"), F.col("end").cast("double").alias("end"), "speaker_id")
    return rows.groupBy(meeting).applyInPandas(run, f"{meeting} {kind}, start double, seg_idx long, end double, speaker_id string")


def analysis_windows(regions: DataFrame, length: float = 1.5, hop: float = 0.75, least: float = 0.3) -> DataFrame:
    """Sliding windows over regions; a region under two windows is one; tails under ``least`` go."""
    span = F.col("end") - F.col("start")
    n = F.when(span < 2 * length, F.lit(0)).otherwise(F.floor(span / hop)).cast("int")
    rows = regions.withColumn("k", F.explode(F.sequence(F.lit(0), n)))
    begin = F.col("start") + F.col("k") * hop
    stop = F.when(span < 2 * length, F.col("end")).otherwise(F.least(begin + length, F.col("end")))
    return rows.withColumns({"w_start": begin, "w_end": stop}).where(F.col("w_end") - F.col("w_start") >= least)


def chunks(audio: DataFrame, length: float, overlap: float = 0.0) -> DataFrame:
    """Chunks of ``duration``: step = length - overlap, the last one cut."""
    if overlap >= length:
        raise ValueError("overlap must be less than the chunk's length")
    step = length - overlap
    rows = audio.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration") / step) - 1, F.lit(0)).cast("int"))))
    return rows.withColumns({"c_start": F.col("chunk_idx") * step, "c_end": F.least(F.col("chunk_idx") * step + length, F.col("duration"))})


def detect_overlaps(segments: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """Marks segments that another speaker's segment of the meeting overlaps; touching ends don't count.

    Linear in the segments: a sweep over the boundaries counts active speakers (a
    speaker's own segments united), numbers the spans with two or more, and a
    segment is marked if such a span begins between its start and its end.
    """
    timed = segments.select(meeting, "speaker_id", "start", "end").where(F.col("end") > F.col("start"))
    one = merge_regions(timed, 0.0, [meeting, "speaker_id"])
    step = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d"))))
    asked = timed.select(meeting, F.explode(F.array("start", "end")).alias("t")).select(meeting, "t", F.lit(0).alias("d"))
    at = one.select(meeting, step.alias("s")).select(meeting, "s.t", "s.d").unionByName(asked).groupBy(meeting, "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(meeting).orderBy("t")
    at = at.withColumn("crowded", (F.sum("d").over(w) > 1).cast("int"))
    # how many crowded spans begin before each boundary
    at = at.select(F.col(meeting).alias("__m"), F.col("t").alias("__t"), (F.sum("crowded").over(w) - F.col("crowded")).alias("__c")).repartition("__m", "__t")
    first, last = (at.select(F.col("__m").alias(f"__m{k}"), F.col("__t").alias(f"__t{k}"), F.col("__c").alias(f"__c{k}")) for k in (0, 1))
    out = segments.join(first, (F.col(meeting) == F.col("__m0")) & (F.col("start") == F.col("__t0")), "left").join(last, (F.col(meeting) == F.col("__m1")) & (F.col("end") == F.col("__t1")), "left")
    marked = F.coalesce((F.col("end") > F.col("start")) & (F.col("__c1") > F.col("__c0")), F.lit(False))
    return out.withColumn("is_overlap", marked).drop("__m0", "__t0", "__c0", "__m1", "__t1", "__c1")


#: Width of a cell of time, in mean lengths of segments and blocks.
CELL = 64


def map_blocks(segments: DataFrame, blocks: DataFrame, contained: bool = False, meeting: str = "meeting_id", bucket: float | None = None) -> DataFrame:
    """Texts of the blocks that overlap (or lie within) each segment, joined in block order.

    A segment goes to the one cell of time in which it starts, and a block to all cells from which a segment can reach
    it, so texts are made where both meet and no pair is shuffled.  ``bucket`` is the width of the cells, by default ``CELL``
    mean lengths of both sides; segments longer than a cell lie in cells of twice, four times, ... that width.
    Segments of which several have one number are joined in pairs and then gathered.
    """
    b = blocks.select(F.col(meeting).alias("__m"), F.col("block_idx").alias("__i"), F.col("start").alias("__a"), F.col("end").alias("__b"), F.trim("text").alias("__t"))
    b = b.where("__m is not null and __i is not null and __a is not null and __b is not null and __t is not null")
    # equal numbers are counted first, by narrow rows
    s = segments.groupBy(meeting, "seg_idx").agg(F.count(F.lit(1)).alias("__n"), F.first("start").alias("start"), F.first("end").alias("end"))
    length = lambda d, x, y: d.select((F.col(y) - F.col(x)).alias("d"))
    if bucket is None:
        mean = length(segments, "start", "end").unionByName(length(b, "__a", "__b")).where("d > 0").agg(F.avg("d")).first()[0] or 1.0
        bucket = CELL * mean
    span = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    level = F.when(span <= bucket, 0).otherwise(F.ceil(F.log2(span / bucket))).cast("int")
    s = s.withColumn("__l", level)
    found = s.groupBy("__l").agg(F.max(F.when(F.col("__n") == 1, span)).alias("reach"), F.max("__n").alias("n")).collect()
    reach = {r["__l"]: r["reach"] for r in found if r["__l"] is not None and r["reach"] is not None}
    cell = lambda x, k: F.floor(x / F.lit(bucket * 2.0**k))
    home = F.coalesce(*[F.when(F.col("__l") == k, cell(F.col("start"), k)) for k in reach], F.lit(None).cast("long"))
    kinds = dict(segments.select(meeting, "seg_idx").dtypes)
    own = s.where("__n = 1").select(meeting, F.col("__l").alias("__k"), home.alias("__c"), F.lit(1).alias("__side"), F.lit(None).cast(dict(b.dtypes)["__i"]).alias("__i"), "seg_idx", F.col("start").cast("double").alias("__a"), F.col("end").cast("double").alias("__b"), F.lit(None).cast("string").alias("__t"))
    # a little more than the longest segment, for what subtraction rounds
    first = lambda k: cell(F.least("__a", "__b") - F.lit(reach[k] + 1e-6 * bucket), k)
    spread = F.array(*[F.struct(F.lit(k).alias("k"), first(k).alias("x"), cell(F.greatest("__a", "__b"), k).alias("y")) for k in reach]) if reach else None
    rows = own
    if reach:
        laid = b.withColumn("__s", F.explode(spread)).withColumn("__c", F.explode(F.sequence("__s.x", "__s.y")))
        rows = own.unionByName(laid.select(F.col("__m").alias(meeting), F.col("__s.k").alias("__k"), "__c", F.lit(0).alias("__side"), "__i", F.lit(None).cast(kinds["seg_idx"]).alias("seg_idx"), F.col("__a").cast("double").alias("__a"), F.col("__b").cast("double").alias("__b"), "__t"))
    met = rows.repartition(meeting, "__k", "__c").sortWithinPartitions(meeting, "__k", "__c", "__side", "__i", "__t").select(meeting, "__k", "__c", "__side", "seg_idx", "__a", "__b", "__t")
    out = met.mapInArrow(_joined_texts(contained), f"{meeting} {kinds[meeting]}, seg_idx {kinds['seg_idx']}, text string")
    return out.unionByName(_gathered(segments, s, b, contained, meeting, bucket / CELL)) if any(r["n"] > 1 for r in found) else out


def _joined_texts(contained: bool):
    """Over rows sorted by cell, its blocks in order before its segments: meeting, segment and text of each segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ready, a, b, t = None, None, [], [], []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[:4]] + [c.to_pylist() for c in batch.columns[5:]]
            kept, texts, size = [], [], 0
            for k, (m, lev, c, side, x, y, text) in enumerate(zip(*cols)):
                if (m, lev, c) != at:
                    at, ready, a, b, t = (m, lev, c), None, [], [], []
                if not side:
                    a.append(x)
                    b.append(y)
                    t.append(text)
                    continue
                if ready is None:
                    ready = _Reached(a, b, t)
                texts.append(ready.text(x, y, contained) if a and x is not None and y is not None else "")
                kept.append(k)
                size += len(texts[-1])
                if size > 1 << 25:
                    yield _texts_of(batch, kept, texts)
                    kept, texts, size = [], [], 0
            yield _texts_of(batch, kept, texts)

    return run


def _texts_of(batch: pa.RecordBatch, kept: list[int], texts: list[str]) -> pa.RecordBatch:
    rows = batch.take(pa.array(kept, pa.int64()))
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(4), pa.array(texts, pa.string())], names=[batch.schema.names[0], "seg_idx", "text"])


class _Reached:
    """Blocks of a cell in order: which ones a segment meets, by a search over their starts."""

    def __init__(self, a: list[float], b: list[float], t: list[str]):
        x = np.array(a)
        self.order = np.argsort(x, kind="stable")
        self.a, self.b, self.t = x[self.order], np.array(b)[self.order], np.array(t, object)
        self.last, self.forward = np.maximum.accumulate(self.b), bool((self.b >= self.a).all())

    def text(self, start: float, end: float, contained: bool) -> str:
        if contained:
            i, j = np.searchsorted(self.a, start, "left"), np.searchsorted(self.a, end, "right") if self.forward else len(self.a)
            near = self.b[i:j] <= end
        else:
            i, j = np.searchsorted(self.last, start, "right"), np.searchsorted(self.a, end, "left")
            near = self.b[i:j] > start
        return " ".join(self.t[np.sort(self.order[i:j][near])].tolist())


def _gathered(segments: DataFrame, counted: DataFrame, b: DataFrame, contained: bool, meeting: str, bucket: float) -> DataFrame:
    """Texts of segments that share their number with others: every pair with a block, gathered by number."""
    several = counted.where("__n > 1").select(F.col(meeting).alias("__sm"), F.col("seg_idx").alias("__si"))
    s = segments.select(meeting, "seg_idx", "start", "end").join(several, F.col(meeting).eqNullSafe(F.col("__sm")) & F.col("seg_idx").eqNullSafe(F.col("__si")), "left_semi")
    cell = lambda x: F.floor(F.col(x) / bucket)
    spread = lambda d, x, y, name: d.where(F.col(x) <= F.col(y)).withColumn(name, F.explode(F.sequence(cell(x), cell(y))))
    when = (F.col("__a") >= F.col("start")) & (F.col("__b") <= F.col("end")) if contained else (F.col("__a") < F.col("end")) & (F.col("__b") > F.col("start"))
    once = F.col("__k") == F.greatest(cell("start"), cell("__a"))
    pairs = spread(s, "start", "end", "__k").join(spread(b, "__a", "__b", "__j"), (F.col(meeting) == F.col("__m")) & (F.col("__k") == F.col("__j")) & when & once).select(meeting, "seg_idx", "__i", "__t")
    every = pairs.unionByName(s.select(meeting, "seg_idx", F.lit(None).cast(dict(b.dtypes)["__i"]).alias("__i"), F.lit(None).cast("string").alias("__t")))
    packed = F.array_sort(F.collect_list(F.when(F.col("__i").isNotNull(), F.struct("__i", "__t"))))
    return every.groupBy(meeting, "seg_idx").agg(packed.alias("p")).select(meeting, "seg_idx", F.array_join(F.transform("p", lambda x: x["__t"]), " ").alias("text"))


def block_source(rows: DataFrame) -> Column:
    """The first array of chunks, segments and words that is there and not empty."""
    given = [F.when(F.size(c) > 0, F.col(c)) for c in ("chunks", "segments", "words") if c in rows.columns]
    return F.coalesce(*given)


def padded_range(start: Column, end: Column, total: Column, pad: float = 0.5) -> tuple[Column, Column]:
    """Start and end with ``pad`` seconds around, within 0 and the total."""
    return F.greatest(F.lit(0.0), start - pad), F.least(total, end + pad)


def uncovered(tasks: DataFrame, mapped: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """Tasks (meeting, start, end) that the mapped ones don't have."""
    return tasks.join(mapped.select(meeting, "start", "end"), [meeting, "start", "end"], "left_anti")


def within_duration(audio: DataFrame, minutes: float = 60.0, duration: str = "duration") -> DataFrame:
    """Raises on a recording that is longer than allowed."""
    return audio.withColumn(duration, F.when(F.col(duration) > minutes * 60, F.raise_error(F.format_string("recording of %.1f minutes; at most %.1f are allowed", F.col(duration) / 60, F.lit(minutes)))).otherwise(F.col(duration)))


def participants(segments: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    return segments.groupBy(meeting).agg(F.array_sort(F.collect_set("speaker_id")).alias("participants"))


def plain_words(words: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """The words of each meeting in order of time, as one text."""
    packed = F.array_sort(F.collect_list(F.struct("start", "word")))
    return words.groupBy(meeting).agg(packed.alias("p")).select(meeting, F.array_join(F.transform("p", lambda x: x["word"]), " ").alias("text"))


def dense_ids(values: DataFrame, column: str, name: str = "dense_id", first: int = 0) -> DataFrame:
    """column and its rank among the distinct values.

    Ranges of values are numbered side by side, each from the number of values in the ranges before it; only one
    count for each range meets in one task.
    """
    d = values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("__p", F.spark_partition_id())
    within = d.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(column)))
    sizes = within.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__before"))
    return within.join(F.broadcast(before), "__p").select(column, (F.col("__before") + F.col("__n") - 1 + first).cast("long").alias(name))


def context(rows: DataFrame, reach: int = 1, meeting: str = "meeting_id") -> DataFrame:
    w = Window.partitionBy(meeting).orderBy("seg_idx").rowsBetween(-reach, reach)
    return rows.withColumn("context", F.array_join(F.collect_list("text").over(w), " "))


def formatted(segments: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """One text for each meeting: ``[mm:ss] speaker: text`` lines in order, empty texts left out."""
    line = F.concat(F.lit("["), format_timestamp(F.col("start")), F.lit("] "), F.col("speaker_id"), F.lit(": "), F.trim("text"))
    rows = segments.where("length(trim(text)) > 0").withColumn("line", line)
    packed = F.array_sort(F.collect_list(F.struct("seg_idx", "line")))
    return rows.groupBy(meeting).agg(packed.alias("p")).select(meeting, F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("transcript"))


def rename_speakers(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Left join with (label, name); ``original_speaker`` only where the name is given and differs."""
    m = names.select(F.col("label").alias("__l"), F.nullif(F.trim("name"), F.lit("")).alias("__n"))
    out = segments.join(m, F.col("speaker_id") == F.col("__l"), "left")
    changed = F.col("__n").isNotNull() & (F.col("__n") != F.col("speaker_id"))
    return out.withColumns({"original_speaker": F.when(changed, F.col("speaker_id")), "speaker_id": F.coalesce("__n", "speaker_id")}).drop("__l", "__n")


def cumulative_starts(rows: DataFrame, keys: list[str], order: list[str], block: int = BLOCK) -> DataFrame:
    """``start``: the durations of all rows before, in the order given; a long key is scanned in parts."""
    return running(rows, keys, order, {"start": F.col("duration")}, block=block)


def proportional_durations(utterances: DataFrame, total: str = "total", floor: float = 0.2, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """The file's total dealt by share of words, at least ``floor`` each, scaled back to the total.

    With an ``order``, the last row takes what rounding left over.
    """
    w = Window.partitionBy(*(keys or ["file_id"]))
    share = F.greatest(F.col(total) * F.col("n_words") / F.greatest(F.sum("n_words").over(w), F.lit(1)), F.lit(floor))
    rows = utterances.withColumn("raw", share)
    rows = rows.withColumn("duration", F.col("raw") * F.col(total) / F.sum("raw").over(w)).drop("raw")
    if order is None:
        return rows
    last = F.col(order) == F.max(order).over(w)
    return rows.withColumn("duration", F.when(last, F.col("duration") + F.col(total) - F.sum("duration").over(w)).otherwise(F.col("duration")))


def longest_segment(segments: DataFrame, cap: float = 10.0, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["meeting_id", "speaker_id"]
    best = F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("seg_idx")))
    return segments.groupBy(*keys).agg(best.alias("s")).select(*keys, "s.start", F.least(F.col("s.end"), F.col("s.start") + cap).alias("end"))


_WORDS, _OTHER = re.compile(r"\w+"), re.compile(r"[^0-9A-Za-z_\-]")


def align_rows(utterances: list[tuple], segments: list[tuple], least: float, sure: float) -> Iterator[tuple]:
    """(utt_idx, speaker, start, end, score) of ordered utterances (utt_idx, speaker, text) and segments (start, end, text).

    A window's score is the share of the utterance's words that it covers; the best one wins, of equals the
    first start, then the first end, but a start goes no further than its first window that is ``sure`` (above 0).
    Segments without a wanted word never change a score, so only those that a posting names are visited.
    """
    postings: dict[str, list[int]] = {}
    for k, (_, _, text) in enumerate(segments):
        for w in {w.lower() for w in _WORDS.findall(text or "")}:
            postings.setdefault(w, []).append(k)
    at = 0
    for n, who, text in utterances:
        wanted = {w.lower() for w in _WORDS.findall(text or "")}
        best = _best_window({w: p for w in wanted if (p := postings.get(w)) and p[-1] >= at}, at, len(wanted), sure)
        if best is not None and best[0] >= least:
            yield n, _OTHER.sub("_", who), float(segments[best[1]][0]), float(segments[best[2]][1]), best[0]
            at = best[2] + 1


def _best_window(places: dict[str, list[int]], at: int, size: int, sure: float) -> tuple[float, int, int] | None:
    """(score, first, last) of the best window from ``at`` on, by two pointers over the places of wanted words.

    A start's goal is the least number of words with which it is sure.  The end that reaches it never moves back as
    starts move on.  A start with fewer words ahead takes all of them, and no later one can cover more; nor
    can any beat a window with all words.
    """
    goal = next((c for c in range(1, size + 1) if c / size >= sure), size)
    lasts = sorted(p[-1] for p in places.values())

    def occurrences(w: str, p: list[int]):
        return ((p[k], w) for k in range(bisect_left(p, at), len(p)))

    hits = ((k, [w for _, w in g]) for k, g in groupby(merge(*(occurrences(w, p) for w, p in places.items())), key=lambda x: x[0]))
    window: deque[tuple[int, list[str]]] = deque()
    counts: Counter[str] = Counter()
    best, first, covered = None, at, 0

    def take() -> bool:
        nonlocal covered
        hit = next(hits, None)
        if hit is not None:
            window.append(hit)
            for w in hit[1]:
                counts[w] += 1
                covered += counts[w] == 1
        return hit is not None

    def lose(words: list[str]) -> None:
        nonlocal covered
        for w in words:
            counts[w] -= 1
            covered -= not counts[w]

    while window or take():
        ahead = len(lasts) - bisect_left(lasts, window[0][0])
        while covered < min(goal, ahead):
            take()
        while ahead < goal and len(window) > 1 and covered - sum(counts[w] == 1 for w in window[-1][1]) >= ahead:
            lose(window.pop()[1])
        if best is None or covered / size > best[0]:
            best = (covered / size, first, window[-1][0])
        if covered == size or ahead < goal:
            break
        first = window[0][0] + 1
        lose(window.popleft()[1])
    return best


def align_utterances(utterances: DataFrame, segments: DataFrame, least: float = 0.2, sure: float = 0.75, meeting: str = "meeting_id") -> DataFrame:
    """Each utterance takes the window of segments, behind the one taken before, that covers most of its words.

    The cursor makes this sequential within a meeting, so a meeting is a group;
    meetings run side by side.
    """
    def run(key, u: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        u, s = u.sort_values("utt_idx"), s.sort_values(["start", "seg_idx"])
        found = align_rows(list(zip(u["utt_idx"], u["speaker_id"], u["text"])), list(zip(s["start"], s["end"], s["text"])), least, sure)
        return pd.DataFrame([(key[0], *r) for r in found], columns=[meeting, "utt_idx", "speaker_id", "start", "end", "score"])

    kind = dict(segments.dtypes)[meeting]
    return utterances.groupBy(meeting).cogroup(segments.groupBy(meeting)).applyInPandas(run, f"{meeting} {kind}, utt_idx long, speaker_id string, start double, end double, score double")
