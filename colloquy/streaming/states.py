"""Operators with a state of their own for each meeting, as streams: speaker smoothing and utterance alignment.

Rows may come in any order within the watermark.  What a meeting's rows mean
depends on their order, so they wait in a list state until the watermark has
passed them; an event-time timer wakes the meeting then, and rows behind the
watermark never reach the state (Spark drops them).  A meeting that was quiet
for ``quiet`` is over: its last rows are settled and its state goes, so no state
outlives its meeting.  Running totals have no end in event time; theirs go by a
time to live, which Spark counts in processing time.

The state lies in RocksDB, so it isn't bounded by memory, and in the query's
checkpoint, so a stream goes on after a lost driver or executor.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.segments import align_rows

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_states(spark: SparkSession) -> None:
    """States of a processor need a store that holds lists and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _milliseconds(seconds: float) -> int:
    return int(round(seconds * 1000))


class Waiting(StatefulProcessor):
    """Rows of a key that wait for the watermark, and one timer for the earliest thing to do."""

    rows_schema: str

    def __init__(self, quiet: float):
        self.quiet = _milliseconds(quiet)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows_schema)

    def wake(self, at: int) -> None:
        """The only timer of the key is the one at ``at``."""
        for other in list(self.handle.listTimers()):
            if other != at:
                self.handle.deleteTimer(other)
        self.handle.registerTimer(at)

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.rows()
        held += [tuple(r[c] for c in self.columns) for r in rows]
        self.waiting.put(held)
        self.wake(self.due(held))
        return iter(())

    def due(self, held: list[tuple]) -> int:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Smoother(Waiting):
    """Settles rows in order: a short row between two rows of one speaker takes that speaker, earlier changes counting."""

    rows_schema = "ts long, start double, seg_idx long, end double, speaker_id string"
    columns = ("ts", "start", "seg_idx", "end", "speaker_id")

    def __init__(self, shortest: float, quiet: float):
        super().__init__(quiet)
        self.shortest = shortest

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # the row that waits for its follower, and the settled speaker before it
        self.open = handle.getValueState("open", f"{self.rows_schema}, before string, first boolean")

    def due(self, held: list[tuple]) -> int:
        return min(r[0] for r in held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self.rows()
        ready = sorted((r for r in held if r[0] <= now), key=lambda r: r[1:3])
        wait = [r for r in held if r[0] > now]
        open_row = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for r in ready:
            before, first = None, True
            if open_row is not None:
                ts, start, seg_idx, end, who, b, f = open_row
                if not f and end - start < self.shortest and b is not None and b == r[4]:
                    who = b
                out.append((start, seg_idx, end, who))
                before, first = who, False
            open_row = (*r, before, first)
        if wait:
            self.waiting.put(wait)
        else:
            self.waiting.clear()
        over = open_row is not None and not wait and open_row[0] + self.quiet <= now
        if over:
            # nothing follows the last row
            out.append((*open_row[1:4], open_row[4]))
            self.open.clear()
        elif open_row is not None:
            self.open.update(open_row)
            self.wake(min([r[0] for r in wait], default=open_row[0] + self.quiet))
        for start, seg_idx, end, who in out:
            yield Row(meeting_id=key[0], start=start, seg_idx=seg_idx, end=end, speaker_id=who)


class Aligner(Waiting):
    """Holds a meeting's utterances and segments until it is over, then aligns them; an utterance may match any later segment."""

    rows_schema = "ts long, kind string, start double, n long, end double, speaker_id string, text string"
    columns = ("ts", "kind", "start", "n", "end", "speaker_id", "text")

    def __init__(self, least: float, sure: float, quiet: float):
        super().__init__(quiet)
        self.least, self.sure = least, sure

    def due(self, held: list[tuple]) -> int:
        return max(r[0] for r in held) + self.quiet

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.rows()
        said = sorted(((r[3], r[5], r[6]) for r in held if r[1] == "utterance"), key=lambda r: r[0])
        segments = sorted(((r[2], r[3], r[4], r[6]) for r in held if r[1] == "segment"), key=lambda r: r[:2])
        self.waiting.clear()
        for n, who, start, end, score in align_rows(said, [(s, e, t) for s, _, e, t in segments], self.least, self.sure):
            yield Row(meeting_id=key[0], utt_idx=n, speaker_id=who, start=start, end=end, score=score)


class Totals(StatefulProcessor):
    """Count, sum, least and largest of a key so far; a key that says nothing for ``keep`` seconds starts anew."""

    def __init__(self, keep: float):
        self.keep = _milliseconds(keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sofar = handle.getValueState("sofar", "n long, total double, least double, most double", self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, total, least, most = self.sofar.get() if self.sofar.exists() else (0, 0.0, None, None)
        for r in rows:
            x = r["x"]
            n += 1
            if x is not None:
                total, least, most = total + x, x if least is None else min(least, x), x if most is None else max(most, x)
        self.sofar.update((n, total, least, most))
        yield Row(key=key[0], n=n, total=total, least=least, most=most)

    def close(self) -> None:
        pass


def totals(rows: DataFrame, key: str, value: str, keep: float = 86_400.0) -> DataFrame:
    """key, n, total, least, most after every batch in which the key has rows, for update mode."""
    use_states(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    some = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("x"))
    return some.groupBy("key").transformWithState(Totals(keep), f"key {kind}, n long, total double, least double, most double", "Update", "ProcessingTime")


def smoothed(segments: DataFrame, ts: str, shortest: float = 1.0, quiet: float = 600.0, late: str = "1 minute") -> DataFrame:
    """``operators.segments.smooth_segments`` of a stream: meeting_id, start, seg_idx, end, speaker_id and ``ts``, the event time of the start."""
    use_states(segments.sparkSession)
    rows = segments.withWatermark(ts, late).select(
        "meeting_id", F.col(ts).alias("at"), F.col("start").cast("double").alias("start"), F.col("seg_idx").cast("long").alias("seg_idx"), F.col("end").cast("double").alias("end"), "speaker_id",
    ).withColumn("ts", F.unix_millis("at"))
    kind = dict(segments.dtypes)["meeting_id"]
    return rows.groupBy("meeting_id").transformWithState(Smoother(shortest, quiet), f"meeting_id {kind}, start double, seg_idx long, end double, speaker_id string", "Append", "EventTime")


def aligned(rows: DataFrame, ts: str, least: float = 0.2, sure: float = 0.75, quiet: float = 600.0, late: str = "1 minute") -> DataFrame:
    """``operators.segments.align_utterances`` of a stream.

    Rows are meeting_id, kind (``utterance`` or ``segment``), n (utt_idx or seg_idx), start and end in seconds,
    speaker_id, text and ``ts``, the event time.
    """
    use_states(rows.sparkSession)
    timed = rows.withWatermark(ts, late).select(
        "meeting_id", F.col(ts).alias("at"), "kind", F.col("start").cast("double").alias("start"), F.col("n").cast("long").alias("n"), F.col("end").cast("double").alias("end"), "speaker_id", "text",
    ).withColumn("ts", F.unix_millis("at"))
    kind = dict(rows.dtypes)["meeting_id"]
    return timed.groupBy("meeting_id").transformWithState(Aligner(least, sure, quiet), f"meeting_id {kind}, utt_idx long, speaker_id string, start double, end double, score double", "Append", "EventTime")
