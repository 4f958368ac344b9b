"""Times and numbers: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(seconds: Column) -> tuple[Column, Column, Column]:
    s = F.floor(seconds).cast("long")
    return F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60


def format_duration(seconds: Column) -> Column:
    """h:mm:ss or m:ss; 0:00 for a negative time."""
    h, m, s = _parts(seconds)
    return F.when(seconds < 0, "0:00").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def format_timestamp(seconds: Column) -> Column:
    """hh:mm:ss or mm:ss; a negative time reads as 0."""
    h, m, s = _parts(F.greatest(seconds, F.lit(0.0)))
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def format_range(start: Column, end: Column) -> Column:
    return F.concat(format_timestamp(start), F.lit("–"), format_timestamp(end))


def parse_timestamp(text: Column) -> Column:
    """mm:ss or hh:mm:ss as seconds."""
    return F.aggregate(F.split(text, ":"), F.lit(0.0), lambda total, x: total * 60 + F.coalesce(x.try_cast("double"), F.lit(0.0)))


def words_per_minute(words: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, words / (seconds / 60)).otherwise(F.lit(0.0))


def duration_words(seconds: Column) -> Column:
    """"1 jam 2 menit 3 detik", without the hours where there are none; empty unless positive."""
    h, m, s = _parts(seconds)
    words = F.concat(F.when(h > 0, F.format_string("%d jam ", h)).otherwise(""), F.format_string("%d menit %d detik", m, s))
    return F.when(seconds > 0, words).otherwise("")


def percent_done(done: Column, total: Column) -> Column:
    """0 to 100; 0 without a positive total."""
    return F.when(total > 0, done / total * 100).otherwise(F.lit(0.0))


def remaining(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds left at the pace so far; null before anything is done."""
    return F.when(done > 0, elapsed / done * (total - done))


def stamps(ts: Column) -> Column:
    """A moment as date (01 January 2026), time (09:30) and part of a file's name (20260101_093000)."""
    return F.struct(F.date_format(ts, "dd MMMM yyyy").alias("date"), F.date_format(ts, "HH:mm").alias("time"), F.date_format(ts, "yyyyMMdd_HHmmss").alias("name"))
