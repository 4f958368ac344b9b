"""Sampled signals as rows (key, pos, x): frames, thresholds, smoothing, noise, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import BLOCK, moving_sum, order_statistics
from .segments import islands


def block_average(rows: DataFrame, key: str, rate: int, hz: float) -> DataFrame:
    """Each sample becomes its block's mean; blocks of round(rate / hz); hz of 0 or less passes through."""
    if not hz or hz <= 0 or hz != hz:
        return rows.withColumn("y", F.col("x"))
    w = Window.partitionBy(key, F.floor(F.col("pos") / max(1, round(rate / hz))))
    return rows.withColumn("y", F.avg("x").over(w))


def energy_frames(rows: DataFrame, key: str, window: int, hop: int) -> DataFrame:
    """Root mean square of overlapping frames: each sample goes to the frames that hold it, sums are combined first."""
    n = -(-window // hop)
    last = F.floor(F.col("pos") / hop)
    spread = rows.select(key, "x", "pos", F.explode(F.sequence(F.greatest(last - n + 1, F.lit(0)), last)).alias("frame")).where(F.col("pos") < F.col("frame") * hop + window)
    return spread.groupBy(key, "frame").agg(F.sqrt(F.avg(F.col("x") * F.col("x")) + 1e-10).alias("energy"), F.count(F.lit(1)).alias("n")).where(F.col("n") == window).drop("n")


def adaptive_threshold(values: DataFrame, key: str, value: str, share: float = 0.3, factor: float = 0.5) -> DataFrame:
    """The value at ``int(share n)`` of the sorted ones plus ``factor`` population standard deviations."""
    at = order_statistics(values, [key], value, [share], lambda n, s: [F.least(F.floor(n * F.lit(s)), n - 1)])
    spread = values.groupBy(F.col(key).alias("__key")).agg(F.stddev_pop(value).alias("sd"))
    return at.join(spread, F.col(key).eqNullSafe(F.col("__key"))).select(key, (F.col("at")[0] + factor * F.col("sd")).alias("threshold"))


def moving_average(rows: DataFrame, key: str, value: Column, width: int = 30, order: str = "pos", block: int = BLOCK) -> DataFrame:
    """A box of ``width`` with zeros outside: half before, the rest from the row on."""
    out = moving_sum(rows, key, order, value, width // 2, width - width // 2 - 1, "smooth", block)
    return out.withColumn("smooth", F.col("smooth") / width)


def true_regions(frames: DataFrame, key: str, flag: str, hop: float, least: float = 0.0) -> DataFrame:
    """Runs of true frames as times; a run ends where the next frame begins."""
    w = Window.partitionBy(key).orderBy("frame")
    rows = frames.withColumn("before", F.lag(flag).over(w))
    rows = islands(rows, [key], ["frame"], F.col("before") != F.col(flag)).where(F.col(flag))
    out = rows.groupBy(key, "island").agg((F.min("frame") * hop).alias("start"), ((F.max("frame") + 1) * hop).alias("end")).drop("island")
    return out.where(F.col("end") - F.col("start") >= least)


def peak_normalize(rows: DataFrame, key: str) -> DataFrame:
    peak = F.max(F.abs("x")).over(Window.partitionBy(key))
    return rows.withColumn("y", F.when(peak > 0, F.col("x") / peak).otherwise(F.col("x")))


def trim_silence(rows: DataFrame, key: str, db: float = -40.0) -> DataFrame:
    loud = F.abs("x") > 10 ** (db / 20)
    w = Window.partitionBy(key)
    return rows.withColumns({"__a": F.min(F.when(loud, F.col("pos"))).over(w), "__b": F.max(F.when(loud, F.col("pos"))).over(w)}).where("pos between __a and __b").drop("__a", "__b")


def power(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.avg(F.col("x") * F.col("x")).alias("power"), F.max(F.abs("x")).alias("peak"))


def white_noise(rows: DataFrame, key: str, snr_db: float, seed: int = 0) -> DataFrame:
    """Gaussian noise at a signal-to-noise ratio; the draw is by key and place, so partitions don't change it."""
    u = lambda s: (F.pmod(F.xxhash64(F.lit(seed + s), key, "pos"), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    normal = F.sqrt(-2.0 * F.log(u(0))) * F.cos(2 * F.pi() * u(1))
    level = F.sqrt(F.avg(F.col("x") * F.col("x")).over(Window.partitionBy(key)) / 10 ** (snr_db / 10))
    return rows.withColumn("y", F.col("x") + normal * level)


def reverb(rows: DataFrame, key: str, rate: int, decay: float = 0.3, delays: tuple[float, ...] = (0.02, 0.04, 0.06, 0.08, 0.1)) -> DataFrame:
    w, y = Window.partitionBy(key).orderBy("pos"), F.col("x")
    for k, d in enumerate(delays):
        y = y + F.coalesce(F.lag("x", max(1, int(d * rate))).over(w), F.lit(0.0)) * decay ** (k + 1)
    return rows.withColumn("y", y)


def mono(rows: DataFrame, key: str, channel: str = "channel") -> DataFrame:
    """The mean of the channels of each sample."""
    return rows.groupBy(key, "pos").agg(F.avg("x").alias("x"))


def time_slice(rows: DataFrame, key: str, rate: int, start: float = 0.0, end: float | None = None) -> DataFrame:
    """Samples from start to end in seconds, counted from 0 again; times beyond the signal are cut to it."""
    a = max(0, int(start * rate))
    inside = rows.where(F.col("pos") >= a) if end is None else rows.where((F.col("pos") >= a) & (F.col("pos") < max(a, int(end * rate))))
    return inside.withColumn("pos", F.col("pos") - a)


def duration(rows: DataFrame, key: str, rate: int) -> DataFrame:
    return rows.groupBy(key).agg(((F.max("pos") + 1) / rate).alias("duration"))


def resample(rows: DataFrame, key: str, rate: int, to: int) -> DataFrame:
    """Linear interpolation: each sample makes the new ones up to the next sample, so no join is needed."""
    if rate == to:
        return rows.select(key, "pos", "x")
    ahead = F.lead("x").over(Window.partitionBy(key).orderBy("pos"))
    first, last = F.ceil(F.col("pos") * to / rate), F.ceil((F.col("pos") + 1) * to / rate) - 1
    made = rows.select(key, "pos", "x", F.coalesce(ahead, F.col("x")).alias("__y"), first.cast("long").alias("__a"), last.cast("long").alias("__b")).where("__b >= __a")
    made = made.withColumn("__j", F.explode(F.sequence("__a", "__b")))
    share = F.col("__j") * F.lit(float(rate)) / to - F.col("pos")
    return made.select(key, F.col("__j").alias("pos"), (F.col("x") + share * (F.col("__y") - F.col("x"))).alias("x"))


def resample_filtered(rows: DataFrame, key: str, rate: int, to: int, zeros: int = 16) -> DataFrame:
    """Resampling through a low-pass filter: what lies above half the lower rate goes, in place of turning up as another tone.

    The filter is a sine cardinal of ``zeros`` crossings on either side under a Blackman window, cut at 0.9 of half the
    lower rate.  Each sample is sent to the new ones that it counts for, at most 2 * ``zeros`` * max(1, to / rate) + 1
    of them, and sums are combined before the shuffle; weights are divided by their sum, so a constant stays one, also
    at the ends.
    """
    if rate == to:
        return rows.select(key, "pos", "x")
    cut = 0.9 * min(1.0, to / rate)
    reach = zeros / cut
    ends = rows.groupBy(F.col(key).alias("__key")).agg(F.ceil((F.max("pos") + 1) * to / rate).alias("__n"))
    first = F.greatest(F.ceil((F.col("pos") - reach) * to / rate), F.lit(0))
    spread = rows.select(key, "pos", "x", F.explode(F.sequence(first.cast("long"), F.floor((F.col("pos") + reach) * to / rate).cast("long"))).alias("__j"))
    t = F.col("__j") * F.lit(float(rate)) / to - F.col("pos")
    angle = F.pi() * cut * t
    sinc = F.when(F.abs(angle) < 1e-9, F.lit(1.0)).otherwise(F.sin(angle) / angle)
    turn = F.pi() * t / reach
    weight = sinc * (0.42 + 0.5 * F.cos(turn) + 0.08 * F.cos(2 * turn))
    sums = spread.withColumn("__w", weight).groupBy(key, "__j").agg((F.sum(F.col("__w") * F.col("x")) / F.sum("__w")).alias("x"))
    # the signal's length bounds the new places: the last sample's filter reaches beyond it
    return sums.join(ends, F.col(key).eqNullSafe(F.col("__key"))).where("__j < __n").select(key, F.col("__j").alias("pos"), "x")


def prepare(rows: DataFrame, key: str, rate: int, to: int = 16_000, start: float = 0.0, end: float | None = None, silence_db: float | None = None, most: float | None = None) -> DataFrame:
    """A recording as the models take it: range, one channel, rate (filtered where it falls), peak 1, silence trimmed where asked, cut to ``most`` seconds."""
    x = mono(rows, key) if "channel" in rows.columns else rows.select(key, "pos", "x")
    x = (resample_filtered if to < rate else resample)(time_slice(x, key, rate, start, end), key, rate, to)
    x = peak_normalize(x, key).select(key, "pos", F.col("y").alias("x"))
    if silence_db is not None:
        x = trim_silence(x, key, silence_db)
        x = x.withColumn("pos", F.col("pos") - F.min("pos").over(Window.partitionBy(key)))
    return x if most is None else x.where(F.col("pos") < int(most * to))


def uniform_noise(rows: DataFrame, key: str, level: float, seed: int = 0) -> DataFrame:
    """Noise between -level and level; the draw is by key and place."""
    u = F.pmod(F.xxhash64(F.lit(seed), key, "pos"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return rows.withColumn("y", F.col("x") + (u * 2 - 1) * level)


def gaussian_noise(rows: DataFrame, key: str, level: float, seed: int = 0) -> DataFrame:
    u = lambda s: (F.pmod(F.xxhash64(F.lit(seed + s), key, "pos"), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    return rows.withColumn("y", F.col("x") + F.sqrt(-2.0 * F.log(u(0))) * F.cos(2 * F.pi() * u(1)) * level)


def ambient_noise(rows: DataFrame, key: str, noise: DataFrame, snr_db: float) -> DataFrame:
    """A noise signal (pos, x), repeated to the signal's length, at a signal-to-noise ratio; a silent noise adds nothing."""
    n, strength = noise.agg(F.max("pos") + 1, F.avg(F.col("x") * F.col("x"))).first()
    if not n or not strength:
        return rows.withColumn("y", F.col("x"))
    tiled = rows.join(noise.select(F.col("pos").alias("__p"), F.col("x").alias("__n")), F.pmod("pos", F.lit(n)) == F.col("__p"), "left")
    level = F.sqrt(F.avg(F.col("x") * F.col("x")).over(Window.partitionBy(key)) / strength / 10 ** (snr_db / 10))
    return tiled.withColumn("y", F.col("x") + F.coalesce("__n", F.lit(0.0)) * level).drop("__p", "__n")


def augment(rows: DataFrame, key: str, rate: int, kind: str = "white_noise", snr_db: float = 20.0, noise: DataFrame | None = None) -> DataFrame:
    """key, pos, x after white_noise, ambient_noise (where a noise is given), reverb or combined; any other kind changes nothing."""
    as_x = lambda d: d.select(key, "pos", F.col("y").alias("x"))
    if kind == "white_noise":
        return as_x(white_noise(rows, key, snr_db))
    if kind == "ambient_noise" and noise is not None:
        return as_x(ambient_noise(rows, key, noise, snr_db))
    if kind == "reverb":
        return as_x(reverb(rows, key, rate))
    if kind == "combined":
        return as_x(reverb(as_x(white_noise(rows, key, snr_db + 5)), key, rate, 0.3))
    return rows.select(key, "pos", "x")


def tone(spark, seconds: float, rate: int = 16_000, hz: float = 440.0, level: float = 0.05) -> DataFrame:
    return spark.range(int(seconds * rate)).select(F.lit("tone").alias("audio_id"), F.col("id").alias("pos"), (F.sin(2 * F.pi() * hz * F.col("id") / rate) * level).alias("x"))
