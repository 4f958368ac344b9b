"""Scans, moving sums and order statistics of long keys equal the plain window."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import evaluation, scans, segments, signals


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = [("long", i, rng.choice([1.0, 2.0, rng.random()]), float(rng.randrange(4000))) for i in range(5000)]
    out += [(k, i, float(i), float(i)) for k in ("a", "b", None) for i in range(40)] + [("one", None, 3.0, 1.0), ("one", 7, None, 2.0)]
    rng.shuffle(out)
    return spark.createDataFrame(out, "key string, pos long, x double, t double").repartition(6).cache()


@pytest.mark.parametrize("block", [100, 10**6])
def test_running_equals_the_window(rows, block):
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("key", "pos", F.round(F.coalesce(F.sum("x").over(w), F.lit(0.0)), 6).alias("s"), F.max("t").over(w).alias("m"), F.count(F.lit(1)).over(w).alias("n"))
    got = scans.running(rows, ["key"], ["pos"], {"s": F.col("x"), "n": F.lit(1)}, {"m": F.col("t")}, block)
    got = got.select("key", "pos", F.round("s", 6).alias("s"), "m", "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_long_key_is_cut_into_even_parts(rows):
    sizes = {(r["key"], r["part"]): r["count"] for r in scans.parted(rows, ["key"], "pos", 250).groupBy("key", "part").count().collect()}
    of_long = [n for (k, _), n in sizes.items() if k == "long"]
    assert len(of_long) == 20 and max(of_long) <= 300 and sum(of_long) == 5000
    assert all(p == 0 for k, p in sizes if k != "long")
    order = scans.parted(rows, ["key"], "pos", 250).where("key = 'long'").groupBy("part").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).orderBy("part").collect()
    assert all(x["b"] < y["a"] for x, y in zip(order, order[1:]))


@pytest.mark.parametrize("block", [100, 10**6])
def test_moving_average_equals_the_window(rows, block):
    some = rows.where("pos is not null and x is not null")
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(-15, 14)
    want = some.select("key", "pos", F.round(F.sum("x").over(w) / 30, 6).alias("smooth"))
    got = signals.moving_average(some, "key", F.col("x"), block=block).select("key", "pos", F.round("smooth", 6).alias("smooth"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("accuracy", [scans.ACCURACY, 50])
def test_percentiles_are_exact(rows, monkeypatch, accuracy):
    """With ties, tiny groups, nulls; with a coarse sketch the brackets do the work."""
    monkeypatch.setattr(scans, "ACCURACY", accuracy)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = rows.groupBy("key").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).where("q is not null")
    got = scans.percentiles(rows, ["key"], "x", shares).select("key", "q")
    tidy = lambda d: sorted((str(r["key"]), [round(x, 9) for x in r["q"]]) for r in d.collect())
    assert tidy(got) == tidy(want) and len(tidy(got)) == 5
    box = {r["condition"]: r for r in evaluation.box_stats(rows.withColumnRenamed("key", "condition"), "x").collect()}
    assert len(box) == 5 and box["a"]["median"] == 19.5 and box["one"]["q1"] == box["one"]["max"] == 3.0


def test_threshold_of_a_long_recording(rows, monkeypatch):
    monkeypatch.setattr(scans, "ACCURACY", 50)
    xs = sorted(r["x"] for r in rows.where("key = 'long'").collect())
    mean = sum(xs) / len(xs)
    sd = (sum((x - mean) ** 2 for x in xs) / len(xs)) ** 0.5
    got = {r["key"]: r["threshold"] for r in signals.adaptive_threshold(rows.where("x is not null"), "key", "x").collect()}
    assert abs(got["long"] - (xs[1500] + 0.5 * sd)) < 1e-9


@pytest.mark.parametrize("block", [50, 10**6])
def test_regions_of_a_long_recording(rows, block):
    regions = rows.select("key", F.col("t").alias("start"), (F.col("t") + F.coalesce("x", F.lit(0.0))).alias("end"))
    got = sorted((str(r["key"]), r["start"], r["end"]) for r in segments.merge_regions(regions, 0.2, ["key"], block).collect())
    want = []
    by = {}
    for r in regions.collect():
        by.setdefault(str(r["key"]), []).append((r["start"], r["end"]))
    for k, all_of in by.items():
        for s, e in sorted(all_of):
            if want and want[-1][0] == k and s - want[-1][2] <= 0.2:
                want[-1] = (k, want[-1][1], max(want[-1][2], e))
            else:
                want.append((k, s, e))
    assert got == sorted(want)
