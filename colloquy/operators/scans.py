"""Running values, moving windows and order statistics of keys of any size: one long recording is no single task.

A window ordered within a key puts the whole key into one task.  Here a key
with more than ``block`` rows is cut into parts at quantiles of its order, which
a sketch finds.  A scan has two levels: running values within each part, and the
carry of all parts before it, which is a scan over one row for each part.  Keys
that fit stay one part, so a table of short recordings costs what a window does.
Which way is taken doesn't change a result (but for the last digits of sums of doubles).

A row's part depends on the first column of the order alone, so rows that tie in
it stay together; that column must not be constant over a long key.  Null orders
come first, in the key's first part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import materialize

#: Rows of a part of a key.
BLOCK = 1_000_000
#: The sketch's ranks are right within 1 / ACCURACY of a key's rows; a key has at most half as many parts.
ACCURACY = 10_000
#: Numbers (cuts, brackets) that are sent to every task; beyond it they are joined by a shuffle.
BROADCAST_NUMBERS = 1_000_000


def _beside(rows: DataFrame, about: DataFrame, keys: list[str], numbers: int) -> DataFrame:
    """``rows`` with what ``about`` says of their key (null keys are keys too); null where it says nothing."""
    there = about.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in about.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    small = F.broadcast(there) if about.count() * max(1, numbers) <= BROADCAST_NUMBERS else there
    return rows.join(small, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def long_keys(rows: DataFrame, keys: list[str], block: int) -> DataFrame | None:
    """The keys with more than ``block`` rows and their number of rows ``n``; None if there are none."""
    sizes = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))
    return sizes if sizes.head(1) else None


def parted(rows: DataFrame, keys: list[str], order: str, block: int = BLOCK) -> DataFrame:
    """Adds ``part``: 0, 1, .. in the order of ``order`` within the keys, each of about ``block`` rows."""
    sizes = long_keys(rows, keys, block)
    if sizes is None:
        return rows.withColumn("part", F.lit(0))
    most = sizes.agg(F.max("n")).first()[0]
    wanted = min(ACCURACY // 2, max(2, -(-most // block)))
    shares = F.array(*[F.lit(k / wanted) for k in range(1, wanted)])
    long = _beside(rows, sizes.withColumn("long", F.lit(True)).drop("n"), keys, 1).where("long").drop("long")
    cuts = materialize(long.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(order, shares, ACCURACY)).alias("cuts")))
    found = _beside(rows, cuts, keys, wanted)
    part = F.when(F.col("cuts").isNull() | F.col(order).isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < F.col(order))))
    return found.withColumn("part", part).drop("cuts")


def scan(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Of rows with ``part``: sums and maxima of expressions over all rows of the key before each one (0 and null before the first)."""
    sums, maxima = sums or {}, maxima or {}
    names = [*sums, *maxima]
    inner = rows.withColumns({f"__x_{n}": c for n, c in {**sums, **maxima}.items()})
    total = lambda n: F.sum if n in sums else F.max
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = inner.groupBy(*keys, "part").agg(*[total(n)(f"__x_{n}").alias(f"__c_{n}") for n in names])
    carry = carry.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "part"])], *[total(n)(f"__c_{n}").over(earlier).alias(f"__c_{n}") for n in names])
    before = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = inner.withColumns({f"__l_{n}": total(n)(f"__x_{n}").over(before) for n in names})
    same = F.lit(True)
    for i, k in enumerate([*keys, "part"]):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = {n: F.coalesce(f"__c_{n}", F.lit(0)) + F.coalesce(f"__l_{n}", F.lit(0)) for n in sums} | {n: F.greatest(f"__c_{n}", f"__l_{n}") for n in maxima}
    helpers = [f"__{p}_{n}" for p in "xcl" for n in names] + [f"__k{i}" for i in range(len(keys) + 1)]
    return local.join(carry, same, "left").withColumns(out).drop(*helpers)


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """``scan`` of rows that have no parts yet."""
    return scan(parted(rows, keys, order[0], block), keys, order, sums, maxima).drop("part")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, block: int = BLOCK) -> DataFrame:
    """Adds the place of each row within its key, from 0."""
    return running(rows, keys, order, {name: F.lit(1).cast("long")}, block=block)


def moving_sum(rows: DataFrame, key: str, order: str, value: Column, before: int, behind: int, name: str, block: int = BLOCK) -> DataFrame:
    """The sum of a value over the rows from ``before`` rows earlier to ``behind`` rows later.

    Long keys are cut into blocks of places; rows near a border go to the block beside it as well.
    """
    frame = lambda w: F.sum("__v").over(w.orderBy(order).rowsBetween(-before, behind))
    rows = rows.withColumn("__v", value)
    if long_keys(rows, [key], block) is None:
        return rows.withColumn(name, frame(Window.partitionBy(key))).drop("__v")
    block = max(block, before + behind + 1)
    placed = numbered(rows, [key], [order], "__at", block)
    own = F.floor(F.col("__at") / block)
    beside = F.array(own, F.floor((F.col("__at") - behind) / block), F.floor((F.col("__at") + before) / block))
    spread = placed.withColumn("__own", own).withColumn("__block", F.explode(F.array_distinct(beside)))
    out = spread.withColumn(name, frame(Window.partitionBy(key, "__block")))
    return out.where("__block = __own").drop("__v", "__at", "__own", "__block")


def order_statistics(rows: DataFrame, keys: list[str], value: str, shares: list[float], ranks) -> DataFrame:
    """keys, n (rows with a value) and ``at``: for each share the values at the ranks (from 0) that ``ranks(n, share)`` names, a list of columns.

    A rank must lie within one row of ``share`` times n.  A sketch brackets each share, one pass counts the rows
    under the bracket, and only the values in the bracket (a few of ACCURACY parts of a long key) are put in order,
    equal ones as one row; so nothing that is held grows with a key.
    """
    margin = 3 / ACCURACY
    there = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    ends = F.percentile_approx("v", F.array(*[F.lit(min(1.0, max(0.0, s + m))) for s in shares for m in (-margin, margin)]), ACCURACY)
    about = there.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), ends.alias("e"))
    few = F.col("n") <= ACCURACY
    bracket = lambda k, end: F.when(few, F.col(end)).otherwise(F.col("e")[2 * k + (end == "hi")])
    about = materialize(about.select(*keys, "n", *[bracket(k, end).alias(f"{end}{k}") for k in range(len(shares)) for end in ("lo", "hi")]))
    joined = _beside(there, about, keys, 2 * len(shares) + 1)
    inside = [F.col("v").between(F.col(f"lo{k}"), F.col(f"hi{k}")) for k in range(len(shares))]
    any_inside = inside[0]
    for c in inside[1:]:
        any_inside = any_inside | c
    # one row for each value in a bracket, and one for all others of the key
    counts = joined.groupBy(*keys, F.when(any_inside, F.col("v")).alias("v")).agg(
        F.count(F.lit(1)).alias("m"), *[F.sum((F.col("v") < F.col(f"lo{k}")).cast("long")).alias(f"under{k}") for k in range(len(shares))],
        F.first("n").alias("n"), *[F.first(c.cast("int")).alias(f"in{k}") for k, c in enumerate(inside)],
    )
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v"))
    seen = counts.withColumns({f"c{k}": F.sum(f"under{k}").over(whole) + F.sum(F.when((F.col(f"in{k}") == 1) & F.col("v").isNotNull(), F.col("m")).otherwise(0)).over(upto) for k in range(len(shares))})
    at = [F.min(F.when((F.col(f"in{k}") == 1) & F.col("v").isNotNull() & (F.col(f"c{k}") > r), F.col("v"))) for k, s in enumerate(shares) for r in ranks(F.col("n"), s)]
    return seen.groupBy(*keys, "n").agg(F.array(*at).alias("at"))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, n and ``q``: exact percentiles, linear between neighbours."""
    place = lambda n, s: (n - 1) * F.lit(s)
    got = order_statistics(rows, keys, value, shares, lambda n, s: [F.floor(place(n, s)), F.ceil(place(n, s))])
    low, high = (lambda k: F.col("at")[2 * k]), (lambda k: F.col("at")[2 * k + 1])
    part = lambda s: place(F.col("n"), s) - F.floor(place(F.col("n"), s))
    return got.select(*keys, "n", F.array(*[low(k) + part(s) * (high(k) - low(k)) for k, s in enumerate(shares)]).alias("q"))
