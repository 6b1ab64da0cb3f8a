"""Order statistics of whole tables without a task that sorts or holds all rows.

Values are counted by range, and only the range that holds what is asked for is looked at more closely.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftline.functions.moments import over

#: Ranges of values in which sums are accumulated independently, and into which a range is cut when a rank is looked for.
RANGES, BINS = 256, 4096


def quantiles(rows: DataFrame, columns: list[str], shares: list[float], by: str | None = None) -> DataFrame:
    """by, column, share, value: exact quantiles of columns, between two ranks by linear interpolation, nulls left out.

    Meant for few groups (``by``; null is one): for each of them, each column and each share a row comes to the driver.  A pass counts,
    for all of them together, the values in BINS equal bins of the ranges that still hold a wanted rank, and keeps the bin with the rank,
    narrowed to the least and the greatest value in it; passes end where these are one value.
    """
    spark = rows.sparkSession
    g = F.col(by) if by else F.lit(0)
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for k, c in enumerate(columns)]))
    x = rows.select(g.alias("g"), stacked.alias("s")).select("g", "s.*").where("v IS NOT NULL")
    kind = dict(x.dtypes)["g"]
    wanted, found = {}, {}
    for r in x.groupBy("g", "c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        for s in shares:
            at = found[r["g"], r["c"], s] = s * (r["n"] - 1)
            for rank in {math.floor(at), math.ceil(at)}:
                wanted[r["g"], r["c"], rank] = (r["low"], r["high"], 0)
    values = {}
    while True:
        values |= {k: low for k, (low, high, _) in wanted.items() if low == high}
        wanted = {k: w for k, w in wanted.items() if k not in values}
        if not wanted:
            break
        keys = list(wanted)
        targets = spark.createDataFrame([(n, k[0], k[1], *wanted[k][:2], k[2] - wanted[k][2]) for n, k in enumerate(keys)], f"n int, tg {kind}, tc int, low double, high double, rank long")
        # two rows at most for each group, column and share
        hit = x.join(F.broadcast(targets), F.col("g").eqNullSafe(F.col("tg")) & (F.col("c") == F.col("tc"))).where("v >= low AND v <= high")
        # halves, so that the width of a range can't overflow
        bin_ = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS), F.lit(BINS - 1))
        counted = hit.groupBy("n", "rank", bin_.alias("bin")).agg(F.count("*").alias("k"), F.min("v").alias("low"), F.max("v").alias("high"))
        place = counted.withColumn("upto", F.sum("k").over(Window.partitionBy("n").orderBy("bin"))).where("rank < upto AND rank >= upto - k")
        for r in place.collect():
            k = keys[r["n"]]
            low, high, before = r["low"], r["high"], wanted[k][2] + r["upto"] - r["k"]
            if (low, high) == wanted[k][:2] and high == math.nextafter(low, math.inf):  # two values that a bin can't part
                least = x.where(F.col("g").eqNullSafe(F.lit(k[0]).cast(kind)) & (F.col("c") == k[1]) & (F.col("v") == low)).count()
                low = high = low if k[2] - before < least else high
            wanted[k] = (low, high, before)
    out = []
    for (group, c, share), at in found.items():
        a, b = values[group, c, math.floor(at)], values[group, c, math.ceil(at)]
        out.append((group, columns[c], share, a + (b - a) * (at - math.floor(at))))
    return spark.createDataFrame(out, f"{by or 'g'} {kind}, column string, share double, value double")


def with_quantiles(grouped: DataFrame, rows: DataFrame, named: dict[str, tuple[str, float]], by: str | None = None) -> DataFrame:
    """Adds named quantiles (name: column, share) to a table of a row per group, or of one row."""
    columns, shares = sorted({c for c, _ in named.values()}), sorted({s for _, s in named.values()})
    q = quantiles(rows, columns, shares, by)
    wide = q.groupBy(*([F.col(by).alias("_by")] if by else [])).agg(*[F.max(F.when((F.col("column") == c) & (F.col("share") == s), F.col("value"))).alias(n) for n, (c, s) in named.items()])
    # one row for each of few groups
    return grouped.join(F.broadcast(wide), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by") if by else grouped.join(F.broadcast(wide))


def running(each: DataFrame, value: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Adds run_<column>, the sum of a column up to and with its row, to a table of a row per distinct value.

    Sums run within RANGES ranges of values, each of about as many rows, and the ranges' own totals (RANGES rows) are added.
    """
    shares = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    cuts = sorted(set(each.agg(F.percentile_approx(value, shares, F.lit(100 * RANGES))).first()[0] or []))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0)
    dealt = each.withColumn("place", F.when(F.col(value).isNull(), -1).otherwise(place))
    totals = dealt.groupBy("place").agg(*[F.sum(c).alias(f"total_{c}") for c in sums])
    earlier = Window.orderBy(F.desc("place") if descending else F.asc("place")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("place", *[F.coalesce(F.sum(f"total_{c}").over(earlier), F.lit(0)).alias(f"before_{c}") for c in sums])
    own = Window.partitionBy("place").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(F.broadcast(before), "place").select(*each.columns, *[(F.col(f"before_{c}") + F.sum(c).over(own)).alias(f"run_{c}") for c in sums])


def ranked(rows: DataFrame, by: str, bucket: Column, order: list[Column]) -> DataFrame:
    """Adds r, the number from 1 of a row within its group of ``by`` in an order, and size, the group's rows.

    ``bucket`` must be a whole number that never falls along the order, of some ten thousand values at most.  Rows are counted by bucket;
    only within a bucket are they sorted.
    """
    x = rows.withColumn("bucket", bucket)
    counts = x.groupBy(by, "bucket").agg(F.count("*").alias("k"))
    group = Window.partitionBy(by)
    before = counts.select(by, "bucket", F.coalesce(F.sum("k").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("k").over(group).alias("size"))
    number = F.row_number().over(Window.partitionBy(by, "bucket").orderBy(*order))
    return x.join(F.broadcast(before), [by, "bucket"]).select(*rows.columns, (F.col("before") + number).alias("r"), "size")


def area_under(each: DataFrame, value: str) -> DataFrame:
    """Area under the ROC curve of a table (value, p: labels of 1, k: rows) with a row per distinct value."""
    below = F.col("run_k") - F.col("k")
    r = running(each, value, ["k"]).select("p", "k", (F.col("p") * (below + (F.col("k") + 1) / 2)).alias("r"))
    return r.agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum("k").alias("k")).select(over(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("k") - F.col("p"))).alias("auc"))
