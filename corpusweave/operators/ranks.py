"""Ranks, quantiles and capped groups over whole tables without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.runtime import Staging

#: Parts that a group is ranked in first, ranges that a whole table is sorted by at most, and rows that are worth a range.
PARTS, RANGES, RANGE_ROWS = 64, 200, 16_384


def with_rank(df: DataFrame, order: str, tie: str) -> DataFrame:
    """df with `rank`, 0 for the least by `order`, then by `tie`.

    The table is written once, so that bounds of ranges are told without making it again, and then in ranges of `order`; the rows of each range are counted, and a row's rank is its place in its
    range after all rows of lesser ranges. Equal values stay in one range, so a value that most rows have is one task's."""
    staging = Staging(df.sparkSession)
    df = staging.write(df, "unranked")
    ranges = max(1, min(RANGES, -(-df.count() // RANGE_ROWS)))
    ranged = df.repartitionByRange(ranges, order, tie).withColumn("__range", F.spark_partition_id())
    rows = staging.write(ranged, "ranges")
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of the ranges
    before = counts.select("__range", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order, tie)) - 1
    return rows.withColumn("__place", place).join(F.broadcast(before), "__range").withColumn("rank", F.col("__place") + F.col("__before")).drop("__range", "__place", "__before")


def quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Exact quantile of the values that are not null, between neighbours in proportion; null without any.

    A sketch gives bounds that the two values asked for must lie between; the rows below are counted, and of those
    between the bounds as many as needed are taken in order."""
    values = df.select(F.col(col).cast("double").alias("x")).where("x is not null")
    n = values.count()
    if not n:
        return None
    at = q * (n - 1)
    lower, upper = values.agg(F.percentile_approx("x", [max(0.0, q - 2e-4), min(1.0, q + 2e-4)], 10_000)).first()[0]
    low = int(at)
    while True:
        below = values.where(F.col("x") < lower).count()
        upto = values.where(F.col("x") <= upper).count()
        if below <= low and upto > min(low + 1, n - 1):
            break
        span = max(upper - lower, abs(upper) * 1e-9, 1e-12)
        lower, upper = lower - span, upper + span
    same = values.where((F.col("x") >= lower) & (F.col("x") <= upper)).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    some = same.orderBy("x").limit(low + 2 - below).collect()
    pick = []
    for want in (low, min(low + 1, n - 1)):
        seen = below
        for r in some:
            seen += r.n
            if seen > want:
                pick.append(r.x)
                break
    return pick[0] + (pick[1] - pick[0]) * (at - low)


def first_of_groups(df: DataFrame, group: list[str], order: list[Column], limit: Column | int, part_key: str) -> DataFrame:
    """The first `limit` rows of each group with their `rank`, from 1.

    Groups are ranked in parts first, told by a hash of part_key, and what is left of the parts then as a whole, so a
    group that holds a third of all rows is ranked by many tasks."""
    parted = df.withColumn("__part", F.pmod(F.xxhash64(part_key), F.lit(PARTS)))
    some = parted.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))).where(F.col("rank") <= limit).drop("__part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= limit)
