"""As-of joins in either direction, built from windows over bounded stretches of time.

Both sides are cut into time buckets. Within a bucket a window finds the neighbour; what a bucket does not hold is
carried over from the nearest earlier one, found among one summary row for each bucket that has any. So an entity
that holds a third of all rows is spread over as many tasks as it has buckets, and no pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_US = 86_400_000_000
HOUR_US = DAY_US // 24


def _bucket(us: Column, width: int) -> Column:
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("long")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: list[str],
    left_time: str,
    right_time: str,
    take: list[str],
    order: list[Column] | None = None,
    direction: str = "backward",
    inclusive: bool = True,
    prefix: str = "matched_",
    bucket_us: int = DAY_US,
) -> DataFrame:
    """Every left row with the columns take of the nearest right row of the same entity, before it or after it.

    backward takes the latest right row not after the left one's time, forward the earliest not before it;
    with inclusive false equal times do not match. Of right rows at the same time the first by order wins (columns
    of right; by default the taken columns). The result has all left columns, and those taken and the right time
    under prefix, null where there is no match. Left rows with a null entity or time match nothing, right ones are ignored.
    """
    sign = 1 if direction == "backward" else -1
    us = lambda c: F.unix_micros(c) * sign
    ties = order if order is not None else [F.col(c) for c in take]
    names = [*take, right_time]
    packed = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in names])
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    right_rows = right.where(known & F.col(right_time).isNotNull())
    # One right row for each entity and time: the first of its ties. The hash of the entity, never null, is what rows are dealt by.
    hashed = F.xxhash64(*by).alias("_key")
    first = F.min_by(packed, F.struct(*ties, *[F.col(c) for c in names]))
    points = right_rows.groupBy(*by, us(right_time).alias("_us")).agg(first.alias("_take")).select("*", hashed, _bucket(F.col("_us"), bucket_us).alias("_bucket"))
    ends = points.groupBy("_key", *by, "_bucket").agg(F.max_by("_take", "_us").alias("_end"))
    lefts = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("_row"), *by, us(left_time).alias("_us"))
    lefts = lefts.select("*", hashed, _bucket(F.col("_us"), bucket_us).alias("_bucket"))

    # What each bucket of left rows gets from earlier buckets.
    needed = lefts.where("_bucket IS NOT NULL").select("_key", *by, "_bucket").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    steps = ends.withColumn("_rank", F.lit(1)).unionByName(needed.withColumn("_rank", F.lit(0)))
    over = Window.partitionBy("_key", *by).orderBy("_bucket", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("_carried", F.last("_end", ignorenulls=True).over(over)).where("_rank = 0 AND _carried IS NOT NULL")
    carried = carried.select("_key", "_bucket", "_carried", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(by)])

    # Within the bucket. At equal times right rows come before left ones if they match them, else after.
    side = 1 if inclusive else -1
    common = ["_key", *by, "_bucket", "_us"]
    both = points.select(*common, "_take", F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row")).unionByName(
        lefts.select(*common, F.lit(None).cast(points.schema["_take"].dataType).alias("_take"), F.lit(side).alias("_side"), "_row")
    )
    # Dealt once for the window and for the join with what is carried over.
    inside = Window.partitionBy("_key", *by, "_bucket").orderBy("_us", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.repartition("_key", "_bucket").withColumn("_found", F.last("_take", ignorenulls=True).over(inside)).where("_side <> 0")
    same = (found["_key"] == carried["_key"]) & (found["_bucket"] == carried["_bucket"])
    for i, c in enumerate(by):
        same = same & (found[c] == F.col(f"_c{i}"))
    joined = found.join(carried, same, "left")
    return joined.select("_row.*", F.coalesce("_found", "_carried").alias("_pick")).select("*", "_pick.*").drop("_pick")


def within(matched: Column, anchor: Column, days: int) -> Column:
    """Whether a matched time is at most so many days from its anchor, either way."""
    return F.abs(F.unix_micros(matched) - F.unix_micros(anchor)) <= F.lit(days * DAY_US)


def numbered(events: DataFrame, by: str | list[str], time: str, key: str, bucket_us: int = HOUR_US) -> DataFrame:
    """events with _rank: their number in their entity by (time, key), from 1, counted bucket by bucket.

    Rows with a null entity or time are left out.
    """
    by = [by] if isinstance(by, str) else by
    known = F.col(time).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    rows = events.where(known).withColumn("_bucket", _bucket(F.unix_micros(time), bucket_us))
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(time, key))
    return rows.join(offsets, [*by, "_bucket"]).withColumn("_rank", F.col("_before") + inside).drop("_bucket", "_before")


def running_total(events: DataFrame, by: list[str], us: str, order: str, value: str, bucket_us: int = HOUR_US) -> DataFrame:
    """events with _total: the sum of value over the rows of the entity up to and with a row, by (us, order), counted bucket by bucket.

    Rows that are equal in both count together. Rows with a null entity or time are left out.
    """
    known = F.col(us).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    rows = events.where(known).withColumn("_bucket", _bucket(F.col(us), bucket_us))
    sums = rows.groupBy(*by, "_bucket").agg(F.sum(value).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*by, "_bucket").orderBy(us, order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(offsets, [*by, "_bucket"]).withColumn("_total", F.col("_before") + inside).drop("_bucket", "_before")
