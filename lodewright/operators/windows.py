"""Windows over metrics, rates and bursts of events. The batch forms of what streaming/ does incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodewright.functions.scores import rounded
from lodewright.operators.asof import numbered
from lodewright.session import cut_lineage

CHUNK_ROWS = 100_000


def _in_chunks(samples: DataFrame, by: list[str], time: str, key: str, lead_in: int) -> DataFrame:
    """samples cut along each entity's order into chunks of bounded size, each led in by the last rows of the one before.

    Adds _rank, _chunk and _lead, which is true for the rows that only lead in and must not come out. So windows over a few
    rows never hold a busy entity in one task.
    """
    ranked = numbered(samples, by, time, key).withColumn("_home", F.expr(f"(_rank - 1) div {CHUNK_ROWS}"))
    near_end = F.expr(f"(_rank - 1) % {CHUNK_ROWS}") >= CHUNK_ROWS - lead_in
    places = F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
    return ranked.withColumn("_chunk", F.explode(places)).withColumn("_lead", F.col("_chunk") != F.col("_home"))


def rolling_mean(samples: DataFrame, by: list[str], time: str, value: str, key: str, rows: int = 5) -> DataFrame:
    """samples with rolling: the mean of the value over a row and the rows - 1 before it, by time, then key.

    Rows with a null entity or time are left out; null values count for no mean.
    """
    cut = _in_chunks(samples, by, time, key, rows - 1)
    over = Window.partitionBy(*by, "_chunk").orderBy("_rank").rowsBetween(-(rows - 1), 0)
    return cut.withColumn("rolling", rounded(F.avg(value).over(over), 4)).where("NOT _lead").drop("_rank", "_home", "_chunk", "_lead")


def change(samples: DataFrame, by: list[str], time: str, value: str, key: str) -> DataFrame:
    """samples with delta to the sample before, null for the first. Rows with a null entity or time are left out."""
    cut = _in_chunks(samples, by, time, key, 1)
    before = F.lag(value).over(Window.partitionBy(*by, "_chunk").orderBy("_rank"))
    return cut.withColumn("delta", rounded(F.col(value) - before, 4)).where("NOT _lead").drop("_rank", "_home", "_chunk", "_lead")


def global_rank(rows: DataFrame, value: str, name: str = "place") -> DataFrame:
    """rows with their rank by value, the largest first, equal values alike, nulls without a rank.

    Each distinct value is counted first, so ties cost one row, and the values are dealt by ranges that hold about as many of
    them each, wherever they lie. What lies above a range is a sum over one number for each range.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    # Ranges are drawn anew whenever they are computed, so what was dealt is written before it is read twice.
    dealt = cut_lineage(counted.repartitionByRange(F.desc("_value")).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum("_n").alias("_of_part"))
    above = sums.select("_part", (F.sum("_of_part").over(Window.orderBy("_part")) - F.col("_of_part")).alias("_above"))
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy(F.desc("_value"))) - F.col("_n")
    places = dealt.withColumn("_inside", inside).join(above, "_part").select("_value", (F.col("_above") + F.col("_inside") + 1).alias(name))
    return rows.drop(name).join(places, F.col(value) == F.col("_value"), "left").drop("_value")


def bursts(events: DataFrame, key: list[str], time: str, gap: str = "2 seconds") -> DataFrame:
    """key, starts_at, ends_at, n: events of a key with at most a gap between them make one burst, which ends one gap after its last."""
    return events.groupBy(*key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*key, F.col("w.start").alias("starts_at"), F.col("w.end").alias("ends_at"), "n")


def rate_limit(events: DataFrame, key: str, time: str, limit: int, seconds: int = 60) -> DataFrame:
    """events with hits, those of the key in the seconds up to and with it, and rejected, whether they exceed the limit.

    Each key's time is cut into stretches of 60 such spans; the last span of a stretch also leads into the next one.
    """
    span = seconds * 1_000_000
    width = 60 * span
    us = F.unix_micros(time)
    timed = events.withColumn("_us", us).withColumn("_home", F.expr(f"(_us - pmod(_us, {width}L)) div {width}L"))
    places = F.when(F.expr(f"pmod(_us, {width}L)") >= width - span, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
    cut = timed.withColumn("_stretch", F.explode(places))
    over = Window.partitionBy(key, "_stretch").orderBy("_us").rangeBetween(-(span - 1), 0)
    return cut.withColumn("hits", F.count("*").over(over)).where("_stretch <=> _home").withColumn("rejected", F.col("hits") > limit).drop("_us", "_home", "_stretch")


def first_per_window(events: DataFrame, key: list[str], time: str, id_: str, width: str = "1 second") -> DataFrame:
    """key, starts_at and the id of the first event of each window: at most one goes through."""
    return events.groupBy(*key, F.window(time, width).alias("w")).agg(F.min_by(id_, F.struct(time, id_)).alias(id_)).select(*key, F.col("w.start").alias("starts_at"), id_)
