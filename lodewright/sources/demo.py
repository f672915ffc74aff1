"""Deterministic synthetic touches and commits, made from a seed on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(seed: int, what: str, below: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(below))


def demo_commits(spark: SparkSession, n: int, projects: int = 5, files: int = 200, seed: int = 1) -> DataFrame:
    """commit_id, sha, project_id, author_name, author_email, authored_at, path, added, removed: one file for each commit."""
    start = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 600_000_000 + _draw(seed, "t", 600_000_000))
    who = _draw(seed, "a", 17).cast("string")
    return spark.range(n).select(
        F.col("id").alias("commit_id"), F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))).alias("sha"), (_draw(seed, "p", projects) + 1).alias("project_id"),
        F.concat(F.lit("author-"), who).alias("author_name"), F.concat(F.lit("a"), who, F.lit("@demo.example")).alias("author_email"), start.alias("authored_at"),
        F.concat(F.lit("m"), _draw(seed, "m", 9).cast("string"), F.lit("/f"), _draw(seed, "f", files).cast("string"), F.lit(".py")).alias("path"),
        _draw(seed, "+", 80).cast("int").alias("added"), _draw(seed, "-", 40).cast("int").alias("removed"),
    )


def demo_touches(spark: SparkSession, n: int, projects: int = 5, files: int = 200, seed: int = 1) -> DataFrame:
    """touch_id, session_id, project_id, file_path, touch_kind, confidence, occurred_at, commit_sha (null): what sessions did to the files of demo_commits().

    The touch of a number comes up to half an hour before the commit of that number, on its file.
    """
    commits = demo_commits(spark, n, projects, files, seed).withColumn("id", F.col("commit_id"))
    before = F.timestamp_micros(F.unix_micros("authored_at") - _draw(seed, "b", 1_800_000_000))
    kind = F.element_at(F.array(*map(F.lit, ("write", "write", "create", "delete", "read"))), (_draw(seed, "k", 5) + 1).cast("int"))
    return commits.select(
        F.col("id").alias("touch_id"), F.concat(F.lit("session-"), (F.col("id") / 20).cast("long").cast("string")).alias("session_id"), "project_id", F.col("path").alias("file_path"), kind.alias("touch_kind"),
        F.when(_draw(seed, "c", 4) > 0, 0.9).otherwise(0.5).alias("confidence"), before.alias("occurred_at"), F.lit(None).cast("string").alias("commit_sha"),
    )
