"""Writes to a store of tables, as expressions that give the new state of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new: on equal keys the new values win where they are not null. Keys are unique in both; nulls equal each other."""
    o, n = old.withColumnsRenamed({c: f"_o_{c}" for c in old.columns}), new.withColumnsRenamed({c: f"_n_{c}" for c in new.columns})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}"))
    return o.join(n, same, "full_outer").select(*[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) if c in new.columns else F.col(f"_o_{c}").alias(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys it has not; of repeated new keys one row, the smallest."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else new.distinct()
    seen = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return old.unionByName(once.join(seen, same, "left_anti").select(*old.columns))


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """old without the rows of every scope that new holds, and new."""
    scopes = new.select(*[F.col(k).alias(f"_n_{k}") for k in scope]).distinct()
    same = F.lit(True)
    for k in scope:
        same = same & F.col(k).eqNullSafe(F.col(f"_n_{k}"))
    return old.join(scopes, same, "left_anti").unionByName(new.select(*old.columns))


def delete_where(old: DataFrame, gone: Column) -> DataFrame:
    """old without the rows for which gone is true; a null condition keeps a row."""
    return old.where(~F.coalesce(gone, F.lit(False)))


def adopt_projects(rows: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """rows with a null project filled from their session; sessions has keys, unique, and project_id."""
    known = sessions.select(*keys, F.col("project_id").alias("_p"))
    return rows.join(known, keys, "left").withColumn("project_id", F.coalesce("project_id", "_p")).drop("_p")


def redacted(events: DataFrame, stored: Column) -> DataFrame:
    """events whose content is null wherever it must not be kept; hashes stay."""
    return events.withColumn("content", F.when(stored, F.col("content")))


def missing_tables(present: list[str], required: list[str]) -> list[str]:
    return [t for t in required if t not in set(present)]
