"""Pairing the records of two tables with the nearest in time of the same entity.

Both tables are cut by time range and by a hash of the entity; the right one reaches over each edge by
the tolerance, so every pair within it meets in exactly one group. Inside a group one binary search over
(entity, time) finds both neighbours of every left record. Ranges are as long as an occupied stretch of time
needs to hold its share of rows, so records far away in time do not stretch them. A crowded time is cut by the hash;
a group that is still too large, as that of a hot entity, is cut again at quantiles of its own times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.functions.paths import resolve_path
from lodewright.session import cut_lineage

#: The rows of a range, of both tables, over all slices; a group larger than this is cut again, into at most so many parts.
ROWS_PER_RANGE, MAX_PARTS = 800_000, 1024
SLICES = 32


def _codes(left: pd.DataFrame, right: pd.DataFrame, entity: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal entities, over both tables."""
    code = np.zeros(len(left) + len(right), dtype=np.int64)
    for name in entity:
        each, distinct = pd.factorize(pd.concat([left[name], right[name]], ignore_index=True))
        code, _ = pd.factorize(code * (len(distinct) + 1) + each)
    return code[: len(left)], code[len(left) :]


def _search(left: pd.DataFrame, right: pd.DataFrame, entity: list[str], tolerance_us: int) -> pd.DataFrame:
    left = left.drop_duplicates([*entity, "left_id", "us"])
    out = pd.DataFrame({"left_id": left["left_id"], "right_id": 0, "gap_us": 0})
    if not len(left) or not len(right):
        return out.iloc[:0]
    of_left, of_right = _codes(left, right, entity)
    left_us, right_us, right_id = (x.to_numpy() for x in (left["us"], right["us"], right["right_id"]))
    order = np.lexsort((right_id, right_us, of_right))
    of_right, right_us, right_id = of_right[order], right_us[order], right_id[order]
    first = np.r_[True, (of_right[1:] != of_right[:-1]) | (right_us[1:] != right_us[:-1])]
    of_right, right_us, right_id = of_right[first], right_us[first], right_id[first]
    times, ranks = np.unique(np.r_[left_us, right_us], return_inverse=True)
    left_key, right_key = of_left * (len(times) + 1) + ranks[: len(left)], of_right * (len(times) + 1) + ranks[len(left) :]
    after = np.searchsorted(right_key, left_key, side="right")
    none = np.iinfo(np.int64).max
    gaps = []
    for at in (after - 1, after):
        inside = np.clip(at, 0, len(right_key) - 1)
        there = (at >= 0) & (at < len(right_key)) & (of_right[inside] == of_left)
        gaps.append((inside, np.where(there, np.abs(right_us[inside] - left_us), none)))
    (before_at, before_gap), (after_at, after_gap) = gaps
    best = np.where(before_gap <= after_gap, before_at, after_at)
    found = np.minimum(before_gap, after_gap) <= tolerance_us
    out["right_id"], out["gap_us"] = right_id[best], right_us[best] - left_us
    return out[found]


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    entity: list[str],
    left_id: str,
    left_time: str,
    right_id: str,
    right_time: str,
    tolerance_us: int,
    rows_per_range: int = ROWS_PER_RANGE,
    slices: int = SLICES,
) -> DataFrame:
    """left_id, right_id, gap_us: for each left record the right one of its entity nearest in time.

    At most tolerance_us away, that distance included; at equal distance the earlier, then the smaller
    right_id. gap_us is negative where the right record is earlier. Left records without a partner, and
    records with a null entity, id or time, give no row. Repeated rows count once. Ids are long, times are
    timestamps. Only the named columns are read, so others may clash. Ranges hold about rows_per_range records of
    both tables and are at least four tolerances long, except in groups cut again, where a right record may be
    copied into several parts.
    """
    l_cut, r_cut = grouped(left, right, entity, left_id, left_time, right_id, right_time, tolerance_us, rows_per_range, slices)

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _search(a, b, entity, tolerance_us)

    keys = ["_range", "_slice", "_part"]
    return l_cut.groupBy(*keys).cogroup(r_cut.groupBy(*keys)).applyInPandas(pair, "left_id long, right_id long, gap_us long")


def grouped(
    left: DataFrame, right: DataFrame, entity: list[str], left_id: str, left_time: str, right_id: str, right_time: str, tolerance_us: int, rows_per_range: int, slices: int
) -> tuple[DataFrame, DataFrame]:
    """Both tables' entities, ids and times (us) with their groups _range, _slice and _part; right rows once for each group they may match in."""
    l_cols = left.select(*entity, F.col(left_id).cast("long").alias("left_id"), F.unix_micros(left_time).alias("us")).na.drop()
    r_cols = (
        right.select(*entity, F.col(right_id).cast("long").alias("right_id"), F.unix_micros(right_time).alias("us"))
        .na.drop()
        .groupBy(*entity, "us")
        .agg(F.min("right_id").alias("right_id"))
    )
    # Written once: they are counted before they are grouped.
    l_cols, r_cols = cut_lineage(l_cols), cut_lineage(r_cols)
    least = max(4 * tolerance_us, 1)
    times = l_cols.select("us").unionByName(r_cols.select("us"))
    seen = times.agg(F.count("*").alias("n"), F.approx_count_distinct(F.expr(f"(us - pmod(us, {least}L)) div {least}L")).alias("stretches")).first()
    per_stretch = max(seen["n"] / max(seen["stretches"], 1), 1e-9)
    width = least << min(max(int(np.log2(rows_per_range / per_stretch)), 0), 62 - int(least).bit_length())
    slices *= max(1, -(-int(per_stretch) // rows_per_range))

    def range_of(us: str) -> Column:
        return F.expr(f"(({us}) - pmod({us}, {width}L)) div {width}L")

    cut = F.pmod(F.xxhash64(*entity), F.lit(slices)).alias("_slice")
    l_cut = l_cols.select("*", cut, range_of("us").alias("_range"))
    edges = F.sequence(range_of(f"us - {tolerance_us}L"), range_of(f"us + {tolerance_us}L"))
    r_cut = r_cols.select("*", cut, F.explode(edges).alias("_range"))

    both = l_cut.select("_range", "_slice", "us").unionByName(r_cut.select("_range", "_slice", "us"))
    large = both.groupBy("_range", "_slice").agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_range)
    largest = large.agg(F.max("_n")).first()[0]
    if largest is None:
        return l_cut.withColumn("_part", F.lit(0)), r_cut.withColumn("_part", F.lit(0))
    parts = int(min(MAX_PARTS, 2 * -(-largest // rows_per_range)))
    at = F.percentile_approx("us", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(10 * parts))
    cuts = both.join(large.select("_range", "_slice"), ["_range", "_slice"]).groupBy("_range", "_slice").agg(F.array_distinct(at).alias("_edges"))

    def part_of(us: Column) -> Column:
        return F.coalesce(F.size(F.filter("_edges", lambda e: e <= us)), F.lit(0))

    l_cut = l_cut.join(cuts, ["_range", "_slice"], "left").withColumn("_part", F.when(F.col("_edges").isNull(), 0).otherwise(part_of(F.col("us")))).drop("_edges")
    near = F.sequence(part_of(F.col("us") - tolerance_us), part_of(F.col("us") + tolerance_us))
    r_cut = r_cut.join(cuts, ["_range", "_slice"], "left").withColumn("_part", F.explode(F.when(F.col("_edges").isNull(), F.array(F.lit(0))).otherwise(near))).drop("_edges")
    return l_cut, r_cut


def link_touches(
    touches: DataFrame, commits: DataFrame, commit_files: DataFrame, projects: DataFrame, tolerance_minutes: int = 30, **tuning: int
) -> DataFrame:
    """touch_id, commit_id, gap_us: the commit nearest in time of the file each unlinked change touched.

    Changes are touches of kind write, create or delete with an occurred_at and no commit_sha. Paths are
    compared as the absolute paths they lead to from projects.path.
    """
    roots = projects.select("project_id", F.col("path").alias("_root"))
    changes = touches.where(F.col("touch_kind").isin("write", "create", "delete") & F.col("commit_sha").isNull() & F.col("occurred_at").isNotNull())
    left = changes.join(roots, "project_id").select("touch_id", "project_id", "occurred_at", resolve_path(F.col("file_path"), F.col("_root")).alias("_file"))
    files = commit_files.select("commit_id", "project_id", F.col("path").alias("_path"))
    right = (
        files.join(commits.select("commit_id", "authored_at"), "commit_id")
        .join(roots, "project_id")
        .select("commit_id", "project_id", "authored_at", resolve_path(F.col("_path"), F.col("_root")).alias("_file"))
    )
    pairs = nearest_in_time(
        left, right, entity=["project_id", "_file"], left_id="touch_id", left_time="occurred_at", right_id="commit_id", right_time="authored_at",
        tolerance_us=tolerance_minutes * 60_000_000, **tuning,
    )
    return pairs.select(F.col("left_id").alias("touch_id"), F.col("right_id").alias("commit_id"), "gap_us")
