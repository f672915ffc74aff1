"""What recorded agent sessions did to files: links to commits, evidence, risk, shares of lines.

Touches have touch_id, session_id, project_id, file_path, touch_kind, confidence, occurred_at, commit_sha.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodewright.functions.scores import rounded
from lodewright.operators.asof import asof_join

WRITES = ("write", "create", "delete")


def link_forward(touches: DataFrame, history: DataFrame) -> DataFrame:
    """Each unlinked change with the first commit of its file at or after it: adds linked_commit_id and linked_at.

    history has project_id, path, commit_id, authored_at and, where known, committed_at. Of commits authored at the same time the
    one committed first counts, then the smallest id.
    Changes that no commit followed stay, with nulls: they are uncommitted.
    """
    open_changes = touches.where(F.col("touch_kind").isin(*WRITES) & F.col("commit_sha").isNull() & F.col("occurred_at").isNotNull()).distinct()
    later = history.select("project_id", F.col("path").alias("file_path"), "commit_id", "authored_at", *[c for c in ("committed_at",) if c in history.columns])
    ties = [F.col(c) for c in ("committed_at", "commit_id") if c in later.columns]
    linked = asof_join(
        open_changes, later, by=["project_id", "file_path"], left_time="occurred_at", right_time="authored_at", take=["commit_id"], order=ties, direction="forward", prefix="linked_"
    )
    return linked.withColumnRenamed("linked_authored_at", "linked_at")


def uncommitted(linked: DataFrame) -> DataFrame:
    """project_id, changes, uncommitted."""
    return linked.groupBy("project_id").agg(F.count("*").alias("changes"), F.count_if(F.col("linked_commit_id").isNull()).alias("uncommitted"))


def file_evidence(touches: DataFrame) -> DataFrame:
    """project_id, file_path, writes, reads, deletes, sessions, strength, last_write. Strength is 0 and last_write null after mere reads.

    Folded by session first, so that sessions are counted without expanding rows.
    """
    changed = F.col("touch_kind") != "read"
    by_session = touches.groupBy("project_id", "file_path", "session_id").agg(
        F.count_if(F.col("touch_kind").isin("write", "create")).alias("writes"), F.count_if(F.col("touch_kind") == "read").alias("reads"),
        F.count_if(F.col("touch_kind") == "delete").alias("deletes"), F.count_if(changed).alias("changes"),
        F.max(F.when(changed, F.col("confidence"))).alias("strength"), F.max(F.when(changed, F.col("occurred_at"))).alias("last_write"),
    )
    return by_session.groupBy("project_id", "file_path").agg(
        F.sum("writes").alias("writes"), F.sum("reads").alias("reads"), F.sum("deletes").alias("deletes"),
        F.count_if((F.col("changes") > 0) & F.col("session_id").isNotNull()).alias("sessions"), F.coalesce(F.max("strength"), F.lit(0.0)).alias("strength"), F.max("last_write").alias("last_write"),
    )


def weighted_risk(risks: DataFrame, evidence: DataFrame) -> DataFrame:
    """risks (project_id, file_path, base_risk, none negative) with their evidence and weighted_risk; files without evidence stay."""
    checked = F.when(F.col("base_risk") < 0, F.raise_error(F.lit("base risk must not be negative"))).otherwise(F.col("base_risk"))
    joined = risks.join(evidence, ["project_id", "file_path"], "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("writes", "reads", "deletes", "sessions")} | {"strength": F.coalesce("strength", F.lit(0.0))})
    return filled.withColumn("weighted_risk", rounded(checked * F.col("strength"), 2))


def commit_confidence(touches: DataFrame) -> DataFrame:
    """project_id, commit_sha, confidence: the most confident change linked to each commit."""
    linked = touches.where(F.col("commit_sha").isNotNull() & F.col("touch_kind").isin(*WRITES))
    return linked.groupBy("project_id", "commit_sha").agg(F.max("confidence").alias("confidence"))


def line_shares(lines: DataFrame, commits: DataFrame) -> DataFrame:
    """project_id, path, total, ai, human, unattributed (per cent) and confidence of each file.

    lines (project_id, path, sha, n_lines) says which commit left how many lines; commits is commit_confidence().
    A line of no agent's commit is unattributed: nothing here can tell that a person wrote it. Files without
    lines have no row.
    """
    marks = commits.select("project_id", F.col("commit_sha").alias("sha"), "confidence")
    marked = lines.join(marks, ["project_id", "sha"], "left")
    out = marked.groupBy("project_id", "path").agg(
        F.sum("n_lines").alias("total"), F.sum(F.when(F.col("confidence").isNotNull(), F.col("n_lines")).otherwise(0)).alias("_ai"), F.max("confidence").alias("confidence")
    )
    ai = rounded(F.col("_ai") / F.col("total") * 100, 2)
    return out.where("total > 0").select(
        "project_id", "path", "total", ai.alias("ai"), F.lit(0.0).alias("human"), rounded(100 - ai, 2).alias("unattributed"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )


def latest_per_key(rows: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where("_n = 1").drop("_n")
