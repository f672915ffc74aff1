"""The queries of the general data problems: unreadable lines, instants, redeliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.operators import dedup, instants, quarantine
from lodewright.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.unreadable_offsets(table(spark, sf_dir, "raw_lines")).select("line_id")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.unreadable(table(spark, sf_dir, "raw_lines")).select("line_id", "feed", "file_name", "line_no", "reason")


def p1_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.session_counts(table(spark, sf_dir, "raw_lines"))


def p1_touches_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.strict_load(table(spark, sf_dir, "raw_lines"), "touch_export").drop("_sum")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [
        ("session_events", table(spark, sf_dir, "session_events"), "delivery_id", "occurred_at"),
        ("sessions", table(spark, sf_dir, "sessions"), "session_id", "started_at"),
        ("decisions", table(spark, sf_dir, "decisions"), "decision_id", "decided_at"),
    ]
    return instants.unnormalised_instants(sources, table(spark, sf_dir, "projects"))


def p2_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision with its instant, null where the text names none."""
    rows = table(spark, sf_dir, "decisions").select("decision_id", "project_id", "decided_at")
    return instants.normalise(rows, "decided_at", table(spark, sf_dir, "projects")).select("decision_id", F.timestamp_micros("instant_us").alias("decided_on"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.redeliveries(table(spark, sf_dir, "session_events")).select("delivery_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_session_counts, p1_touches_loaded, p2_found, p2_decisions, p4_found)}

ORACLE = {
    "p4_found": r"""
select delivery_id from (
  select delivery_id, row_number() over (
    partition by source, regexp_replace(replace(lower(trim(external_id)), 'urn:uuid:', ''), '[{}-]', '', 'g'), seq, replace(lower(trim(content_hash)), 'sha256:', '')
    order by delivered_at, delivery_id) as n
  from session_events) where n > 1""",
}
