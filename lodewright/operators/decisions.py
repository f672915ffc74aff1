"""Decisions: mined from commits and records, linked to one another and to files.

Decisions have decision_id, project_id, source, source_ref, summary, rationale, commit_sha.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.functions.text import ADR_NUMBER, ADR_REFERENCE, SHA_CITED, adr_fields, body, subject

# Confidence by kind of source, and the shortest citation of a sha.
ADR_CONFIDENCE, WITH_BODY, SUBJECT_ONLY = 0.95, 0.6, 0.3
SHORTEST_CITATION = 7


def commit_decisions(commits: DataFrame) -> DataFrame:
    """Each commit as a decision: its subject, its body as rationale (null without one), and confidence by whether it gave a reason."""
    why = body(F.col("message"))
    return commits.select(
        F.col("commit_id").alias("decision_id"), "project_id", F.lit("commit").alias("source"), F.left("sha", F.lit(12)).alias("source_ref"),
        F.coalesce(subject(F.col("message")), F.lit("(no subject)")).alias("summary"), why.alias("rationale"), F.col("sha").alias("commit_sha"),
        F.col("authored_at").alias("decided_at"), F.when(why.isNotNull(), WITH_BODY).otherwise(SUBJECT_ONLY).alias("confidence"),
    )


def record_decisions(records: DataFrame) -> DataFrame:
    """Decision records (project_id, path, text) with a title, as decisions; README files are no records."""
    found = records.where(~F.upper("path").endswith("README.MD") & F.col("text").isNotNull())
    fields = adr_fields(F.col("text"))
    out = found.select("project_id", F.lit("adr").alias("source"), F.col("path").alias("source_ref"), *[c.alias(k) for k, c in fields.items()], F.lit(ADR_CONFIDENCE).alias("confidence"))
    return out.where("summary IS NOT NULL")


def record_numbers(decisions: DataFrame) -> DataFrame:
    """project_id, number, decision_id of decision records that carry a number; of records with the same one the last counts."""
    number = F.coalesce(*[F.try_to_number(F.nullif(F.regexp_extract(c, ADR_NUMBER, 1), F.lit("")), F.lit("9999")).cast("int") for c in ("source_ref", "summary")])
    found = decisions.where("source = 'adr'").select("project_id", number.alias("number"), "decision_id").where("number IS NOT NULL")
    return found.groupBy("project_id", "number").agg(F.max("decision_id").alias("decision_id"))


def _text() -> Column:
    return F.concat(F.coalesce("summary", F.lit("")), F.lit("\n"), F.coalesce("rationale", F.lit("")))


def names_record(citing: DataFrame, decisions: DataFrame) -> DataFrame:
    """decision_id, related_decision_id: decisions of citing whose text names the number of a record of the same project."""
    cited = citing.select("decision_id", "project_id", F.explode(F.array_distinct(F.regexp_extract_all(_text(), F.lit(ADR_REFERENCE), F.lit(1)))).alias("_n"))
    numbers = record_numbers(decisions).withColumnsRenamed({"decision_id": "related_decision_id", "project_id": "_p"})
    joined = cited.join(numbers, cited.project_id.eqNullSafe(F.col("_p")) & (F.col("_n").cast("int") == F.col("number")))
    return joined.where("decision_id <> related_decision_id").select("decision_id", "related_decision_id").distinct()


def names_commit(citing: DataFrame, text: Column, commits: DataFrame, key: str) -> DataFrame:
    """key, commit_id: rows of citing (key, project_id) whose text cites the sha of a commit of the same project.

    A citation of 7 to 40 digits fits if it starts the sha or the sha starts it. Both are joined on their first 7
    digits, so no pairs are formed beyond those.
    """
    short = F.lit(SHORTEST_CITATION)
    cited = citing.select(key, "project_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(SHA_CITED), F.lit(1)))).alias("_ref"))
    cited = cited.withColumn("_start", F.left("_ref", short))
    known = commits.select("commit_id", F.col("project_id").alias("_p"), F.lower("sha").alias("_sha")).withColumn("_start", F.left("_sha", short))
    joined = cited.join(known, (cited["_start"] == known["_start"]) & cited["project_id"].eqNullSafe(known["_p"]))
    return joined.where(F.col("_sha").startswith(F.col("_ref")) | F.col("_ref").startswith(F.col("_sha"))).select(key, "commit_id").distinct()


def decision_files(decisions: DataFrame, commit_files: DataFrame) -> DataFrame:
    """decision_id, project_id, path: the files of each commit that is a decision."""
    files = commit_files.select("sha", "path").distinct()
    return decisions.where("commit_sha IS NOT NULL").select("decision_id", "project_id", F.col("commit_sha").alias("sha")).join(files, "sha").select("decision_id", "project_id", "path")


def neighbours(links: DataFrame) -> DataFrame:
    """decision_id, related: each link seen from both ends, once."""
    there = links.select("decision_id", F.col("related_decision_id").alias("related"))
    return there.union(links.select(F.col("related_decision_id"), F.col("decision_id"))).distinct()


def affecting_file(decisions: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """The decisions about one file: those that name it and those linked to it through their commit."""
    linked = files.where(F.col("path") == path).select("decision_id").distinct()
    return decisions.join(linked, "decision_id", "left_semi")


def without_files(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """The decisions that no file is linked to."""
    return decisions.join(files.select("decision_id").distinct(), "decision_id", "left_anti")


def one_per_reference(decisions: DataFrame) -> DataFrame:
    """Of decisions with the same source, reference and project the one with the smallest id; those without a reference all stay."""
    keyed, free = decisions.where("source_ref IS NOT NULL AND source_ref <> ''"), decisions.where("source_ref IS NULL OR source_ref = ''")
    first = keyed.groupBy("source", "source_ref", "project_id").agg(F.min("decision_id").alias("decision_id")).select("decision_id")
    return keyed.join(first, "decision_id", "left_semi").unionByName(free)
