"""The queries of the text operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.llm import mixing, nearest, packing, pii, reading
from lodewright.llm.tokens import token_count
from lodewright.session import cut_lineage, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = (table(spark, sf_dir, n) for n in ("session_file_touches", "commits", "commit_files", "projects"))
    return nearest.link_touches(*named).select("touch_id", "commit_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_mentions(table(spark, sf_dir, "session_events"), "delivery_id", "content")
    return found.select("delivery_id", "pii_type").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "session_events").select("delivery_id", "content"), "content")


def _document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cut_lineage(docs.select("doc_id", token_count(F.col("text")).alias("n_tokens")))


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_budgets(_document_sizes(spark, sf_dir), table(spark, sf_dir, "context_budgets"))


def p6_attention_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_windows under an attention capacity of a quarter of the squared tokens; a longer document or piece than half the window gets one to itself."""
    return packing.pack_budgets(_document_sizes(spark, sf_dir), table(spark, sf_dir, "context_budgets"), attention_share=0.25)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_windows(spark, sf_dir), table(spark, sf_dir, "context_budgets"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.draw_all(mixing.sizes(table(spark, sf_dir, "documents"), token_count(F.col("text"))), targets), targets


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares_reached(*_mixed(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents of the graders' language, and their labels."""
    return table(spark, sf_dir, "documents").where("lang = 'en'"), table(spark, sf_dir, "reading_labels")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document. Labels are for English only; documents in other languages are judged by models seeded by formula, those of unknown language by the model that knows most of their words."""
    english, labels = _labelled(spark, sf_dir)
    others = table(spark, sf_dir, "documents").where(~F.col("lang").eqNullSafe("en"))
    model = reading.train(english, labels)
    seeded = reading.seed(others, reading.lix_of_levels(english, labels))
    return reading.estimate(english, model).unionByName(reading.estimate(others, model, others=seeded))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    english, labels = _labelled(spark, sf_dir)
    return reading.estimate(english, reading.train(english, labels)).where("level = 5").select("doc_id")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every document, null where no word of its prose is known."""
    return _levels(spark, sf_dir).select("doc_id", "level", "level_margin")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source are of each level."""
    return _levels(spark, sf_dir).groupBy(mixing.same_source(F.col("source")).alias("source"), "level").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_redacted, p6_windows, p6_attention_windows, p6_fill, p7_documents, p7_shares, p8_found, p8_levels, p8_profile)}

#: The others cannot be expressed in SQL; their tests compare with brute force, round trips and held-out labels.
ORACLE: dict[str, str] = {
    "p3_found": r"""
with touch as (
  select distinct t.touch_id, t.project_id, t.occurred_at, p.path as root, replace(t.file_path, chr(92), '/') as f
  from session_file_touches t join projects p using (project_id)
  where t.touch_kind in ('write', 'create', 'delete') and t.occurred_at is not null and t.commit_sha is null),
steps as (
  select touch_id, project_id, occurred_at,
         list_filter(string_split(case when f like '/%' then f else root || '/' || f end, '/'), lambda x: x not in ('', '.')) as s
  from touch),
place as (
  select touch_id, project_id, occurred_at,
         list_reduce(list_prepend('', s), lambda a, x: case when x = '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end) as file
  from steps),
change as (
  select distinct c.commit_id, c.authored_at, f.project_id, p.path || '/' || f.path as file
  from commit_files f join commits c using (commit_id) join projects p on p.project_id = f.project_id),
pairs as (
  select t.touch_id, c.commit_id,
         row_number() over (partition by t.touch_id order by abs(epoch_us(c.authored_at) - epoch_us(t.occurred_at)), c.authored_at, c.commit_id) as n
  from place t join change c on c.project_id = t.project_id and c.file = t.file
   and c.authored_at between t.occurred_at - interval 30 minute and t.occurred_at + interval 30 minute)
select touch_id, commit_id from pairs where n = 1""",
}
