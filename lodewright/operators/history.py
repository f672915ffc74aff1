"""Version-control history: churn, authors, hotspots, bus factor, knowledge islands, cadence.

Inputs are commits (commit_id, project_id, author_name, author_email, authored_at) and commit_files (commit_id,
project_id, path, added, removed; null counts mark binary files and weigh nothing). Repeated commit_files rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodewright.functions.scores import rounded

# Thresholds of hotspots, the bus factor and islands.
TOP_HOTSPOTS, MIN_COMMITS, MIN_CHURN = 10, 3, 50
BUS_SHARE = 0.8
ISLAND_COMMITS, TOP_ISLANDS = 5, 10


def author_key() -> Column:
    """Who wrote a commit: the e-mail, else the name, in lower case."""
    blank_to_null = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.lower(F.coalesce(blank_to_null("author_email"), blank_to_null("author_name"), F.lit("unknown")))


def changes(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """project_id, path, commit_id, author, at, churn: one row for each file of each commit."""
    # Dealt by commit first: removing repeats and joining the commits then need no further exchange.
    files = commit_files.select("commit_id", "project_id", "path", "added", "removed").repartition("commit_id").distinct()
    who = commits.select("commit_id", author_key().alias("author"), F.col("authored_at").alias("at"))
    churn = F.coalesce("added", F.lit(0)).cast("long") + F.coalesce("removed", F.lit(0))
    return files.join(who, "commit_id").select("project_id", "path", "commit_id", "author", "at", churn.alias("churn"))


def file_churn(changed: DataFrame) -> DataFrame:
    """project_id, path, churn, commits, authors, first_seen.

    Folded by author first, so that the count of authors needs no expansion and a busy file shrinks before it moves.
    """
    by_author = changed.groupBy("project_id", "path", "author").agg(F.sum("churn").alias("churn"), F.count("*").alias("commits"), F.min("at").alias("first_seen"))
    return by_author.groupBy("project_id", "path").agg(
        F.sum("churn").alias("churn"), F.sum("commits").alias("commits"), F.count("*").alias("authors"), F.min("first_seen").alias("first_seen")
    )


def hotspots(churned: DataFrame, top: int = TOP_HOTSPOTS) -> DataFrame:
    """The hotspots of each project: of the 2 x top files with most churn those with enough commits and churn, at most top.

    Adds place (by churn, then path), composite and severity.
    """
    by_churn = Window.partitionBy("project_id").orderBy(F.desc("churn"), "path")
    most = churned.withColumn("_n", F.row_number().over(by_churn)).where(F.col("_n") <= 2 * top)
    composite = rounded(F.col("commits") * (1 + F.sqrt(F.col("churn").cast("double")) / 10), 1)
    kept = most.where((F.col("commits") >= MIN_COMMITS) & (F.col("churn") >= MIN_CHURN)).withColumn("composite", composite)
    severity = F.when(F.col("composite") > 80, "high").when(F.col("composite") > 40, "medium").otherwise("low")
    return kept.withColumns({"place": F.row_number().over(by_churn), "severity": severity}).where(F.col("place") <= top).drop("_n", "first_seen")


def author_commits(commits: DataFrame) -> DataFrame:
    """project_id, author, commits."""
    return commits.groupBy("project_id", author_key().alias("author")).agg(F.count("*").alias("commits"))


def bus_factor(authored: DataFrame, share: float = BUS_SHARE) -> DataFrame:
    """project_id, authors, commits, bus_factor: the fewest authors who made that share of the commits."""
    whole = Window.partitionBy("project_id")
    order = whole.orderBy(F.desc("commits"), "author").rowsBetween(Window.unboundedPreceding, 0)
    ranked = authored.withColumns(
        {"_sum": F.sum("commits").over(order), "_all": F.sum("commits").over(whole), "_n": F.row_number().over(whole.orderBy(F.desc("commits"), "author"))}
    )
    reached = F.min(F.when(F.col("_sum") / F.greatest(F.col("_all"), F.lit(1)) >= share, F.col("_n")))
    return ranked.groupBy("project_id").agg(F.count("*").alias("authors"), F.max("_all").alias("commits"), reached.cast("long").alias("bus_factor"))


def islands(churned: DataFrame, least: int = ISLAND_COMMITS) -> DataFrame:
    """project_id, path, commits, first_seen of the files of one author with enough commits."""
    return churned.where((F.col("authors") <= 1) & (F.col("commits") >= least)).select("project_id", "path", "commits", "first_seen")


def first_islands(lone: DataFrame, top: int = TOP_ISLANDS) -> DataFrame:
    """The islands of each project that changed first, at most top, with their place."""
    order = Window.partitionBy("project_id").orderBy("first_seen", "path")
    return lone.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("first_seen")


def cadence(commits: DataFrame, now: DataFrame | None = None, days: int = 90) -> DataFrame:
    """project_id, recent, prior, ratio of the commits in the last days and the days before; ratio is null without prior ones.

    now has project_id and now; by default it is the project's latest commit. Days are whole days of 86,400 s.
    """
    now = commits.groupBy("project_id").agg(F.max("authored_at").alias("now")) if now is None else now
    age = F.floor((F.unix_micros("now") - F.unix_micros("authored_at")) / F.lit(86_400_000_000))
    aged = commits.select("project_id", "authored_at").join(now, "project_id").select("project_id", age.alias("age"))
    out = aged.groupBy("project_id").agg(F.count_if(F.col("age") <= days).alias("recent"), F.count_if((F.col("age") > days) & (F.col("age") <= 2 * days)).alias("prior"))
    return out.withColumn("ratio", F.when(F.col("prior") > 0, rounded(F.col("recent") / F.col("prior"), 2)))


def totals(changed: DataFrame) -> DataFrame:
    """project_id, files_touched, total_churn."""
    per_file = changed.groupBy("project_id", "path").agg(F.sum("churn").alias("churn"))
    return per_file.groupBy("project_id").agg(F.count("*").alias("files_touched"), F.sum("churn").alias("total_churn"))


def score(hot: DataFrame, bus: DataFrame, lone: DataFrame) -> DataFrame:
    """project_id, score, ledger: 100 less the penalties for the top hotspot, the bus factor and the islands."""
    top = hot.where("place = 1").select("project_id", F.col("path").alias("_path"), F.col("composite").alias("_top"))
    count = lone.groupBy("project_id").agg(F.count("*").alias("_islands"))
    base = bus.join(top, "project_id", "left").join(count, "project_id", "left")
    hot_pen = F.least(F.lit(40.0), F.coalesce(F.col("_top") * 0.4, F.lit(0.0)))
    bus_pen = F.when(F.col("bus_factor") == 1, 35.0).when(F.col("bus_factor") == 2, 20.0).when(F.col("bus_factor") <= 4, 8.0).otherwise(0.0)
    lone_pen = F.least(F.lit(15.0), F.coalesce(F.col("_islands") * 1.5, F.lit(0.0)))
    one = lambda c: F.format_string("%.1f", c)
    ledger = F.array_compact(
        F.array(
            F.when(F.col("_top").isNotNull(), F.concat(F.lit("top hotspot '"), "_path", F.lit("' = "), one(F.col("_top")), F.lit(" (-"), one(hot_pen), F.lit(")"))),
            F.concat(F.lit("bus_factor = "), F.col("bus_factor").cast("string"), F.when(bus_pen > 0, F.concat(F.lit(" (-"), one(bus_pen), F.lit(")"))).otherwise(F.lit(" (healthy)"))),
            F.when(lone_pen > 0, F.concat(F.col("_islands").cast("string"), F.lit(" knowledge islands (-"), one(lone_pen), F.lit(")"))),
        )
    )
    return base.select("project_id", rounded(F.greatest(F.lit(0.0), 100 - hot_pen - bus_pen - lone_pen), 1).alias("score"), F.array_join(ledger, "; ").alias("ledger"))
