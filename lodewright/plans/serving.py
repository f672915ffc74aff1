"""Queries of the read side: lists, semi and anti joins, metric windows, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodewright.functions.paths import module_of
from lodewright.functions.scores import rounded, severity_weight
from lodewright.functions.text import clean_text, log_safe, metric_path
from lodewright.operators import windows as w
from lodewright.plans.fusion import TOUCHES, touches
from lodewright.session import as_micros, table


def list_projects(spark, sf_dir):
    """Every project with its number of sessions and commits and the time of the last commit, the latest first; projects without any last."""
    sessions = table(spark, sf_dir, "sessions").groupBy("project_id").agg(F.count("*").alias("sessions"))
    commits = table(spark, sf_dir, "commits").groupBy("project_id").agg(F.count("*").alias("commits"), F.max("authored_at").alias("last_commit"))
    out = table(spark, sf_dir, "projects").select("project_id", "name").join(sessions, "project_id", "left").join(commits, "project_id", "left")
    filled = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sessions", "commits")})
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("last_commit"), "project_id"))
    return as_micros(filled.withColumn("place", place))


def list_commits(spark, sf_dir):
    """The newest 50 commits with their project's name."""
    names = table(spark, sf_dir, "projects").select("project_id", "name")
    newest = table(spark, sf_dir, "commits").orderBy(F.desc("authored_at"), "commit_id").limit(50)
    return as_micros(newest.join(names, "project_id").select("commit_id", "name", "sha", "authored_at"))


def list_touches_of_file(spark, sf_dir):
    """The newest touch of each project and kind."""
    rows = table(spark, sf_dir, "session_file_touches").where("occurred_at IS NOT NULL")
    order = Window.partitionBy("project_id", "touch_kind").orderBy(F.desc("occurred_at"), F.desc("touch_id"))
    return rows.distinct().withColumn("_n", F.row_number().over(order)).where("_n = 1").select("project_id", "touch_kind", "touch_id", "session_id")


def semi_touched_files(spark, sf_dir):
    """Files of commits that some session wrote, under the path the touch leads to."""
    written = touches(spark, sf_dir).where(F.col("touch_kind").isin("write", "create")).select("project_id", F.col("file_path").alias("path"))
    return table(spark, sf_dir, "commit_files").select("project_id", "path").distinct().join(written, ["project_id", "path"], "left_semi")


def anti_untouched_files(spark, sf_dir):
    """Files of commits that no session touched, under the path the touch leads to."""
    touched = touches(spark, sf_dir).select("project_id", F.col("file_path").alias("path"))
    return table(spark, sf_dir, "commit_files").select("project_id", "path").distinct().join(touched, ["project_id", "path"], "left_anti")


def three_way_latest(spark, sf_dir):
    """For each region the newest order of its customers."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    latest = orders.groupBy("n_regionkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.count("*").alias("orders"))
    return latest.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "o_orderkey", "orders")


def order_revenue(spark, sf_dir):
    """Revenue by flag and status of the line items shipped until September 1998."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(18,4)"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(price), 2).cast("double").alias("revenue"), F.sum("l_quantity").alias("quantity"))


# ---- metric windows


def _metrics(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("file"), F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("at"), "value")


def rolling_metric(spark, sf_dir):
    return w.rolling_mean(_metrics(spark, sf_dir), ["file"], "at", "value", "event_id").select("event_id", "rolling")


def metric_change(spark, sf_dir):
    return w.change(_metrics(spark, sf_dir), ["file", "metric"], "at", "value", "event_id").select("event_id", "delta")


def rank_effect(spark, sf_dir):
    """Files by the mean change of their metrics."""
    changes = w.change(_metrics(spark, sf_dir), ["file", "metric"], "at", "value", "event_id").where("delta IS NOT NULL")
    effect = changes.groupBy("file").agg(rounded(F.avg(F.col("delta").cast("decimal(18,4)")), 4).alias("effect"))
    return w.global_rank(effect, "effect")


def monthly_rollup(spark, sf_dir):
    by = table(spark, sf_dir, "commits").groupBy("project_id", F.date_format("authored_at", "yyyy-MM").alias("month"))
    return by.agg(F.count("*").alias("commits"), F.countDistinct("author_name").alias("authors"), F.count("author_email").alias("with_email"), F.max(F.length("message")).cast("bigint").alias("longest"))


def having_weighted_delta(spark, sf_dir):
    """Files with many samples whose values, weighted by the metric, sum high."""
    weight = F.when(F.col("metric") == "purchase", 2.0).otherwise(1.0)
    out = _metrics(spark, sf_dir).groupBy("file").agg(F.count("*").alias("n"), rounded(F.sum((F.col("value") * weight).cast("decimal(18,6)")), 3).alias("weighted"))
    return out.where((F.col("n") >= 50) & (F.col("weighted") > 100))


def debounce_bursts(spark, sf_dir):
    rows = _metrics(spark, sf_dir)
    return as_micros(w.bursts(rows, ["file"], "at", "6 hours"))


def rate_limit_hits(spark, sf_dir):
    return w.rate_limit(_metrics(spark, sf_dir), "file", "at", 3, 3600).select("event_id", "hits", "rejected")


def throttle_first(spark, sf_dir):
    return as_micros(w.first_per_window(_metrics(spark, sf_dir), ["metric"], "at", "event_id", "1 hour"))


# ---- sets


def _files_of(spark, sf_dir, when):
    changed = table(spark, sf_dir, "commit_files").join(table(spark, sf_dir, "commits").where(when).select("commit_id"), "commit_id")
    return changed.select("project_id", "path").distinct()


_EARLY, _LATE = "authored_at < timestamp'2025-01-01 00:00:00'", "authored_at >= timestamp'2025-01-01 00:00:00'"


def set_files_either(spark, sf_dir):
    return _files_of(spark, sf_dir, _EARLY).union(_files_of(spark, sf_dir, _LATE)).distinct()


def set_files_both(spark, sf_dir):
    return _files_of(spark, sf_dir, _EARLY).intersect(_files_of(spark, sf_dir, _LATE))


def set_files_gone(spark, sf_dir):
    return _files_of(spark, sf_dir, _EARLY).subtract(_files_of(spark, sf_dir, _LATE))


def set_status_changed(spark, sf_dir):
    """Projects whose most frequent status of decision records differs between records with a rationale and without."""
    rows = table(spark, sf_dir, "decisions").where("status IS NOT NULL AND project_id IS NOT NULL")
    rows = rows.withColumn("source", F.when(F.col("rationale").isNotNull(), "told").otherwise("bare"))
    n = rows.groupBy("project_id", "source", F.lower(F.trim("status")).alias("status")).agg(F.count("*").alias("n"))
    top = n.groupBy("project_id", "source").agg(F.min_by("status", F.struct(-F.col("n"), "status")).alias("status"))
    a, b = top.where("source = 'told'"), top.where("source = 'bare'").withColumnsRenamed({"status": "other", "source": "_s"})
    return a.join(b, "project_id").where("status <> other").select("project_id", "status", "other")


# ---- scalars


def text_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "session_events").where("content IS NOT NULL")
    marked = F.concat(F.lit("\x1b[1m\u202e\r"), F.col("content"), F.lit("\x1b]0;t\x07\x1b[0m\u200e"))
    return rows.select("delivery_id", F.md5(clean_text(marked).cast("binary")).alias("clean"), F.md5(log_safe(F.col("content"), 60).cast("binary")).alias("logged"))


def path_modules(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", module_of(F.col("doc_path")).alias("module"), metric_path(F.concat(F.lit("/"), F.col("doc_path"))).alias("label"))


def severity_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), F.left("o_orderpriority", F.lit(1)).cast("int")).alias("severity"))
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.max(severity_weight(F.col("severity"))).alias("weight"))


QUERIES = {
    f.__name__: f
    for f in (
        list_projects, list_commits, list_touches_of_file, semi_touched_files, anti_untouched_files, three_way_latest, order_revenue, rolling_metric, metric_change, rank_effect,
        monthly_rollup, having_weighted_delta, debounce_bursts, rate_limit_hits, throttle_first, set_files_either, set_files_both, set_files_gone, set_status_changed,
        text_clean, path_modules, severity_weights,
    )
}

_METRICS = "m as (select event_id, user_id as file, event_type as metric, ts as at_, value from events)"
_R = "cast(round(cast({} as decimal(38, 12)), {}) as double)"
_CHANGE = f"{_METRICS}, c as (select *, {_R.format('value - lag(value) over (partition by file, metric order by at_)', 4)} as delta from m)"
_SETS = """
early as (select distinct f.project_id, f.path from commit_files f join commits c using (commit_id) where c.authored_at < timestamptz '2025-01-01 00:00:00+00'),
late as (select distinct f.project_id, f.path from commit_files f join commits c using (commit_id) where c.authored_at >= timestamptz '2025-01-01 00:00:00+00')"""

ORACLE = {
    "list_projects": """
select *, row_number() over (order by last_commit desc nulls last, project_id) as place from (
  select p.project_id, p.name, coalesce(s.n, 0) as sessions, coalesce(c.n, 0) as commits, c.t as last_commit
  from projects p left join (select project_id, count(*) as n from sessions group by all) s on s.project_id = p.project_id
  left join (select project_id, count(*) as n, epoch_us(max(authored_at)) as t from commits group by all) c on c.project_id = p.project_id)""",
    "list_commits": "select c.commit_id, p.name, c.sha, epoch_us(c.authored_at) as authored_at from (select * from commits order by authored_at desc, commit_id limit 50) c join projects p using (project_id)",
    "list_touches_of_file": """select project_id, touch_kind, touch_id, session_id from (
  select *, row_number() over (partition by project_id, touch_kind order by occurred_at desc, touch_id desc) as n from (select distinct * from session_file_touches where occurred_at is not null)) where n = 1""",
    "semi_touched_files": f"with {TOUCHES} select distinct project_id, path from commit_files where (project_id, path) in (select (project_id, file_path) from touches where touch_kind in ('write', 'create'))",
    "anti_untouched_files": f"with {TOUCHES} select distinct f.project_id, f.path from commit_files f where not exists (select 1 from touches t where t.project_id = f.project_id and t.file_path = f.path)",
    "three_way_latest": """
select r_name, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, count(*) as orders
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name""",
    "order_revenue": """
select l_returnflag, l_linestatus, count(*) as n, cast(round(sum(cast(l_extendedprice as decimal(18, 4)) * (1 - cast(l_discount as decimal(18, 4)))), 2) as double) as revenue, sum(l_quantity) as quantity
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""",
    "rolling_metric": f"with {_METRICS} select event_id, {_R.format('avg(value) over (partition by file order by at_ rows between 4 preceding and current row)', 4)} as rolling from m",
    "metric_change": f"with {_CHANGE} select event_id, delta from c",
    "rank_effect": f"""with {_CHANGE} select file, effect, rank() over (order by effect desc) as place from (
  select file, {_R.format('cast(sum(cast(delta as decimal(18, 4))) as decimal(38, 16)) / count(*)', 4)} as effect from c where delta is not null group by all)""",
    "monthly_rollup": """select project_id, strftime(timezone('UTC', authored_at), '%Y-%m') as month, count(*) as commits, count(distinct author_name) as authors,
       count(author_email) as with_email, max(length(message)) as longest from commits group by all""",
    "having_weighted_delta": f"""with {_METRICS} select file, count(*) as n, {_R.format("sum(cast(value * case when metric = 'purchase' then 2.0::double else 1.0::double end as decimal(18, 6)))", 3)} as weighted
from m group by all having count(*) >= 50 and weighted > 100""",
    "debounce_bursts": f"""with {_METRICS},
marked as (select *, case when at_ - lag(at_) over (partition by file order by at_) <= interval 6 hour then 0 else 1 end as fresh from m),
numbered as (select *, sum(fresh) over (partition by file order by at_ rows unbounded preceding) as k from marked)
select file, epoch_us(min(at_)) as starts_at, epoch_us(max(at_) + interval 6 hour) as ends_at, count(*) as n from numbered group by file, k""",
    "rate_limit_hits": f"""with {_METRICS} select event_id, hits, hits > 3 as rejected from (
  select event_id, count(*) over (partition by file order by epoch_us(at_) range between 3599999999 preceding and current row) as hits from m)""",
    "throttle_first": f"with {_METRICS} select metric, epoch_us(date_trunc('hour', at_)) as starts_at, arg_min(event_id, (at_, event_id)) as event_id from m group by all",
    "set_files_either": f"with {_SETS} select * from early union select * from late",
    "set_files_both": f"with {_SETS} select * from early intersect select * from late",
    "set_files_gone": f"with {_SETS} select * from early except select * from late",
    "set_status_changed": """
with n as (select project_id, case when rationale is not null then 'told' else 'bare' end as source, lower(trim(status)) as status, count(*) as n from decisions where status is not null and project_id is not null group by all),
top as (select project_id, source, arg_min(status, (-n, status)) as status from n group by all)
select a.project_id, a.status, b.status as other from top a join top b using (project_id) where a.source = 'told' and b.source = 'bare' and a.status <> b.status""",
    "text_clean": r"""
select delivery_id, md5(chr(13) || regexp_replace(content, '\x1B\[[0-9;?]*[ -/]*[@-~]|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|[\x{202A}-\x{202E}\x{2066}-\x{2069}]', '', 'g') || chr(8206)) as clean,
       md5(case when length(p) > 60 then left(p, 60) || '...[truncated]' else p end) as logged
from (select *, regexp_replace(content, '[\x00-\x1F\x7F]', '', 'g') as p from session_events where content is not null)""",
    "path_modules": r"""select doc_id, regexp_replace(doc_path, '([^/.])\.[^./]+$', '\1') as module, '/' || regexp_replace(doc_path, '([/-])\d+([/.]|$)', '\1{id}\2', 'g') as label from documents""",
    "severity_weights": """select case left(o_orderpriority, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '4' then 'low' else 'info' end as severity, count(*) as n,
       max(case left(o_orderpriority, 1) when '1' then 1.0 when '2' then 0.8 when '3' then 0.55 when '4' then 0.3 else 0.1 end::double) as weight from orders group by all""",
}
