"""Queries that fuse sessions, commits, decisions and metrics.

Touches are used under the path they lead to. Metric samples are the rows of events: the type is the metric, the value its value,
and users are dealt to the projects. Anchors of consequences are commits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.functions.paths import resolve_path
from lodewright.operators import consequences as q
from lodewright.operators import evidence as e
from lodewright.operators import history as h
from lodewright.operators.asof import asof_join
from lodewright.session import as_micros, table


def touches(spark, sf_dir):
    """Touches with repeated rows once and the path relative to the project's root."""
    rows = table(spark, sf_dir, "session_file_touches").distinct()
    roots = table(spark, sf_dir, "projects").select("project_id", F.col("path").alias("_root"))
    joined = rows.join(roots, "project_id")
    return joined.withColumn("file_path", F.regexp_replace(resolve_path(F.col("file_path"), F.col("_root")), F.concat(F.lit("^"), F.col("_root"), F.lit("/")), F.lit(""))).drop("_root")


def _history(spark, sf_dir):
    files = table(spark, sf_dir, "commit_files").select("commit_id", "project_id", "path").distinct()
    return files.join(table(spark, sf_dir, "commits").select("commit_id", "authored_at", "committed_at"), "commit_id")


def samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 60 + 1).alias("project_id"), F.col("event_type").alias("metric"), "value", F.col("ts").cast("timestamp").alias("measured_at"))


def anchors(spark, sf_dir):
    """Commits, each about the first of its files by name."""
    files = table(spark, sf_dir, "commit_files").groupBy("commit_id").agg(F.min("path").alias("file_path"))
    return table(spark, sf_dir, "commits").join(files, "commit_id", "left").select(
        F.col("commit_id").alias("anchor_id"), "project_id", F.col("authored_at").alias("starts_at"), F.substring_index("message", "\n", 1).alias("summary"), "file_path"
    )


def risks(spark, sf_dir):
    """Base risk of the hotspots, 0 to 100."""
    hot = h.hotspots(h.file_churn(h.changes(table(spark, sf_dir, "commits"), table(spark, sf_dir, "commit_files"))))
    return hot.select("project_id", F.col("path").alias("file_path"), F.least(F.lit(100.0), "composite").alias("base_risk"))


def asof_forward_link(spark, sf_dir):
    linked = e.link_forward(touches(spark, sf_dir), _history(spark, sf_dir))
    return as_micros(linked.select("touch_id", "linked_commit_id", "linked_at"))


def asof_uncommitted(spark, sf_dir):
    return e.uncommitted(e.link_forward(touches(spark, sf_dir), _history(spark, sf_dir)))


def asof_backward_baseline(spark, sf_dir):
    return as_micros(q.baselines(anchors(spark, sf_dir), samples(spark, sf_dir)).select("anchor_id", "metric", "base_value", "base_measured_at"))


def asof_bounded_observed(spark, sf_dir):
    return as_micros(q.observations(anchors(spark, sf_dir), samples(spark, sf_dir)).select("anchor_id", "metric", "seen_value", "seen_measured_at"))


def asof_last_commit_before_turn(spark, sf_dir):
    """The commit of the project that was latest when each session's first touch happened."""
    first = table(spark, sf_dir, "session_file_touches").groupBy("session_id", "project_id").agg(F.min("occurred_at").alias("first_at"))
    return asof_join(
        first, table(spark, sf_dir, "commits"), by=["project_id"], left_time="first_at", right_time="authored_at", take=["commit_id"], inclusive=False
    ).select("session_id", "matched_commit_id")


def interval_confounders(spark, sf_dir):
    found = q.confounders(anchors(spark, sf_dir), touches=touches(spark, sf_dir))
    return found.select("anchor_id", "confounders", F.size("sample").cast("bigint").alias("listed"), F.get("sample", 0).alias("first"))


def file_confounders(spark, sf_dir):
    """Commits whose first file agent sessions changed in the 30 days after, with the number of these sessions."""
    return q.same_file_sessions(anchors(spark, sf_dir), touches(spark, sf_dir)).where("sessions > 0")


def consequence_delta(spark, sf_dir):
    return q.consequences(anchors(spark, sf_dir), samples(spark, sf_dir), touches=touches(spark, sf_dir))


def session_consequences(spark, sf_dir):
    """Sessions run from their first to their last touch; the decisions are commits."""
    spans = table(spark, sf_dir, "session_file_touches").groupBy("session_id", "project_id").agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"))
    commits = table(spark, sf_dir, "commits").select("project_id", F.col("commit_id").alias("decision_id"), F.col("authored_at").alias("decided_at"))
    return q.session_consequences(spans, commits, samples(spark, sf_dir))


def evidence_by_file(spark, sf_dir):
    return as_micros(e.file_evidence(touches(spark, sf_dir)))


def weighted_risk(spark, sf_dir):
    return as_micros(e.weighted_risk(risks(spark, sf_dir), e.file_evidence(touches(spark, sf_dir))))


def max_per_commit(spark, sf_dir):
    return e.commit_confidence(touches(spark, sf_dir))


def _shares(spark, sf_dir):
    files = table(spark, sf_dir, "commit_files").select("project_id", "path", "sha", F.col("added").cast("long").alias("n_lines")).distinct().where("n_lines > 0")
    return e.line_shares(files, e.commit_confidence(touches(spark, sf_dir)))


def share_split(spark, sf_dir):
    return _shares(spark, sf_dir)


def latest_touch_per_file(spark, sf_dir):
    latest = e.latest_per_key(touches(spark, sf_dir).where("occurred_at IS NOT NULL"), ["project_id", "file_path"], F.desc("occurred_at"), F.desc("touch_id"))
    return as_micros(latest.select("project_id", "file_path", "touch_id", "touch_kind", "occurred_at"))


QUERIES = {
    f.__name__: f
    for f in (
        asof_forward_link, asof_uncommitted, asof_backward_baseline, asof_bounded_observed, asof_last_commit_before_turn, interval_confounders, file_confounders, consequence_delta, session_consequences,
        evidence_by_file, weighted_risk, max_per_commit, share_split, latest_touch_per_file,
    )
}

TOUCHES = r"""
steps as (
  select t.*, p.path as root, list_filter(string_split(case when replace(file_path, chr(92), '/') like '/%' then replace(file_path, chr(92), '/')
           else p.path || '/' || replace(file_path, chr(92), '/') end, '/'), lambda x: x not in ('', '.')) as s
  from (select distinct * from session_file_touches) t join projects p using (project_id)),
touches as (
  select * exclude (s, root, file_path), case when starts_with(f, root || '/') then substr(f, length(root) + 2) else f end as file_path
  from (select *, list_reduce(list_prepend('', s), lambda a, x: case when x = '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end) as f from steps))"""
HISTORY = """
history as (
  select f.project_id, f.path, f.commit_id, c.authored_at, c.committed_at
  from (select distinct commit_id, project_id, path, added, removed from commit_files) f join commits c using (commit_id))"""
_LINKED = f"""{TOUCHES}, {HISTORY},
linked as (
  select t.touch_id, t.project_id, arg_min(h.commit_id, (h.authored_at, h.committed_at, h.commit_id)) as linked_commit_id, min(h.authored_at) as linked_at
  from touches t left join history h on h.project_id = t.project_id and h.path = t.file_path and h.authored_at >= t.occurred_at
  where t.touch_kind in ('write', 'create', 'delete') and t.commit_sha is null and t.occurred_at is not null
  group by all)"""
SAMPLES = "samples as (select user_id % 60 + 1 as project_id, event_type as metric, value, ts as measured_at from events)"
ANCHORS = f"""{TOUCHES}, anchors as (
  select commit_id as anchor_id, c.project_id, authored_at as starts_at, string_split(message, chr(10))[1] as summary, file_path
  from commits c left join (select commit_id, min(path) as file_path from commit_files group by all) using (commit_id))"""
_ASKED = f"{ANCHORS}, {SAMPLES}, asked as (select a.*, m.metric from anchors a join (select distinct project_id, metric from samples) m using (project_id))"
_BASE = """
base as (
  select a.anchor_id, a.metric, a.project_id, arg_max(s.value, s.measured_at) as base_value, max(s.measured_at) as base_measured_at
  from asked a left join samples s on s.project_id = a.project_id and s.metric = a.metric and s.measured_at::timestamp <= a.starts_at::timestamp group by all)"""
_SEEN = """
seen as (
  select a.anchor_id, a.metric, arg_max(s.value, s.measured_at) as seen_value, max(s.measured_at) as seen_measured_at
  from asked a left join samples s on s.project_id = a.project_id and s.metric = a.metric
   and s.measured_at::timestamp > a.starts_at::timestamp and s.measured_at::timestamp <= a.starts_at::timestamp + interval 30 day group by all)"""
_CONF = """
near as (
  select a.anchor_id, count(distinct t.session_id) as sessions, min('the file was also modified in agent session ' || chr(39) || t.session_id || chr(39) || ' during the window') as note
  from anchors a join touches t on t.project_id = a.project_id and t.file_path = a.file_path and t.touch_kind in ('write', 'create', 'delete')
   and t.occurred_at >= a.starts_at and t.occurred_at <= a.starts_at + interval 30 day group by all),
conf as (
  select anchor_id, n + coalesce(sessions, 0) as confounders, coalesce(first, note) as first from (
    select a.anchor_id, count(b.anchor_id) as n, arg_min(b.summary, (b.starts_at, b.anchor_id)) as first
    from anchors a left join anchors b on b.project_id = a.project_id and b.anchor_id <> a.anchor_id and b.starts_at >= a.starts_at and b.starts_at <= a.starts_at + interval 30 day
    group by all) left join near using (anchor_id))"""
EVIDENCE = """
evidence as (
  select project_id, file_path, count(*) filter (touch_kind in ('write', 'create')) as writes, count(*) filter (touch_kind = 'read') as reads,
         count(*) filter (touch_kind = 'delete') as deletes, count(distinct case when touch_kind <> 'read' then session_id end) as sessions,
         coalesce(max(case when touch_kind <> 'read' then confidence end), 0) as strength, max(case when touch_kind <> 'read' then occurred_at end) as last_write
  from touches group by all)"""
RISKS = """
risks as (
  select project_id, path as file_path, least(100.0::double, composite) as base_risk from (
    select *, row_number() over (partition by project_id order by churn desc, path) as place from (
      select project_id, path, churn, cast(round(cast(commits * (1 + sqrt(churn) / 10) as decimal(38, 12)), 1) as double) as composite from (
        select *, row_number() over (partition by project_id order by churn desc, path) as n from (
          select project_id, path, sum(coalesce(added, 0) + coalesce(removed, 0)) as churn, count(*) as commits
          from (select distinct commit_id, project_id, path, added, removed from commit_files) where commit_id in (select commit_id from commits) group by all))
      where n <= 20 and commits >= 3 and churn >= 50)) where place <= 10)"""
SHARES = """
shares as (
  select project_id, path, total, ai, 0.0::double as human, cast(round(cast(100 - ai as decimal(38, 12)), 2) as double) as unattributed, coalesce(c, 0) as confidence
  from (select l.project_id, l.path, cast(sum(n) as bigint) as total, max(k.c) as c,
               cast(round(cast(sum(case when k.c is not null then n else 0 end) / sum(n) * 100 as decimal(38, 12)), 2) as double) as ai
        from (select distinct project_id, path, sha, added as n from commit_files where added > 0) l
        left join (select project_id, commit_sha as sha, max(confidence) as c from touches where commit_sha is not null and touch_kind in ('write', 'create', 'delete') group by all) k
          using (project_id, sha) group by l.project_id, l.path))"""
_R3 = "cast(round(cast({} as decimal(38, 12)), 3) as double)"

ORACLE = {
    "asof_forward_link": f"with {_LINKED} select touch_id, linked_commit_id, epoch_us(linked_at) as linked_at from linked",
    "asof_uncommitted": f"with {_LINKED} select project_id, count(*) as changes, count(*) filter (linked_commit_id is null) as uncommitted from linked group by all",
    "asof_backward_baseline": f"with {_ASKED}, {_BASE} select anchor_id, metric, base_value, epoch_us(base_measured_at) as base_measured_at from base",
    "asof_bounded_observed": f"with {_ASKED}, {_SEEN} select anchor_id, metric, seen_value, epoch_us(seen_measured_at) as seen_measured_at from seen",
    "asof_last_commit_before_turn": """
with first as (select session_id, project_id, min(occurred_at) as first_at from session_file_touches group by all)
select session_id, arg_max(commit_id, (authored_at, -commit_id)) as matched_commit_id
from first f left join commits c on c.project_id = f.project_id and c.authored_at < f.first_at group by session_id, f.project_id""",
    "interval_confounders": f"with {ANCHORS}, {_CONF} select anchor_id, confounders, least(confounders, 51) as listed, first from conf",
    "file_confounders": f"with {ANCHORS}, {_CONF} select anchor_id, sessions from near",
    "consequence_delta": f"""with {_ASKED}, {_BASE}, {_SEEN}, {_CONF}
select anchor_id, project_id, metric, {_R3.format('base_value')} as baseline, {_R3.format('seen_value')} as observed, {_R3.format('seen_value - base_value')} as delta,
       case when abs(seen_value - base_value) < 1 then 'none' else 'correlation' end as claim, confounders,
       case when abs(seen_value - base_value) < 1 then 0 else {_R3.format('0.6 / (1 + confounders)')} end as confidence
from base join seen using (anchor_id, metric) join conf using (anchor_id) where base_value is not null and seen_value is not null""",
    "session_consequences": f"""
with {SAMPLES},
spans as (select session_id, project_id, min(occurred_at) as a, max(occurred_at) + interval 30 day as b from session_file_touches group by all having min(occurred_at) is not null),
asked as (select s.*, m.metric from spans s join (select distinct project_id, metric from samples) m using (project_id)),
base as (select k.session_id, k.metric, arg_max(s.value, s.measured_at) as v from asked k join samples s on s.project_id = k.project_id and s.metric = k.metric
         and s.measured_at::timestamp <= k.a::timestamp group by all),
seen as (select k.session_id, k.metric, arg_max(s.value, s.measured_at) as v from asked k join samples s on s.project_id = k.project_id and s.metric = k.metric
         and s.measured_at::timestamp > k.a::timestamp and s.measured_at::timestamp <= k.b::timestamp group by all),
conf as (select s.session_id, count(c.commit_id) as n from spans s left join commits c on c.project_id = s.project_id and c.authored_at between s.a and s.b group by all)
select k.session_id, k.project_id, k.metric, {_R3.format('base.v')} as baseline, {_R3.format('seen.v')} as observed, {_R3.format('seen.v - base.v')} as delta,
       case when abs(seen.v - base.v) < 1 then 'none' else 'correlation' end as claim, n as confounders,
       case when abs(seen.v - base.v) < 1 then 0 else {_R3.format('0.6 / (1 + n)')} end as confidence
from asked k join base using (session_id, metric) join seen using (session_id, metric) join conf using (session_id)""",
    "evidence_by_file": f"with {TOUCHES}, {EVIDENCE} select * replace (epoch_us(last_write) as last_write) from evidence",
    "weighted_risk": f"""with {TOUCHES}, {EVIDENCE}, {RISKS}
select project_id, file_path, base_risk, coalesce(writes, 0) as writes, coalesce(reads, 0) as reads, coalesce(deletes, 0) as deletes, coalesce(sessions, 0) as sessions,
       coalesce(strength, 0) as strength, epoch_us(last_write) as last_write, cast(round(cast(base_risk * coalesce(strength, 0) as decimal(38, 12)), 2) as double) as weighted_risk
from risks left join evidence using (project_id, file_path)""",
    "max_per_commit": f"""with {TOUCHES} select project_id, commit_sha, max(confidence) as confidence from touches
where commit_sha is not null and touch_kind in ('write', 'create', 'delete') group by all""",
    "share_split": f"with {TOUCHES}, {SHARES} select * from shares",
    "latest_touch_per_file": f"""with {TOUCHES}
select project_id, file_path, touch_id, touch_kind, epoch_us(occurred_at) as occurred_at from (
  select *, row_number() over (partition by project_id, file_path order by occurred_at desc, touch_id desc) as n from touches where occurred_at is not null) where n = 1""",
}
