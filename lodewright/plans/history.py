"""Queries over commits and commit_files."""

from __future__ import annotations

from lodewright.operators import history as h
from lodewright.session import as_micros, table


def _commits(spark, sf_dir):
    return table(spark, sf_dir, "commits")


def _changed(spark, sf_dir):
    return h.changes(_commits(spark, sf_dir), table(spark, sf_dir, "commit_files"))


def _churned(spark, sf_dir):
    return h.file_churn(_changed(spark, sf_dir))


def git_file_churn(spark, sf_dir):
    return as_micros(_churned(spark, sf_dir))


def git_hotspots(spark, sf_dir):
    return h.hotspots(_churned(spark, sf_dir))


def git_author_commits(spark, sf_dir):
    return h.author_commits(_commits(spark, sf_dir))


def git_bus_factor(spark, sf_dir):
    return h.bus_factor(h.author_commits(_commits(spark, sf_dir)))


def git_islands(spark, sf_dir):
    """With one commit enough: the tables hold no file that one author changed five times."""
    return h.first_islands(h.islands(_churned(spark, sf_dir), least=1))


def git_cadence(spark, sf_dir):
    return h.cadence(_commits(spark, sf_dir))


def git_totals(spark, sf_dir):
    return h.totals(_changed(spark, sf_dir))


def git_score(spark, sf_dir):
    churned = _churned(spark, sf_dir)
    return h.score(h.hotspots(churned), h.bus_factor(h.author_commits(_commits(spark, sf_dir))), h.islands(churned))


QUERIES = {f.__name__: f for f in (git_file_churn, git_hotspots, git_author_commits, git_bus_factor, git_islands, git_cadence, git_totals, git_score)}

_CHANGED = """
changed as (
  select f.project_id, f.path, f.commit_id, c.authored_at as ts,
         lower(coalesce(nullif(c.author_email, ''), nullif(c.author_name, ''), 'unknown')) as author,
         cast(coalesce(f.added, 0) + coalesce(f.removed, 0) as bigint) as churn
  from (select distinct commit_id, project_id, path, added, removed from commit_files) f join commits c using (commit_id)),
churned as (
  select project_id, path, cast(sum(churn) as bigint) as churn, count(*) as commits, count(distinct author) as authors, min(ts) as first_seen
  from changed group by all)"""
_HOT = """
hot as (
  select *, case when composite > 80 then 'high' when composite > 40 then 'medium' else 'low' end as severity,
         row_number() over (partition by project_id order by churn desc, path) as place
  from (select project_id, path, churn, commits, authors,
               cast(round(cast(commits * (1 + sqrt(churn) / 10) as decimal(38, 12)), 1) as double) as composite
        from (select *, row_number() over (partition by project_id order by churn desc, path) as n from churned)
        where n <= 20 and commits >= 3 and churn >= 50))"""
_AUTHORED = """
authored as (
  select project_id, lower(coalesce(nullif(author_email, ''), nullif(author_name, ''), 'unknown')) as author, count(*) as commits
  from commits group by all)"""
_BUS = """
bus as (
  select project_id, count(*) as authors, cast(max(total) as bigint) as commits, min(case when running / total >= 0.8 then n end) as bus_factor
  from (select project_id, sum(commits) over (partition by project_id) as total,
               sum(commits) over (partition by project_id order by commits desc, author rows unbounded preceding) as running,
               row_number() over (partition by project_id order by commits desc, author) as n from authored)
  group by all)"""
_ISLANDS = """
islands as (
  select project_id, path, commits, row_number() over (partition by project_id order by first_seen, path) as place
  from churned where authors <= 1 and commits >= 5)"""

ORACLE = {
    "git_file_churn": f"with {_CHANGED} select * replace (epoch_us(first_seen) as first_seen) from churned",
    "git_hotspots": f"with {_CHANGED}, {_HOT} select * from hot where place <= 10",
    "git_author_commits": f"with {_AUTHORED} select * from authored",
    "git_bus_factor": f"with {_AUTHORED}, {_BUS} select * from bus",
    "git_islands": f"with {_CHANGED}, {_ISLANDS.replace('commits >= 5', 'commits >= 1')} select * from islands where place <= 10",
    "git_cadence": """
with aged as (
  select project_id, (max(epoch_us(authored_at)) over (partition by project_id) - epoch_us(authored_at)) // 86400000000 as age from commits)
select *, case when prior > 0 then cast(round(cast(recent / prior as decimal(38, 12)), 2) as double) end as ratio
from (select project_id, count(*) filter (age <= 90) as recent, count(*) filter (age > 90 and age <= 180) as prior from aged group by all)""",
    "git_totals": f"with {_CHANGED} select project_id, count(*) as files_touched, cast(sum(churn) as bigint) as total_churn from churned group by all",
    "git_score": f"""
with {_CHANGED}, {_HOT}, {_AUTHORED}, {_BUS}, {_ISLANDS},
pen as (
  select b.project_id, b.bus_factor, t.path, t.composite, i.n as islands, least(40.0, coalesce(t.composite * 0.4, 0))::double as hot_pen,
         (case when bus_factor = 1 then 35 when bus_factor = 2 then 20 when bus_factor <= 4 then 8 else 0 end)::double as bus_pen,
         least(15.0, coalesce(i.n * 1.5, 0))::double as island_pen
  from bus b left join (select * from hot where place = 1) t using (project_id)
  left join (select project_id, count(*) as n from islands group by all) i using (project_id))
select project_id, cast(round(cast(greatest(0, 100 - hot_pen - bus_pen - island_pen) as decimal(38, 12)), 1) as double) as score,
       concat_ws('; ', case when composite is not null then 'top hotspot ''' || path || ''' = ' || format('{{:.1f}}', composite) || ' (-' || format('{{:.1f}}', hot_pen) || ')' end,
         'bus_factor = ' || bus_factor || case when bus_pen > 0 then ' (-' || format('{{:.1f}}', bus_pen) || ')' else ' (healthy)' end,
         case when island_pen > 0 then islands || ' knowledge islands (-' || format('{{:.1f}}', island_pen) || ')' end) as ledger
from pen""",
}
