"""Queries over the import graph that turns of the sessions report ("I think a/x.py imports b/y.py"), between top-level modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.functions.paths import top_segment
from lodewright.operators import graph as g
from lodewright.session import table

_SAID = r"([a-z]+/[a-z_0-9]+\.[a-z]+) imports ([a-z]+/[a-z_0-9]+\.[a-z]+)"


def edges(spark, sf_dir):
    turns = table(spark, sf_dir, "session_events").where("project_id IS NOT NULL AND content LIKE '% imports %'")
    said = turns.select("project_id", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(_SAID), F.lit(1)).alias("a"), F.regexp_extract_all("content", F.lit(_SAID), F.lit(2)).alias("b"))).alias("e"))
    return g.simple_edges(said.select("project_id", top_segment(F.col("e.a")).alias("src"), top_segment(F.col("e.b")).alias("dst")))


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "commit_files").select("project_id", top_segment(F.col("path")).alias("module")).distinct()


def _degrees(spark, sf_dir):
    return g.degrees(edges(spark, sf_dir), _nodes(spark, sf_dir))


def _coupling(spark, sf_dir):
    files = table(spark, sf_dir, "commit_files").select("project_id", "path").distinct()
    return g.coupling(_degrees(spark, sf_dir), g.abstractness(files, top_segment(F.col("path"))))


def graph_edges(spark, sf_dir):
    return edges(spark, sf_dir)


def graph_fan_in_out(spark, sf_dir):
    return _degrees(spark, sf_dir)


def graph_orphans(spark, sf_dir):
    return g.orphans(_degrees(spark, sf_dir))


def graph_cycles(spark, sf_dir):
    return g.components(edges(spark, sf_dir))


def coupling_metrics(spark, sf_dir):
    return _coupling(spark, sf_dir)


def coupling_painful(spark, sf_dir):
    return g.painful(_coupling(spark, sf_dir))


def coupling_score(spark, sf_dir):
    return g.coupling_score(_coupling(spark, sf_dir))


def dep_score(spark, sf_dir):
    return g.dependency_score(_degrees(spark, sf_dir), g.components(edges(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (graph_edges, graph_fan_in_out, graph_orphans, graph_cycles, coupling_metrics, coupling_painful, coupling_score, dep_score)}

_EDGES = r"""
edges as (
  select distinct project_id, string_split(a, '/')[1] as src, string_split(b, '/')[1] as dst from (
    select project_id, unnest(regexp_extract_all(content, '([a-z]+/[a-z_0-9]+\.[a-z]+) imports ([a-z]+/[a-z_0-9]+\.[a-z]+)', 1)) as a,
           unnest(regexp_extract_all(content, '([a-z]+/[a-z_0-9]+\.[a-z]+) imports ([a-z]+/[a-z_0-9]+\.[a-z]+)', 2)) as b
    from session_events where project_id is not null and content like '% imports %') where string_split(a, '/')[1] <> string_split(b, '/')[1])"""
_DEGREES = """
degrees as (
  select project_id, module, cast(sum(i) as bigint) as fan_in, cast(sum(o) as bigint) as fan_out from (
    select project_id, src as module, 0 as i, 1 as o from edges union all select project_id, dst, 1, 0 from edges
    union all select distinct project_id, string_split(path, '/')[1], 0, 0 from commit_files) group by all)"""
_COUPLED = r"""
coupled as (
  select project_id, module, fan_in as ca, fan_out as ce, cast(round(cast(i as decimal(38, 12)), 3) as double) as instability,
         cast(round(cast(a as decimal(38, 12)), 3) as double) as abstractness, cast(round(cast(abs(a + i - 1) / sqrt(2.0) as decimal(38, 12)), 3) as double) as distance
  from (select d.*, fan_out / greatest(fan_in + fan_out, 1) as i, case when coalesce(types, 0) > 0 then least(1.0::double, abstract / types) else 0.0::double end as a
        from degrees d left join (
          select project_id, string_split(path, '/')[1] as module, count(*) filter (not regexp_matches(path, '(test\.py|_test\.go|\.test\.ts|Test\.java|\.spec\.ts)$')) as types,
                 count(*) filter (regexp_matches(string_split(path, '/')[-1], '^(\p{Lu}|interface|abs_|base_|abstract_)|\.h$')) as abstract
          from (select distinct project_id, path from commit_files) group by all) using (project_id, module)))"""
_REACH = """
reach as (select project_id, src as a, dst as b from edges union select r.project_id, r.a, e.dst from reach r join edges e on e.project_id = r.project_id and e.src = r.b),
members as (select x.project_id, min(x.b) as component, x.a as module from reach x join reach y on x.project_id = y.project_id and x.a = y.b and x.b = y.a group by x.project_id, x.a),
cycles as (select * from members where (project_id, component) in (select project_id, component from members group by all having count(*) > 1))"""

ORACLE = {
    "graph_edges": f"with {_EDGES} select * from edges",
    "graph_fan_in_out": f"with {_EDGES}, {_DEGREES} select * from degrees",
    "graph_orphans": f"with {_EDGES}, {_DEGREES} select project_id, module from degrees where fan_in = 0 and fan_out = 0 and module not like '.%'",
    "graph_cycles": f"with recursive {_EDGES}, {_REACH} select * from cycles",
    "coupling_metrics": f"with {_EDGES}, {_DEGREES}, {_COUPLED} select * from coupled",
    "coupling_painful": f"""with {_EDGES}, {_DEGREES}, {_COUPLED}
select *, case when ca >= 10 then 'high' else 'medium' end as severity from (
  select *, row_number() over (partition by project_id order by distance desc, module) as place from coupled where distance > 0.5 and ca >= 3) where place <= 10""",
    "coupling_score": f"""with {_EDGES}, {_DEGREES}, {_COUPLED}
select project_id, cast(round(cast(greatest(0, 100 - least(35.0::double, coalesce(n * 5 + (t - 0.5::double) * 30, 0))) as decimal(38, 12)), 1) as double) as score,
       cast(round(cast(m as decimal(38, 12)), 3) as double) as avg_instability
from (select project_id, avg(instability) as m from coupled group by all)
left join (select project_id, count(*) as n, max(distance) as t from coupled where distance > 0.5 and ca >= 3 group by all) using (project_id)""",
    "dep_score": f"""with recursive {_EDGES}, {_REACH}, {_DEGREES},
sizes as (select project_id, component, count(*) as n from cycles group by all)
select project_id, coalesce(cycles, 0) as cycles, coalesce(largest, 0) as largest, top_fan_in,
       cast(round(cast(greatest(0, 100 - least(40, coalesce(pen, 0)) - case when top_fan_in >= 15 then least(15.0, top_fan_in * 0.5) else 0 end) as decimal(38, 12)), 1) as double) as score
from (select project_id, max(fan_in) as top_fan_in from degrees group by all)
left join (select project_id, count(*) as cycles, max(n) as largest, sum(least(20, n * 4)) as pen from sizes group by all) using (project_id)""",
}
