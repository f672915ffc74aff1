"""Queries that compose scores and findings, compare states, explain files and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.operators import decisions as d
from lodewright.operators import evidence as e
from lodewright.operators import findings as f
from lodewright.operators import history as h
from lodewright.operators import report as r
from lodewright.operators import structure as s
from lodewright.plans import fusion, graph, history, structure
from lodewright.session import table

_CUT = "2025-01-01 00:00:00"


def _scores(spark, sf_dir):
    parts = {
        "git_history": history.git_score, "architecture": structure.arch_score, "dependencies": graph.dep_score, "complexity": structure.cx_score,
        "tech_debt": structure.debt_density, "coupling": graph.coupling_score,
    }
    out = None
    for name, query in parts.items():
        part = query(spark, sf_dir).where("project_id IS NOT NULL").select("project_id", F.lit(name).alias("analyzer"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def _findings(spark, sf_dir):
    parts = [
        f.hotspot(history.git_hotspots(spark, sf_dir)), f.knowledge_island(history.git_islands(spark, sf_dir)), f.god_module(structure.arch_god_modules(spark, sf_dir)),
        f.import_cycle(graph.graph_cycles(spark, sf_dir)), f.long_file(structure.cx_long_files(spark, sf_dir)), f.debt_hotspot(structure.debt_files(spark, sf_dir)),
        f.stable_concrete(graph.coupling_painful(spark, sf_dir)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("project_id IS NOT NULL")


def score_composite(spark, sf_dir):
    return r.composite(_scores(spark, sf_dir))


def finding_counts(spark, sf_dir):
    return r.counts(_findings(spark, sf_dir))


def report_top_findings(spark, sf_dir):
    return r.top_findings(_findings(spark, sf_dir))


def _hot_until(spark, sf_dir, until):
    commits = table(spark, sf_dir, "commits")
    if until:
        commits = commits.where(F.col("authored_at") < F.lit(until).cast("timestamp"))
    return h.hotspots(h.file_churn(h.changes(commits, table(spark, sf_dir, "commit_files"))))


def diff_findings(spark, sf_dir):
    """How the hotspots of 2024 differ from those of the whole history."""
    return r.findings_diff(f.hotspot(_hot_until(spark, sf_dir, _CUT)), f.hotspot(_hot_until(spark, sf_dir, None)))


def diff_scores(spark, sf_dir):
    """How the bus factor of 2024 differs from that of the whole history, taken as a score."""
    commits = table(spark, sf_dir, "commits")
    then = commits.where(F.col("authored_at") < F.lit(_CUT).cast("timestamp"))
    state = lambda c: h.bus_factor(h.author_commits(c)).select("project_id", F.lit("bus_factor").alias("analyzer"), F.col("bus_factor").cast("double").alias("score"))
    return r.scores_diff(state(then), state(commits))


def sarif_rows(spark, sf_dir):
    return r.sarif_results(_findings(spark, sf_dir), fusion.share_split(spark, sf_dir)).drop("result")


def sarif_json(spark, sf_dir):
    return r.sarif_results(_findings(spark, sf_dir), fusion.share_split(spark, sf_dir)).select("project_id", "result")


def code_quality_rows(spark, sf_dir):
    return r.code_quality(_findings(spark, sf_dir))


def guard_violations(spark, sf_dir):
    shares = fusion.share_split(spark, sf_dir).withColumn("method", F.lit("blame_session_commit"))
    moves = fusion.consequence_delta(spark, sf_dir)
    return r.violations(shares, table(spark, sf_dir, "session_file_touches"), moves, table(spark, sf_dir, "decisions"))


def guard_violations_planted(spark, sf_dir):
    """The same rules over claims that overstate: every share a person's, every confidence doubled, every move causal."""
    shares = fusion.share_split(spark, sf_dir).select("path", "ai", (F.col("human") + 40).alias("human"), "unattributed", (F.col("confidence") * 2).alias("confidence"), F.lit("blame_session_commit").alias("method"))
    moves = fusion.consequence_delta(spark, sf_dir).withColumns({"claim": F.when(F.col("metric") == "click", "causation").otherwise("correlation"), "confidence": F.col("confidence") * 2})
    touches = table(spark, sf_dir, "session_file_touches").withColumn("confidence", F.col("confidence") * 2)
    found = r.violations(shares, touches, moves, table(spark, sf_dir, "decisions").withColumn("confidence", F.col("confidence") * 2))
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("ref").alias("refs"))


def prom_histogram(spark, sf_dir):
    return r.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 1, 5, 10, 50, 100])


def eval_calibration(spark, sf_dir):
    """How far the second grader's levels are from the first's, over the documents of both."""
    labels = table(spark, sf_dir, "reading_labels")
    by = lambda g, name: labels.where(F.col("grader") == g).select("doc_id", F.col("level").cast("double").alias(name))
    both = by("grader_a", "expected").join(labels.where("grader = 'grader_b'").select("doc_id").distinct(), "doc_id", "left_semi")
    return r.calibration(both, by("grader_b", "computed"), ["doc_id"])


def _explained(spark, sf_dir):
    risk = fusion.weighted_risk(spark, sf_dir).select("project_id", "file_path", "base_risk", "writes", "reads", "sessions", "strength", "weighted_risk")
    shares = fusion.share_split(spark, sf_dir).select("project_id", F.col("path").alias("file_path"), "ai", "unattributed", "human", F.col("confidence").alias("share_confidence"))
    mined = d.commit_decisions(table(spark, sf_dir, "commits"))
    files = d.decision_files(mined, table(spark, sf_dir, "commit_files"))
    about = files.join(mined.select("decision_id", "summary"), "decision_id").select("project_id", F.col("path").alias("file_path"), "decision_id", "summary")
    moves = fusion.consequence_delta(spark, sf_dir).select(F.col("anchor_id").alias("decision_id"), "metric", "delta", "claim")
    return r.explain(risk.join(shares, ["project_id", "file_path"], "left"), about, moves)


def explain_prose(spark, sf_dir):
    return _explained(spark, sf_dir).select("project_id", "file_path", "prose")


def explain_factors(spark, sf_dir):
    """The names of each file's factors."""
    return _explained(spark, sf_dir).select("project_id", "file_path", F.array_join(F.transform("factors", lambda f: f["name"]), ",").alias("factors"))


def latest_scan_risk(spark, sf_dir):
    """For each project and file the largest metric value of the newest day with samples, and the file's place."""
    samples = fusion.samples(spark, sf_dir).withColumn("day", F.date_trunc("day", "measured_at"))
    newest = samples.groupBy("project_id").agg(F.max("day").alias("day"))
    risk = samples.join(newest, ["project_id", "day"]).groupBy("project_id", "metric").agg(F.max("value").alias("risk"))
    return e.latest_per_key(risk, ["project_id"], F.desc("risk"), F.asc("metric"))


def explained_with_evidence(spark, sf_dir):
    """Fusion as one list: the files that more than their risk is known of, by weighted risk."""
    return r.with_evidence(_explained(spark, sf_dir)).select("project_id", "file_path", "place", "weighted_risk", "base_risk")


def diff_stats(spark, sf_dir):
    """By how much each project's files, lines and commits grew since 2024."""
    docs, commits = table(spark, sf_dir, "documents").where("project_id IS NOT NULL"), table(spark, sf_dir, "commits")
    cut = F.lit(_CUT).cast("timestamp")
    state = lambda d, c: r.stats(s.inventory(d.select("project_id", F.col("doc_path").alias("path"), F.col("text").alias("content"))), c)
    return r.stats_diff(state(docs.where(F.col("written_at") < cut), commits.where(F.col("authored_at") < cut)), state(docs, commits))


def sarif_log(spark, sf_dir):
    return r.sarif_runs(r.sarif_results(_findings(spark, sf_dir), fusion.share_split(spark, sf_dir)))


def report_json(spark, sf_dir):
    return r.json_report(score_composite(spark, sf_dir), _scores(spark, sf_dir), report_top_findings(spark, sf_dir))


def run_bookkeeping(spark, sf_dir):
    """Metric samples as analyzer runs that took as many milliseconds as their value is high."""
    runs = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("analyzer"), F.when(F.col("value") < 100, "completed").otherwise("failed").alias("status"), F.col("ts").cast("timestamp").alias("started_at"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value")).cast("bigint") * 1000).alias("finished_at"), F.when(F.col("value") <= 100, F.col("value")).alias("score"),
    )
    return r.run_records(runs).select("event_id", "analyzer", "duration_ms", "score", "band", "is_measured", "passed")


def eval_detection(spark, sf_dir):
    """How well the touches that sessions recorded tell which files commits changed."""
    changed = table(spark, sf_dir, "commit_files").select("project_id", "path")
    return r.detection(changed, fusion.touches(spark, sf_dir).where("touch_kind <> 'read'").select("project_id", F.col("file_path").alias("path")), ["project_id", "path"])


QUERIES = {
    f.__name__: f
    for f in (
        score_composite, finding_counts, report_top_findings, diff_findings, diff_scores, sarif_rows, sarif_json, code_quality_rows, guard_violations, guard_violations_planted,
        prom_histogram, eval_calibration, explain_prose, explain_factors, latest_scan_risk, explained_with_evidence, diff_stats, sarif_log, report_json, run_bookkeeping, eval_detection,
    )
}

_GIT, _STR, _GRA, _FUS = history.ORACLE, structure.ORACLE, graph.ORACLE, fusion.ORACLE
_SCORES = "scores as (" + " union all ".join(
    f"select project_id, '{name}' as analyzer, score, {weight}::double as weight from ({sql}) where project_id is not null"
    for name, weight, sql in (
        ("git_history", 1.0, _GIT["git_score"]), ("architecture", 1.2, _STR["arch_score"]), ("dependencies", 1.0, _GRA["dep_score"]), ("complexity", 1.0, _STR["cx_score"]),
        ("tech_debt", 1.0, _STR["debt_density"]), ("coupling", 0.9, _GRA["coupling_score"]),
    )
) + ")"


def _sql_findings(hot=_GIT["git_hotspots"]):
    bounded = "cast(round(cast(least(greatest({}, 0), 100) as decimal(38, 12)), 4) as double)"
    return f"""findings as (
  select project_id, 'git_history' as analyzer, 'hotspot' as category, 'Hotspot: ' || path as title, severity, path, {bounded.format('composite')} as score from ({hot})
  union all select project_id, 'git_history', 'knowledge_island', 'Knowledge island: ' || path, 'medium', path, 60.0 from ({_GIT['git_islands']})
  union all select project_id, 'architecture', 'god_module', 'God module: ' || module || '/', severity, module || '/', 80.0 from ({_STR['arch_god_modules']}) where place <= 3
  union all select project_id, 'dependencies', 'import_cycle', 'Import cycle: ' || names, case when n <= 4 then 'high' else 'medium' end, null, case when n <= 4 then 70.0 else 40.0 end from (
    select *, row_number() over (partition by project_id order by component) as k from (
      select project_id, component, count(*) as n, string_agg(module, ' → ' order by module) as names from ({_GRA['graph_cycles']}) group by all)) where k <= 5
  union all select project_id, 'complexity', 'long_file', 'Long file: ' || path || ' (' || format('{{:,}}', loc) || ' LOC)', severity, path, {bounded.format('score')} from ({_STR['cx_long_files']})
  union all select project_id, 'coupling', 'stable_concrete', 'Painful to change: ' || module, severity, module, {bounded.format('distance * 100')} from ({_GRA['coupling_painful']})
  union all select project_id, 'tech_debt', 'debt_hotspot', 'Debt hotspot: ' || path, 'medium', path, {bounded.format('weighted * 5')} from ({_STR['debt_files']}))"""


_OLD_HOT = _GIT["git_hotspots"].replace("join commits c using (commit_id)", "join (select * from commits where authored_at < timestamptz '2025-01-01 00:00:00+00') c using (commit_id)")
_BUS_OF = _GIT["git_bus_factor"]
_OLD_BUS = _BUS_OF.replace("from commits group by all", "from commits where authored_at < timestamptz '2025-01-01 00:00:00+00' group by all")
_WHOLE = "cast(cast(round(cast({} as decimal(38, 12)), 0) as bigint) as varchar)"
_EXPLAIN = f"""
risk as ({_FUS['weighted_risk']}), share as ({_FUS['share_split']}), moves as ({_FUS['consequence_delta']}),
about as (select distinct c.project_id, f.path as file_path, c.commit_id as decision_id, coalesce(nullif(trim(string_split(c.message, chr(10))[1]), ''), '(no subject)') as summary
          from commits c join commit_files f using (sha)),
named as (select project_id, file_path, count(*) as n, list(summary order by decision_id) as s from about group by all),
moved as (select a.project_id, a.file_path, a.decision_id, m.*, row_number() over (partition by a.project_id, a.file_path order by a.decision_id, m.metric) as k,
                 count(*) over (partition by a.project_id, a.file_path) as whole from about a join moves m on m.anchor_id = a.decision_id),
gone as (select project_id, file_path, string_agg(case when claim = 'none' then 'no discernible change' else metric || ' ' || format('{{:+g}}', delta) || ' (' || claim || ')' end, ', '
             order by decision_id, metric) filter (k <= 100) || case when max(whole) > 100 then ', and ' || (max(whole) - 100) || ' more' else '' end as p, bool_or(claim <> 'none') as some
         from moved group by project_id, file_path),
facts as (
  select r.project_id, r.file_path, [
    ('risk', 'risk ' || {_WHOLE.format('base_risk')} || '/100.'),
    ('ai_authorship', case when s.ai is not null then {_WHOLE.format('s.ai')} || '% of its current lines are AI-authored (' || {_WHOLE.format('s.unattributed')} || '% unattributed, no human share claimed), at confidence ' || format('{{:.2f}}', s.confidence) || '.' end),
    ('ai_evidence', case when s.ai is null and strength > 0 then 'an agent has write evidence on it (strength ' || format('{{:.2f}}', strength) || '); a line-share has not been computed.' end),
    ('weighted_risk', case when strength > 0 and round(cast(weighted_risk as decimal(38, 12)), 0) > 0 then 'about ' || {_WHOLE.format('weighted_risk')} || ' of that risk sits under agent-modified code — correlation, not blame.' end),
    ('sessions', case when sessions > 0 then 'Traced to ' || sessions || case when sessions = 1 then ' agent session (' else ' agent sessions (' end || writes || ' write, ' || reads || ' read).' end),
    ('decisions', case when d.n > 0 then d.n || ' decision(s) touch it: ' || array_to_string(list_transform(d.s[1:3], lambda x: '“' || x || '”'), '; ') || case when d.n > 3 then ', and ' || (d.n - 3) || ' more' else '' end || '.' end),
    ('consequences', case when g.p is not null then 'Since then: ' || g.p || case when g.some then ' — correlation, not causation.' else '.' end end)] as f
  from risk r left join share s on s.project_id = r.project_id and s.path = r.file_path
  left join named d on d.project_id = r.project_id and d.file_path = r.file_path left join gone g on g.project_id = r.project_id and g.file_path = r.file_path)"""

ORACLE = {
    "explained_with_evidence": f"""with {_EXPLAIN}
select f.project_id, f.file_path, row_number() over (partition by f.project_id order by coalesce(r.weighted_risk, 0) desc, coalesce(r.base_risk, 0) desc, f.file_path) as place, r.weighted_risk, r.base_risk
from facts f join risk r on r.project_id = f.project_id and r.file_path = f.file_path where len(list_filter(f.f, lambda x: x[2] is not null and x[1] <> 'risk')) > 0""",
    "diff_stats": f"""
with now as (select project_id, count(*) as files, sum(loc) as loc from ({_STR['loc_per_file']}) where project_id is not null group by all),
then_ as (select project_id, count(*) as files, sum(loc) as loc from ({_STR['loc_per_file'].replace("from documents where", "from documents where written_at < timestamptz '2025-01-01 00:00:00+00' and")}) where project_id is not null group by all),
c as (select project_id, count(*) as n, count(*) filter (authored_at < timestamptz '2025-01-01 00:00:00+00') as old from commits group by all)
select project_id, now.files - coalesce(then_.files, 0) as files, cast(now.loc - coalesce(then_.loc, 0) as bigint) as loc,
       coalesce(c.n, 0) - case when then_.files is null then 0 else coalesce(c.old, 0) end as commits
from now left join then_ using (project_id) left join c using (project_id)""",
    "run_bookkeeping": """
select event_id, event_type as analyzer, cast(floor(value) as bigint) as duration_ms, score, case when score is null then null when score >= 85 then 'excellent' when score >= 70 then 'good' when score >= 50 then 'fair'
       when score >= 30 then 'poor' else 'critical' end as band, score is not null as is_measured, value < 100 as passed
from (select *, cast(round(cast(case when value <= 100 then value end as decimal(38, 12)), 1) as double) as score from events)""",
    "eval_detection": f"""with {fusion.TOUCHES},
t as (select distinct project_id, path from commit_files), g as (select distinct project_id, file_path as path from touches where touch_kind <> 'read'),
n as (select (select count(*) from t) as expected, (select count(*) from g) as found, (select count(*) from t join g using (project_id, path)) as both_)
select expected, found, both_ as both, cast(round(cast(both_ / expected as decimal(38, 12)), 4) as double) as recall, cast(round(cast((found - both_) / found as decimal(38, 12)), 4) as double) as false_positive_rate from n""",
    "score_composite": f"""with {_SCORES},
mean as (select project_id, cast(round(cast(sum(score * weight) / sum(weight) as decimal(38, 12)), 1) as double) as overall, count(score) as measured,
                string_agg(analyzer || ': ' || format('{{:.1f}}', score) || ' x ' || format('{{:.1f}}', weight), '; ' order by analyzer || ': ') as ledger from scores group by all)
select project_id, overall, case when overall >= 85 then 'excellent' when overall >= 70 then 'good' when overall >= 50 then 'fair' when overall >= 30 then 'poor' else 'critical' end as band, measured, ledger from mean""",
    "finding_counts": f"with {_sql_findings()} select project_id, " + ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in r.SEVERITIES) + " from findings where project_id is not null group by all",
    "report_top_findings": f"""with {_sql_findings()} select * from (
  select *, row_number() over (partition by project_id order by coalesce(score, 0) desc, analyzer, category, title) as place from findings where project_id is not null) where place <= 200""",
    "diff_findings": f"""
with old as (select project_id, 'git_history:hotspot:Hotspot: ' || path as finding, severity as old from ({_OLD_HOT})),
now as (select project_id, 'git_history:hotspot:Hotspot: ' || path as finding, severity as new from ({_GIT['git_hotspots']}))
select project_id, finding, case when old is null then 'added' when new is null then 'removed' else 'severity' end as change, old, new
from old full join now using (project_id, finding) where old is distinct from new""",
    "diff_scores": f"""
with old as (select project_id, bus_factor::double as o from ({_OLD_BUS})), now as (select project_id, bus_factor::double as n from ({_BUS_OF}))
select project_id, 'bus_factor' as analyzer, coalesce(o, 0) as old, coalesce(n, 0) as new, coalesce(n, 0) - coalesce(o, 0) as delta from old full join now using (project_id)""",
    "sarif_rows": f"""with {_sql_findings()}, share as ({_FUS['share_split']})
select f.project_id, analyzer || '/' || category as rule_id, case severity when 'high' then 'error' when 'medium' then 'warning' else 'note' end as level, title, f.path, s.ai
from findings f left join share s on s.project_id = f.project_id and s.path = f.path where f.project_id is not null""",
    "code_quality_rows": f"""with {_sql_findings()}
select project_id, title as description, category as check_name, analyzer || ':' || category || ':' || title as fingerprint,
       case severity when 'high' then 'critical' when 'medium' then 'major' when 'low' then 'minor' end as severity, coalesce(path, '.') as path from findings where project_id is not null""",
    "guard_violations": f"""
select 'touch_confidence_below_1' as rule, 'touch ' || touch_id as ref from session_file_touches where confidence >= 1
union all select 'confidence_below_1', 'decision ' || decision_id from decisions where confidence >= 1
union all select 'shares_sum_to_100', 'authorship ' || path from ({_FUS['share_split']}) where abs(ai + human + unattributed - 100) >= 0.01 or confidence >= 1""",
    "guard_violations_planted": f"""with share as ({_FUS['share_split']}), moves as ({_FUS['consequence_delta']}),
broken as (
  select 'shares_sum_to_100' as rule, 'authorship ' || path as ref from share
  union all select 'no_human_from_blame', 'authorship ' || path from share
  union all select 'confidence_below_1', 'authorship ' || path from share where confidence * 2 >= 1
  union all select 'touch_confidence_below_1', 'touch ' || touch_id from session_file_touches where confidence * 2 >= 1
  union all select 'never_causation', 'consequence ' || anchor_id || ' ' || metric from moves where metric = 'click'
  union all select 'confidence_below_1', 'consequence ' || anchor_id || ' ' || metric from moves where confidence * 2 >= 1
  union all select 'inconclusive_claims_nothing', 'consequence ' || anchor_id || ' ' || metric from moves where metric <> 'click' and abs(delta) < 1
  union all select 'confidence_below_1', 'decision ' || decision_id from decisions where confidence * 2 >= 1)
select rule, count(*) as n, count(distinct ref) as refs from broken group by all""",
    "prom_histogram": "select event_type, count(value) as n, cast(round(cast(sum(value) as decimal(38, 12)), 4) as double) as total, "
    + ", ".join(f"count(*) filter (value <= {b}) as le_{str(b).replace('.', '_')}" for b in (0.5, 1, 5, 10, 50, 100)) + " from events group by all",
    "eval_calibration": """
select count(*) as items, cast(round(cast(max(abs(a.level - b.level)) as decimal(38, 12)), 4) as double) as worst, cast(round(cast(avg(abs(a.level - b.level)) as decimal(38, 12)), 6) as double) as mean
from (select * from reading_labels where grader = 'grader_a') a join (select * from reading_labels where grader = 'grader_b') b using (doc_id)""",
    "explain_prose": f"""with {_EXPLAIN}
select project_id, file_path, file_path || ': ' || array_to_string(list_transform(list_filter(f, lambda x: x[2] is not null), lambda x: x[2]), ' ') as prose from facts""",
    "explain_factors": f"""with {_EXPLAIN}
select project_id, file_path, array_to_string(list_transform(list_filter(f, lambda x: x[2] is not null), lambda x: x[1]), ',') as factors from facts""",
    "latest_scan_risk": f"""with {fusion.SAMPLES},
newest as (select project_id, max(date_trunc('day', measured_at)) as day from samples group by all)
select project_id, metric, risk from (
  select *, row_number() over (partition by project_id order by risk desc, metric) as n from (
    select s.project_id, s.metric, max(s.value) as risk from samples s join newest n on n.project_id = s.project_id and date_trunc('day', s.measured_at) = n.day group by all)) where n = 1""",
}
