"""Queries over sessions, their turns and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.functions.text import repository_of
from lodewright.operators import decisions as d
from lodewright.operators import quarantine
from lodewright.operators import sessions as s
from lodewright.operators import store
from lodewright.operators.evidence import latest_per_key
from lodewright.session import as_micros, table

KEY = ["source", "session"]
_CUT = "2025-01-01 00:00:00"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "session_events").withColumn("session", F.regexp_replace(F.lower("external_id"), r"^urn:uuid:|[{}]", ""))


def _digest(events):
    return events.withColumn("content_hash", F.regexp_replace(F.lower("content_hash"), "^sha256:", ""))


def session_bounds(spark, sf_dir):
    return as_micros(s.bounds(_events(spark, sf_dir), KEY, "delivered_at"))


def session_ingest(spark, sf_dir):
    """What reading all logs again would add to a store that was filled before 2025."""
    events = _digest(_events(spark, sf_dir)).select(*KEY, "seq", "content_hash", "delivered_at", "delivery_id")
    stored = latest_per_key(events.where(F.col("delivered_at") < F.lit(_CUT).cast("timestamp")), [*KEY, "seq"], F.asc("delivered_at"), F.asc("delivery_id"))
    arriving = latest_per_key(events, [*KEY, "seq"], F.desc("delivered_at"), F.desc("delivery_id"))
    return s.ingest(stored, arriving.drop("delivered_at", "delivery_id"), KEY)


def session_redacted(spark, sf_dir):
    """Turns per project and how many still have their text once retention is applied."""
    kept = table(spark, sf_dir, "sessions").select("source", F.col("external_id").alias("session"), "content_stored")
    events = store.redacted(_events(spark, sf_dir).join(kept, KEY, "left"), F.coalesce("content_stored", F.lit(False)))
    return events.groupBy("project_id").agg(F.count("*").alias("turns"), F.count("content").alias("with_text"))


def session_adopted(spark, sf_dir):
    """Turns by project after those without one were given their session's."""
    known = table(spark, sf_dir, "sessions").select("source", F.col("external_id").alias("session"), "project_id")
    return store.adopt_projects(_events(spark, sf_dir), known, KEY).groupBy("project_id").agg(F.count("*").alias("turns"))


def turn_sha256(spark, sf_dir):
    return table(spark, sf_dir, "session_events").where("content IS NOT NULL").select("delivery_id", F.sha2("content", 256).alias("sha256"))


def turn_repositories(spark, sf_dir):
    """Repositories that turns name, with how many name each."""
    turns = table(spark, sf_dir, "session_events").where("content LIKE '%git@%'")
    said = turns.select("delivery_id", F.explode(F.regexp_extract_all("content", F.lit(r"git@[\w.-]+:[\w./-]+\.git"), F.lit(0))).alias("url"))
    return said.select(*[c.alias(k) for k, c in repository_of(F.col("url")).items()]).groupBy("scheme", "host", "owner", "name").agg(F.count("*").alias("mentions"))


def _readable(spark, sf_dir):
    """The lines of session logs that the strict load accepts."""
    lines = table(spark, sf_dir, "raw_lines")
    good = quarantine.strict_load(lines, "session_log").select(F.col("line_id").alias("_id"), F.col("_sum").alias("_s"))
    return quarantine.with_offset(lines).join(good, F.col("line_id").eqNullSafe(F.col("_id")) & (F.col("_sum") == F.col("_s")), "left_semi")


def tool_call_touches(spark, sf_dir):
    return s.tool_touches(s.parse_records(_readable(spark, sf_dir)))


def tool_touches_within(spark, sf_dir):
    records = s.parse_records(_readable(spark, sf_dir))
    return s.touches_within(s.tool_touches(records), records)


def log_turns(spark, sf_dir):
    return s.turns(s.parse_records(_readable(spark, sf_dir))).select("file_name", "line_no", "session", "role", "seq", "content_hash")


def session_records(spark, sf_dir):
    return s.file_counts(s.parse_records(_readable(spark, sf_dir)))


def store_upsert(spark, sf_dir):
    """Sessions after an update that brings an end time for those whose content is stored."""
    rows = table(spark, sf_dir, "sessions")
    old = rows.select("source", "external_id", "project_id", "started_at", F.lit(None).cast("string").alias("ended_at"))
    new = rows.where("content_stored").select("source", "external_id", "ended_at")
    return store.upsert(old, new, ["source", "external_id"])


def store_insert_new(spark, sf_dir):
    """Decisions by source after inserting those whose reference was not there yet."""
    rows = table(spark, sf_dir, "decisions").select("source", "source_ref", "project_id", "summary")
    return store.insert_new(rows.where("source <> 'issue'"), rows, ["source", "source_ref", "project_id"]).groupBy("source").agg(F.count("*").alias("n"), F.max("summary").alias("last"))


def store_replace_scope(spark, sf_dir):
    """Touches by kind after those of every session with a linked commit were replaced by their writes."""
    rows = table(spark, sf_dir, "session_file_touches").select("touch_id", "session_id", "touch_kind", "commit_sha")
    linked = rows.where("commit_sha IS NOT NULL AND touch_kind = 'write'")
    return store.replace_scope(rows, linked, ["session_id"]).groupBy("touch_kind").agg(F.count("*").alias("n"), F.sum("touch_id").alias("ids"))


def _mined(spark, sf_dir):
    return d.commit_decisions(table(spark, sf_dir, "commits"))


def decision_commits(spark, sf_dir):
    return as_micros(_mined(spark, sf_dir))


def decision_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_path LIKE 'adr/%'").select("project_id", F.col("doc_path").alias("path"), "text")
    return d.record_decisions(docs).select("project_id", "source_ref", "summary", F.length("rationale").cast("bigint").alias("rationale_chars"), "status", "decided_on", "confidence")


def decision_numbers(spark, sf_dir):
    return d.record_numbers(table(spark, sf_dir, "decisions"))


def decision_names_record(spark, sf_dir):
    """Decisions that name a decision record of their project. As written none do, so each is given the citation of the first of its project."""
    return d.names_record(_citing(spark, sf_dir), table(spark, sf_dir, "decisions"))


def _citing(spark, sf_dir):
    rows = table(spark, sf_dir, "decisions")
    first = d.record_numbers(rows).groupBy("project_id").agg(F.min("number").alias("_first")).withColumnRenamed("project_id", "_p")
    cited = rows.where("source <> 'adr'").join(first, F.col("project_id") == F.col("_p"))
    return cited.withColumn("rationale", F.concat(F.coalesce("rationale", F.lit("")), F.format_string(" Follows adr-%04d.", "_first"))).drop("_p", "_first")


def turn_names_commit(spark, sf_dir):
    """Notes on touches that cite a commit of their project by the first digits of its name; no turn of the tables cites one."""
    notes = table(spark, sf_dir, "session_file_touches").where("commit_sha IS NOT NULL").select("touch_id", "project_id", F.concat(F.lit("went into "), F.upper(F.left("commit_sha", F.lit(9))), F.lit(", see there")).alias("note")).distinct()
    return d.names_commit(notes, F.col("note"), table(spark, sf_dir, "commits"), "touch_id")


def decision_files(spark, sf_dir):
    return d.decision_files(_mined(spark, sf_dir), table(spark, sf_dir, "commit_files"))


def decision_without_files(spark, sf_dir):
    files = table(spark, sf_dir, "commit_files").where("added IS NOT NULL")
    return d.without_files(_mined(spark, sf_dir), d.decision_files(_mined(spark, sf_dir), files)).select("decision_id", "project_id")


def decision_one_per_reference(spark, sf_dir):
    return d.one_per_reference(table(spark, sf_dir, "decisions")).groupBy("source").agg(F.count("*").alias("n"), F.sum("decision_id").alias("ids"))


def decision_neighbours(spark, sf_dir):
    return d.neighbours(d.names_record(_citing(spark, sf_dir), table(spark, sf_dir, "decisions")))


QUERIES = {
    f.__name__: f
    for f in (
        session_bounds, session_ingest, session_redacted, session_adopted, turn_sha256, turn_repositories, tool_call_touches, tool_touches_within, log_turns, session_records, store_upsert, store_insert_new,
        store_replace_scope, decision_commits, decision_records, decision_numbers, decision_names_record, turn_names_commit, decision_files, decision_without_files,
        decision_one_per_reference, decision_neighbours,
    )
}

_EVENTS = r"""
ev as (select *, regexp_replace(lower(external_id), '^urn:uuid:|[{}]', '', 'g') as session, regexp_replace(lower(content_hash), '^sha256:', '') as hash from session_events)"""
_INGEST = f"""{_EVENTS},
stored as (select * from (select *, row_number() over (partition by source, session, seq order by delivered_at, delivery_id) as n from ev
           where delivered_at < timestamptz '2025-01-01 00:00:00+00') where n = 1),
arriving as (select * from (select *, row_number() over (partition by source, session, seq order by delivered_at desc, delivery_id desc) as n from ev) where n = 1),
mark as (select source, session, max(seq) as m, arg_max(hash, seq) as h from stored group by all),
state as (select k.*, (select max(a.hash) from arriving a where a.source = k.source and a.session = k.session and a.seq = k.m) is distinct from k.h as rewritten from mark k)"""
_NAMES = r"""
numbers as (
  select project_id, number, max(decision_id) as record from (
    select project_id, decision_id, try_cast(coalesce(nullif(regexp_extract(source_ref, '(?i)ADR[-\s]?0*(\d{1,4})', 1), ''), nullif(regexp_extract(summary, '(?i)ADR[-\s]?0*(\d{1,4})', 1), '')) as int) as number
    from decisions where source = 'adr') where number is not null group by all),
named as (
  select distinct c.decision_id, n.record as related_decision_id from (
    select decision_id, project_id, unnest(regexp_extract_all(coalesce(summary, '') || chr(10) || coalesce(rationale, '') || ' Follows adr-' || lpad(cast(first as varchar), 4, '0') || '.', '(?i)\bADR[-\s]?0*(\d{1,4})\b', 1)) as ref
    from decisions join (select project_id, min(number) as first from numbers group by all) using (project_id) where source <> 'adr') c join numbers n on c.project_id is not distinct from n.project_id and cast(c.ref as int) = n.number where c.decision_id <> n.record)"""
_MINED = r"""
mined as (
  select commit_id as decision_id, project_id, 'commit' as source, left(sha, 12) as source_ref, coalesce(nullif(trim(string_split(message, chr(10))[1]), ''), '(no subject)') as summary,
         case when contains(message, chr(10)) then nullif(regexp_replace(regexp_replace(message, '^[^\n]*\n', ''), '^\s+|\s+$', '', 'g'), '') end as rationale,
         sha as commit_sha, authored_at as decided_at from commits)"""

ORACLE = {
    "session_bounds": f"with {_EVENTS} select source, session, count(*) as turns, max(seq) as watermark, epoch_us(min(delivered_at)) as first_at, epoch_us(max(delivered_at)) as last_at from ev group by all",
    "session_ingest": f"""with {_INGEST}
select a.source, a.session, a.seq, a.hash as content_hash, case when coalesce(s.rewritten, false) then 'rewritten' else 'new' end as action
from arriving a left join state s using (source, session) where s.m is null or s.rewritten or a.seq > s.m""",
    "session_redacted": f"""with {_EVENTS} select e.project_id, count(*) as turns, count(case when s.content_stored then content end) as with_text
from ev e left join sessions s on s.source = e.source and s.external_id = e.session group by all""",
    "session_adopted": f"""with {_EVENTS} select coalesce(e.project_id, s.project_id) as project_id, count(*) as turns
from ev e left join sessions s on s.source = e.source and s.external_id = e.session group by 1""",
    "turn_sha256": "select delivery_id, sha256(content) as sha256 from session_events where content is not null",
    "turn_repositories": r"""
select 'ssh' as scheme, regexp_extract(url, '^git@([^:]+):', 1) as host, regexp_extract(url, ':(.*)/[^/]+$', 1) as owner, regexp_extract(url, '([^/:]+)\.git$', 1) as name, count(*) as mentions
from (select unnest(regexp_extract_all(content, 'git@[\w.-]+:[\w./-]+\.git')) as url from session_events where content like '%git@%') group by all""",
    "store_upsert": "select source, external_id, project_id, started_at, case when content_stored then ended_at end as ended_at from sessions",
    "store_insert_new": """
select source, count(*) as n, max(summary) as last from (
  select source, summary from decisions where source <> 'issue'
  union all select source, min(summary) from decisions where source = 'issue' group by source, source_ref, project_id) group by all""",
    "store_replace_scope": """
with linked as (select * from session_file_touches where commit_sha is not null and touch_kind = 'write')
select touch_kind, count(*) as n, cast(sum(touch_id) as bigint) as ids from (
  select touch_kind, touch_id from session_file_touches where session_id not in (select session_id from linked) union all select touch_kind, touch_id from linked) group by all""",
    "decision_commits": f"with {_MINED} select * replace (epoch_us(decided_at) as decided_at), case when rationale is not null then 0.6::double else 0.3::double end as confidence from mined",
    "decision_records": r"""
select project_id, doc_path as source_ref, title as summary, length(nullif(rest, '')) as rationale_chars, nullif(trim(regexp_extract(head, '(?i)status[^\p{L}]*(\p{L}[\p{L} ]*\p{L})', 1)), '') as status,
       try_cast(nullif(regexp_extract(head, '\d{4}-\d\d-\d\d'), '') as date) as decided_on, 0.95::double as confidence
from (select *, regexp_extract(text, '(?m)^#[ \t]+(\S.*?)[ \t]*$', 1) as title, regexp_replace(text, '(?s)(^|\n)##\s.*', '\1') as head,
             regexp_replace(regexp_replace(text, '(?s)\A(.*?\n)??#[ \t]+\S[^\n]*(\n|\z)', ''), '\A\s+|\s+\z', '', 'g') as rest from documents where doc_path like 'adr/%') where title <> ''""",
    "decision_numbers": f"with {_NAMES} select project_id, number, record as decision_id from numbers",
    "decision_names_record": f"with {_NAMES} select * from named",
    "turn_names_commit": r"""
select distinct t.touch_id, c.commit_id from (select touch_id, project_id, lower(left(commit_sha, 9)) as ref from session_file_touches where commit_sha is not null) t
join commits c on c.project_id is not distinct from t.project_id and (starts_with(lower(c.sha), t.ref) or starts_with(t.ref, lower(c.sha)))""",
    "decision_files": "select distinct c.commit_id as decision_id, c.project_id, f.path from commits c join commit_files f using (sha)",
    "decision_without_files": "select commit_id as decision_id, project_id from commits where sha not in (select sha from commit_files where added is not null)",
    "decision_one_per_reference": """
select source, count(*) as n, cast(sum(id) as bigint) as ids from (
  select source, min(decision_id) as id from decisions where source_ref <> '' group by source, source_ref, project_id
  union all select source, decision_id from decisions where source_ref is null or source_ref = '') group by all""",
    "decision_neighbours": f"with {_NAMES} select decision_id, related_decision_id as related from named union select related_decision_id, decision_id from named",
}
