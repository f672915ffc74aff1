"""Queries over documents as the file inventory, and over turns as texts that carry markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.operators import structure as s
from lodewright.session import table


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("project_id", F.col("doc_path").alias("path"), F.col("text").alias("content"))


def _inv(spark, sf_dir):
    return s.inventory(_files(spark, sf_dir))


def _modules(spark, sf_dir):
    return s.module_rollup(_inv(spark, sf_dir))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "session_events").select("project_id", F.col("delivery_id").cast("string").alias("path"), "content")


def _markers(spark, sf_dir):
    return s.marker_counts(_turns(spark, sf_dir))


def loc_per_file(spark, sf_dir):
    return _inv(spark, sf_dir).select("project_id", "path", "module", "depth", "language", "size_bytes", "loc")


def loc_estimated(spark, sf_dir):
    return _files(spark, sf_dir).select("path", s.estimated_lines(F.col("content")).alias("loc"))


def arch_module_rollup(spark, sf_dir):
    return _modules(spark, sf_dir)


def arch_god_modules(spark, sf_dir):
    return s.god_modules(_modules(spark, sf_dir))


def arch_imbalance(spark, sf_dir):
    return s.module_imbalance(_modules(spark, sf_dir))


def arch_score(spark, sf_dir):
    return s.architecture_score(_modules(spark, sf_dir))


def lang_rollup(spark, sf_dir):
    return s.language_rollup(_inv(spark, sf_dir))


def cx_medians(spark, sf_dir):
    return s.size_medians(_inv(spark, sf_dir))


def cx_long_files(spark, sf_dir):
    return s.long_files(_inv(spark, sf_dir), least=60)


def cx_comment_ratio(spark, sf_dir):
    return s.comment_ratio(_inv(spark, sf_dir))


def cx_score(spark, sf_dir):
    medians, ratio = s.size_medians(_inv(spark, sf_dir)), s.comment_ratio(_inv(spark, sf_dir)).withColumnRenamed("project_id", "_p")
    none = F.lit(None).cast("int")
    both = medians.join(ratio, F.col("project_id").eqNullSafe(F.col("_p")))
    return both.select("project_id", s.complexity_score(F.col("long_files"), none, none, F.col("comment_ratio")).alias("score"))


def debt_marker_counts(spark, sf_dir):
    return _markers(spark, sf_dir)


def debt_density(spark, sf_dir):
    loc = _turns(spark, sf_dir).groupBy("project_id").agg(F.coalesce(F.sum(s.lines_of_code(F.col("content"))), F.lit(0)).alias("loc"))
    return s.debt_density(_markers(spark, sf_dir), loc)


def debt_files(spark, sf_dir):
    return s.debt_files(_markers(spark, sf_dir), least=2)


def generated_filter(spark, sf_dir):
    return _files(spark, sf_dir).where(~s.is_generated(F.col("content")) & ~s.is_vendored(F.col("path"))).groupBy("project_id").agg(F.count("*").alias("files"))


def glob_exclude(spark, sf_dir):
    kept = table(spark, sf_dir, "commit_files").where(~s.matches_any(F.col("path"), ["*.md", "cache/*", "*/re[al]der_?.*"]))
    return kept.select("project_id", "path").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        loc_per_file, loc_estimated, arch_module_rollup, arch_god_modules, arch_imbalance, arch_score, lang_rollup, cx_medians, cx_long_files, cx_comment_ratio, cx_score,
        debt_marker_counts, debt_density, debt_files, generated_filter, glob_exclude,
    )
}

_LOC = "case when {0} = '' then 0 else length({0}) - length(replace({0}, chr(10), '')) + case when ends_with({0}, chr(10)) then 0 else 1 end end"
_LANG = "case " + " ".join(f"when ext = '{e}' then '{lang}'" for e, lang in s.LANGUAGES.items()) + " else 'unknown' end"
_INV = f"""
inv as (
  select project_id, path, case when path like '%/%' then string_split(path, '/')[1] else '(root)' end as module,
         len(string_split(path, '/')) - 1 as depth, {_LANG} as language, strlen(content) as size_bytes, {_LOC.format('content')} as loc, content
  from (select project_id, doc_path as path, coalesce(text, '') as content,
               lower(regexp_extract(string_split(doc_path, '/')[-1], '[^.](\\.[^.]+)$', 1)) as ext
        from documents where doc_path is not null and doc_path <> ''))"""
_MODULES = """
modules as (
  select *, cast(round(cast(loc / greatest(sum(loc) over (partition by project_id), 1) as decimal(38, 12)), 3) as double) as share
  from (select project_id, module, count(*) as files, cast(sum(loc) as bigint) as loc, max(depth) as max_depth,
               array_to_string(list_sort(list(distinct language)), ',') as languages from inv group by all))"""
_GOD = """
god as (
  select project_id, module, loc, share, row_number() over (partition by project_id order by loc desc, module) as place,
         case when share > 0.6 then 'high' else 'medium' end as severity
  from modules where loc > 5000 or share > 0.5)"""
_RATIO = r"""
ratio as (
  select *, case when measured_loc > 0 then cast(round(cast(comment_lines / measured_loc as decimal(38, 12)), 4) as double) end as comment_ratio
  from (select project_id, cast(sum(len(regexp_extract_all(content, '(?m)^\s*#.*$')) + len(regexp_extract_all(content, '(?m)^\s*//.*$'))) as bigint) as comment_lines,
               cast(sum(loc) as bigint) as measured_loc from inv group by all))"""
_MARKERS = (
    "markers as (select project_id, path, marker, n, first_line from ("
    + " union all ".join(
        f"select project_id, cast(delivery_id as varchar) as path, '{name}' as marker, len(regexp_extract_all(content, '{p}')) as n, "
        f"length(regexp_extract(content, '(?s)^(.*?){p}', 1)) - length(replace(regexp_extract(content, '(?s)^(.*?){p}', 1), chr(10), '')) + 1 as first_line "
        "from session_events where content is not null and not regexp_matches(string_split(content, chr(10))[1], '^(#|//|/\\*).*(?i:auto[-_]?generated)')"
        for name, (p, _) in s.MARKERS.items()
    )
    + ") where n > 0)"
)
_WEIGHT = "case marker " + " ".join(f"when '{m}' then {w}::double" for m, (_, w) in s.MARKERS.items()) + " end"
_NUM = "cast(round(cast({} as decimal(38, 12)), {}) as double)"

ORACLE = {
    # no text of the tables is over the 2 MiB from which lines are estimated
    "loc_estimated": f"select doc_path as path, {_LOC.format('text')} as loc from documents",
    "loc_per_file": f"with {_INV} select project_id, path, module, depth, language, size_bytes, loc from inv",
    "arch_module_rollup": f"with {_INV}, {_MODULES} select * from modules",
    "arch_god_modules": f"with {_INV}, {_MODULES}, {_GOD} select * from god",
    "arch_imbalance": f"""with {_INV}, {_MODULES}
select project_id, count(*) as modules, case when count(*) >= 3 then {_NUM.format('max(loc) / greatest(sum(loc) - max(loc), 1)', 4)} else 0 end as imbalance from modules group by all""",
    "arch_score": f"""with {_INV}, {_MODULES}, {_GOD}
select m.project_id, coalesce(g.god, 0) as god, m.deep, {_NUM.format('greatest(0, 100 - least(35.0::double, coalesce(g.god * 15 + (g.s - 0.4::double) * 30, 0)) - least(15, m.deep * 5))', 1)} as score
from (select project_id, count(*) filter (max_depth > 4) as deep from modules group by all) m
left join (select project_id, count(*) as god, max(case when place = 1 then share end) as s from god group by all) g on m.project_id is not distinct from g.project_id""",
    "lang_rollup": f"with {_INV} select project_id, language, count(*) as files, cast(sum(loc) as bigint) as loc, cast(sum(size_bytes) as bigint) as size_bytes from inv group by all",
    "cx_medians": f"with {_INV} select project_id, count(*) as files, median(loc) as median_loc, max(loc) as max_loc, count(*) filter (loc > 500) as long_files from inv group by all",
    "cx_long_files": f"""with {_INV}
select project_id, path, loc, place, case when loc > 1500 then 'high' else 'medium' end as severity, {_NUM.format('least(100.0, loc / 15)', 4)} as score
from (select *, row_number() over (partition by project_id order by loc desc, path) as place from inv where loc > 60) where place <= 10""",
    "cx_comment_ratio": f"with {_INV}, {_RATIO} select * from ratio",
    "cx_score": f"""with {_INV}, {_RATIO}
select m.project_id, {_NUM.format('greatest(0, 100 - least(30, m.n * 4) - case when r.comment_ratio < 0.05 then 10 else 0 end)', 1)} as score
from (select project_id, count(*) filter (loc > 500) as n from inv group by all) m join ratio r on m.project_id is not distinct from r.project_id""",
    "debt_marker_counts": f"with {_MARKERS} select * from markers",
    "debt_density": f"""with {_MARKERS},
loc as (select project_id, cast(coalesce(sum({_LOC.format('content')}), 0) as bigint) as loc from session_events group by all),
total as (select project_id, sum(n * {_WEIGHT}) as w, sum(case when marker = 'fixme' then n else 0 end) as fixmes from markers group by all),
merged as (select l.project_id, coalesce(w, 0) as w, cast(coalesce(fixmes, 0) as bigint) as fixmes, loc, coalesce(w, 0) / greatest(loc / 1000, 1) as d
         from loc l left join total t on l.project_id is not distinct from t.project_id)
select project_id, {_NUM.format('w', 1)} as weighted, fixmes, loc, {_NUM.format('d', 4)} as density,
       cast(100 - case when d <= 0.5 then 0 when d <= 2 then 5 when d <= 5 then 15 else 30 end - case when fixmes >= 10 then 5 else 0 end as double) as score from merged""",
    "debt_files": f"""with {_MARKERS}
select * from (select *, row_number() over (partition by project_id order by weighted desc, path) as place
               from (select project_id, path, {_NUM.format(f'sum(n * {_WEIGHT})', 1)} as weighted from markers group by all) where weighted >= 2) where place <= 3""",
    "generated_filter": r"""
select project_id, count(*) as files from documents
where not regexp_matches(string_split(text, chr(10))[1], '^(#|//|/\*).*(?i:auto[-_]?generated)')
  and not list_has_any(string_split(doc_path, '/'), ['node_modules', 'vendor', 'venv', '.venv', 'dist', 'build', '__pycache__', '.git'])
group by all""",
    "glob_exclude": r"select distinct project_id, path from commit_files where not (path like '%.md' or path like 'cache/%' or regexp_matches(path, '^.*/re[al]der_.\..*$'))",
}
