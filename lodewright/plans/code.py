"""Queries over source files. The tables hold none, so files are written here from what they do hold.

Every order is a Python function with one condition for each of its line items, in a file of its customer. Every file that a
turn says imports another is a file with that import, in its own language.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.operators import findings as f
from lodewright.operators import functions_of as fn
from lodewright.operators import graph as g
from lodewright.operators import structure as s
from lodewright.session import table

_SAID = r"([a-z]+/[a-z_0-9]+)\.(py|ts) imports ([a-z]+/[a-z_0-9]+)\.(py|ts)"


def _functions(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    body = F.concat(F.format_string("def order_%d(x):\n", "o_orderkey"), F.expr("repeat('    if x:\n        x += 1\n', n)"), F.lit("    return x\n"))
    files = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", body.alias("b")))), lambda x: x["b"]), "\n").alias("content"))
    return files.select((F.col("o_custkey") % 60 + 1).alias("project_id"), F.format_string("orders/customer_%d.py", "o_custkey").alias("path"), "content")


def _metrics(spark, sf_dir):
    return fn.function_metrics(s.inventory(_functions(spark, sf_dir)))


def function_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


def function_summary(spark, sf_dir):
    return fn.function_summary(_metrics(spark, sf_dir))


def finding_long_functions(spark, sf_dir):
    """With ten lines being long."""
    return f.long_function(_metrics(spark, sf_dir), least=10)


def finding_complex_functions(spark, sf_dir):
    """With more than five branches being complex."""
    return f.complex_function(_metrics(spark, sf_dir), least=5)


def _imports(spark, sf_dir):
    """Files with the imports that turns report of them; what is imported is a file too."""
    turns = table(spark, sf_dir, "session_events").where("project_id IS NOT NULL AND content LIKE '% imports %'")
    part = lambda n: F.regexp_extract_all("content", F.lit(_SAID), F.lit(n)).alias(f"g{n}")
    said = turns.select("project_id", F.explode(F.arrays_zip(*[part(n) for n in (1, 2, 3, 4)])).alias("e")).select("project_id", "e.*")
    line = F.when(F.col("g2") == "py", F.concat(F.lit("import "), F.replace("g3", F.lit("/"), F.lit(".")))).otherwise(F.concat(F.lit("import x from '../"), "g3", F.lit("';")))
    ends = said.select("project_id", F.concat_ws(".", "g1", "g2").alias("path"), line.alias("line")).unionByName(said.select("project_id", F.concat_ws(".", "g3", "g4").alias("path"), F.lit(None).cast("string").alias("line")))
    return ends.groupBy("project_id", "path").agg(F.array_join(F.sort_array(F.collect_set("line")), "\n").alias("content"))


def _edges(spark, sf_dir):
    return g.import_edges(s.inventory(_imports(spark, sf_dir)))


def import_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


def finding_heavy_imports(spark, sf_dir):
    """With one importer being many."""
    return f.heavy_import(g.degrees(_edges(spark, sf_dir)), least=1)


def finding_deep_nesting(spark, sf_dir):
    """With a depth of one being deep."""
    files = table(spark, sf_dir, "documents").select("project_id", F.col("doc_path").alias("path"), F.col("text").alias("content")).where("project_id IS NOT NULL")
    return f.deep_nesting(s.module_rollup(s.inventory(files)), deepest=0)


def finding_debt_markers(spark, sf_dir):
    turns = table(spark, sf_dir, "session_events").where("project_id IS NOT NULL")
    return f.debt_marker(f.marker_locations(turns.select("project_id", F.col("delivery_id").cast("string").alias("path"), "content")))


QUERIES = {
    q.__name__: q
    for q in (function_metrics, function_summary, finding_long_functions, finding_complex_functions, import_edges, finding_heavy_imports, finding_deep_nesting, finding_debt_markers)
}

_FN = """
fn as (
  select o_custkey % 60 + 1 as project_id, 'orders/customer_' || o_custkey || '.py' as path, 'order_' || o_orderkey as function,
         cast(1 + coalesce(sum(2 * n + 3) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as int) as line,
         cast(2 * n + 2 as int) as lines, cast(n + 1 as int) as complexity
  from orders join (select l_orderkey, count(*) as n from lineitem group by all) on l_orderkey = o_orderkey)"""
_FILES = r"""
said as (
  select project_id, regexp_extract(m, '^(.*)\.(py|ts) imports (.*)\.(py|ts)$', ['a', 'x', 'b', 'y']) as r
  from (select project_id, unnest(regexp_extract_all(content, '[a-z]+/[a-z_0-9]+\.(?:py|ts) imports [a-z]+/[a-z_0-9]+\.(?:py|ts)')) as m
        from session_events where project_id is not null and content like '% imports %')),
edges as (
  select distinct s.project_id, s.r.a as src, s.r.b as dst from said s
  where s.r.a <> s.r.b and exists (select 1 from said t where t.project_id = s.project_id and ((t.r.a = s.r.b and t.r.x = s.r.x) or (t.r.b = s.r.b and t.r.y = s.r.x))))"""
_MARKED = "marked as (" + " union all ".join(
    f"select project_id, cast(delivery_id as varchar) as path, k as line, '{m}' as marker, {w}::double as weight from lines where regexp_matches(t, '{p}')" for m, (p, w) in s.MARKERS.items()
) + ")"

ORACLE = {
    "function_metrics": f"with {_FN} select * from fn",
    "function_summary": f"""with {_FN} select project_id, count(*) as functions, median(lines) as median_lines, median(complexity) as median_complexity, max(complexity) as max_complexity,
       count(*) filter (lines > 60) as long_functions, count(*) filter (complexity > 10) as complex_functions from fn group by all""",
    "finding_long_functions": f"""with {_FN} select project_id, 'complexity' as analyzer, 'long_function' as category, 'Long function: ' || function || '() in ' || path || ' (' || lines || ' lines)' as title,
       'medium' as severity, path, lines / 2 as score from (select *, row_number() over (partition by project_id order by lines desc, path, line) as k from fn where lines > 10) where k <= 10""",
    "finding_complex_functions": f"""with {_FN} select project_id, 'complexity' as analyzer, 'high_complexity' as category, 'Complex function: ' || function || '() in ' || path || ' (CC ' || complexity || ')' as title,
       'medium' as severity, path, complexity * 4.0::double as score from (select *, row_number() over (partition by project_id order by complexity desc, path, line) as k from fn where complexity > 5) where k <= 10""",
    "import_edges": f"with {_FILES} select * from edges",
    "finding_heavy_imports": f"""with {_FILES}
select project_id, 'dependencies' as analyzer, 'god_module_imports' as category, 'Heavy import target: ' || dst as title, 'medium' as severity, dst as path, 50.0::double as score from (
  select *, row_number() over (partition by project_id order by n desc, dst) as k from (select project_id, dst, count(*) as n from edges group by all)) where k <= 3""",
    "finding_deep_nesting": """
select project_id, 'architecture' as analyzer, 'deep_nesting' as category, 'Deep nesting: ' || module || '/ (depth ' || d || ')' as title, 'medium' as severity, module || '/' as path, 50.0::double as score from (
  select *, row_number() over (partition by project_id order by loc desc, module) as k from (
    select project_id, string_split(doc_path, '/')[1] as module, max(len(string_split(doc_path, '/')) - 1) as d,
           sum(length(text) - length(replace(text, chr(10), '')) + case when text <> '' and not suffix(text, chr(10)) then 1 else 0 end) as loc
    from documents where project_id is not null and doc_path like '%/%' group by all)) where k <= 5""",
    "finding_debt_markers": f"""
with lines as (
  select project_id, delivery_id, generate_subscripts(l, 1) as k, unnest(l) as t from (
    select project_id, delivery_id, string_split(content, chr(10)) as l from session_events
    where project_id is not null and not regexp_matches(string_split(content, chr(10))[1], '^(#|//|/\\*).*(?i:auto[-_]?generated)'))), {_MARKED}
select project_id, 'tech_debt' as analyzer, 'debt_' || marker as category, upper(marker) || ' at ' || path || ':' || line as title,
       case when marker in ('fixme', 'hack', 'deprecated') then 'medium' else 'low' end as severity, path, weight * 10 as score
from (select *, row_number() over (partition by project_id order by path, line, marker) as n from marked) where n <= 30""",
}
