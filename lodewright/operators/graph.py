"""Module graphs: import extraction and resolution, degrees, coupling, cycles, and the scores built on them.

Edges have project_id, src and dst; loops and repetitions do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodewright.functions.paths import base_name
from lodewright.functions.scores import guarded_ratio, rounded
from lodewright.operators.functions_of import python_imports
from lodewright.session import cut_lineage

# Patterns of imports, and the endings tried for a script's name.
PYTHON_IMPORT = r"(?m)^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))"
JS_IMPORT = r"""(?m)(?:^\s*import\s+.*?from\s+['"]([^'"]+)['"]|^\s*import\s+['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\))"""
JS_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.js"]
# The ends of test files, which do not count as types.
TEST_ENDS = ("test.py", "_test.go", ".test.ts", "Test.java", ".spec.ts")
TARJAN_EDGES = 1_000_000


# ---- imports


def import_specs(inv: DataFrame) -> DataFrame:
    """project_id, path, language, spec: what Python and JavaScript or TypeScript files name in their imports; of the latter only relative names.

    Python files are read by their syntax trees; where one finds none (a text that does not parse, imports further in) by the pattern.
    """
    pieces = lambda pattern, groups: F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(g)) for g in groups]))
    scripts = inv.where(F.col("language").isin("javascript", "typescript")).select("project_id", "path", "language", F.filter(pieces(JS_IMPORT, (1, 2, 3)), lambda x: x.startswith(".")).alias("specs"))
    walked = F.when(F.size("specs") > 0, F.col("specs")).otherwise(pieces(PYTHON_IMPORT, (1, 2)))
    python = python_imports(inv).select("project_id", "path", F.lit("python").alias("language"), walked.alias("specs"))
    specs = python.unionByName(scripts)
    return specs.select("project_id", "path", "language", F.explode(F.array_distinct(F.filter("specs", lambda x: ~x.isin("", ".", "..")))).alias("spec"))


def source_roots(inv: DataFrame) -> DataFrame:
    """project_id, root: the top of each project and the parents of its outermost Python packages, ending in a slash if not empty."""
    packages = inv.where(base_name(F.col("path")) == "__init__.py").select("project_id", F.regexp_replace("path", r"/?__init__\.py$", "").alias("dir")).distinct()
    parents = packages.select(F.col("project_id").alias("_p"), F.col("dir").alias("_d"))
    outer = packages.withColumn("_up", F.regexp_replace("dir", r"/?[^/]*$", ""))
    tops = outer.join(parents, (F.col("project_id").eqNullSafe(F.col("_p"))) & (F.col("_up") == F.col("_d")), "left_anti").select("project_id", F.col("_up").alias("root"))
    every = inv.select("project_id").distinct().withColumn("root", F.lit(""))
    return tops.unionByName(every).distinct().withColumn("root", F.when(F.col("root") == "", "").otherwise(F.concat("root", F.lit("/"))))


def _climb(path: Column, levels: Column) -> Column:
    """The directory so many levels above a file (1 is its own), ending in a slash if not empty."""
    parts = F.split(path, "/")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - levels, F.lit(0)))
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "/"), F.lit("/"))).otherwise(F.lit(""))


def import_edges(inv: DataFrame) -> DataFrame:
    """project_id, src, dst: the modules (paths without extension) whose files import one another, as far as names lead to files of the project.

    Candidates are tried in order, relative ones from the importing file, absolute ones from each source root; the first file wins.
    """
    specs = import_specs(inv)
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    tail = F.replace(F.regexp_replace("spec", r"^\.+", ""), F.lit("."), F.lit("/"))
    relative = F.concat(_climb(F.col("path"), dots), tail)
    python_ends = [".py", "/__init__.py"]
    python = specs.where("language = 'python'").join(source_roots(inv).withColumnRenamed("project_id", "_p"), F.col("project_id").eqNullSafe(F.col("_p"))).drop("_p")
    stem = F.when(dots > 0, relative).otherwise(F.concat("root", tail))
    py = python.select("project_id", "path", "spec", F.posexplode(F.array(*[F.regexp_replace(F.concat(stem, F.lit(e)), "(^|/)/", "$1") for e in python_ends])).alias("_rank", "target"), F.length("root").alias("_far"))
    up = F.size(F.split("spec", r"\.\./")) - 1
    plain = F.regexp_replace("spec", r"^(\.\.?/)+", "")
    js = specs.where("language <> 'python'").select(
        "project_id", "path", "spec", F.posexplode(F.array(*[F.concat(_climb(F.col("path"), up + 1), plain, F.lit(e)) for e in JS_ENDINGS])).alias("_rank", "target"), F.lit(0).alias("_far")
    )
    files = inv.select(F.col("project_id").alias("_p"), F.col("path").alias("_file")).distinct()
    tried = py.unionByName(js).join(files, F.col("project_id").eqNullSafe(F.col("_p")) & (F.col("target") == F.col("_file")))
    won = tried.groupBy("project_id", "path", "spec").agg(F.min_by("target", F.struct("_far", "_rank")).alias("target"))
    module = lambda c: F.regexp_replace(F.regexp_replace(c, r"(/__init__|/index)\.\w+$", ""), r"(?<=[^/.])\.[^./]+$", "")
    return simple_edges(won.select("project_id", module("path").alias("src"), module("target").alias("dst")))


# ---- edges and degrees


def simple_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).select("project_id", "src", "dst").distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """project_id, module, fan_in, fan_out of every module on an edge, and of those of nodes (project_id, module) without one."""
    ends = edges.select("project_id", F.col("src").alias("module"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.select("project_id", F.col("dst").alias("module"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    if nodes is not None:
        ends = ends.unionByName(nodes.select("project_id", "module", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("project_id", "module").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def orphans(degree: DataFrame) -> DataFrame:
    return degree.where((F.col("fan_in") == 0) & (F.col("fan_out") == 0) & ~F.col("module").startswith(".")).select("project_id", "module")


def abstractness(files: DataFrame, module: Column) -> DataFrame:
    """project_id, module, types, abstract: files by module, and those whose names suggest abstract types; tests are no types."""
    name = base_name(F.col("path"))
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")
    hints = stem.rlike(r"^(\p{Lu}|interface|abs_|base_|abstract_)") | name.endswith(".h")
    test = F.lit(False)
    for end in TEST_ENDS:
        test = test | F.col("path").endswith(end)
    return files.groupBy("project_id", module.alias("module")).agg(F.count_if(~test).alias("types"), F.count_if(hints).alias("abstract"))


def coupling(degree: DataFrame, abstract: DataFrame) -> DataFrame:
    """project_id, module, ca, ce, instability, abstractness, distance, each rounded to three digits."""
    joined = degree.join(abstract, ["project_id", "module"], "left")
    unrounded = guarded_ratio(F.col("fan_out"), F.col("fan_in") + F.col("fan_out"))
    types = F.coalesce("types", F.lit(0))
    share = F.when(types > 0, F.least(F.lit(1.0), F.coalesce("abstract", F.lit(0)) / F.greatest(types, F.lit(1)))).otherwise(0.0)
    return joined.select(
        "project_id", "module", F.col("fan_in").alias("ca"), F.col("fan_out").alias("ce"), rounded(unrounded, 3).alias("instability"),
        rounded(share, 3).alias("abstractness"), rounded(F.abs(share + unrounded - 1) / F.sqrt(F.lit(2.0)), 3).alias("distance"),
    )


def painful(coupled: DataFrame, top: int = 10) -> DataFrame:
    order = Window.partitionBy("project_id").orderBy(F.desc("distance"), "module")
    found = coupled.where((F.col("distance") > 0.5) & (F.col("ca") >= 3)).withColumn("place", F.row_number().over(order))
    return found.where(F.col("place") <= top).withColumn("severity", F.when(F.col("ca") >= 10, "high").otherwise("medium"))


def coupling_score(coupled: DataFrame) -> DataFrame:
    """project_id, score, avg_instability."""
    bad = coupled.where((F.col("distance") > 0.5) & (F.col("ca") >= 3)).groupBy("project_id").agg(F.count("*").alias("_n"), F.max("distance").alias("_top"))
    base = coupled.groupBy("project_id").agg(rounded(F.avg("instability"), 3).alias("avg_instability")).join(bad, "project_id", "left")
    penalty = F.least(F.lit(35.0), F.coalesce(F.col("_n") * 5 + (F.col("_top") - 0.5) * 30, F.lit(0.0)))
    return base.select("project_id", rounded(F.greatest(F.lit(0.0), 100 - penalty), 1).alias("score"), "avg_instability")


# ---- strongly connected components


def _tarjan(edges: pd.DataFrame) -> dict[str, str]:
    """The smallest member of each node's component, by one depth-first pass with an explicit stack."""
    out: dict[str, list[str]] = {}
    for a, b in zip(edges["src"], edges["dst"]):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    path: list[str] = []
    on_path: set[str] = set()
    label: dict[str, str] = {}
    for start in out:
        if start in number:
            continue
        work: list[tuple[str, Iterator[str]]] = [(start, iter(out[start]))]
        number[start] = low[start] = len(number)
        path.append(start)
        on_path.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    path.append(nxt)
                    on_path.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on_path:
                    low[node] = min(low[node], number[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while True:
                        members.append(path.pop())
                        on_path.discard(members[-1])
                        if members[-1] == node:
                            break
                    name = min(members)
                    label.update(dict.fromkeys(members, name))
    return label


def _components_by_colour(edges: DataFrame) -> DataFrame:
    """project_id, module, component for graphs too large for one task: trimming, forward colours, backward reach, repeated."""
    left, done = cut_lineage(edges), None
    while True:
        # Modules without a way in or out are components of their own and leave the graph.
        while True:
            keep = left.join(left.select("project_id", F.col("dst").alias("src")).distinct(), ["project_id", "src"], "left_semi")
            keep = cut_lineage(keep.join(left.select("project_id", F.col("src").alias("dst")).distinct(), ["project_id", "dst"], "left_semi").select("project_id", "src", "dst"))
            same, left = keep.count() == left.count(), keep
            if same:
                break
        if left.isEmpty():
            return done if done is not None else edges.select("project_id", F.col("src").alias("module"), F.col("dst").alias("component")).limit(0)
        colours = cut_lineage(left.select("project_id", F.col("src").alias("module"), F.col("src").alias("colour")).distinct())
        while True:
            pushed = left.join(colours, (left.project_id == colours.project_id) & (left.src == colours.module)).select(left.project_id, F.col("dst").alias("module"), "colour")
            new = cut_lineage(colours.unionByName(pushed).groupBy("project_id", "module").agg(F.min("colour").alias("colour")))
            changed = new.join(colours, ["project_id", "module", "colour"], "left_anti")
            stop, colours = changed.isEmpty(), new
            if stop:
                break
        reach = cut_lineage(colours.where("module = colour"))
        inside = left.join(colours.withColumnsRenamed({"module": "src", "colour": "cs"}), ["project_id", "src"]).join(colours.withColumnsRenamed({"module": "dst", "colour": "cd"}), ["project_id", "dst"])
        inside = cut_lineage(inside.where("cs = cd").select("project_id", "src", "dst", F.col("cs").alias("colour")))
        while True:
            back = inside.join(reach.withColumnRenamed("module", "dst"), ["project_id", "dst", "colour"]).select("project_id", F.col("src").alias("module"), "colour")
            new = cut_lineage(reach.unionByName(back).distinct())
            stop, reach = new.count() == reach.count(), new
            if stop:
                break
        found = reach.select("project_id", "module", F.col("colour").alias("component"))
        done = found if done is None else cut_lineage(done.unionByName(found))
        gone = found.select("project_id", F.col("module").alias("src"))
        left = left.join(gone, ["project_id", "src"], "left_anti").join(gone.withColumnRenamed("src", "dst"), ["project_id", "dst"], "left_anti").select("project_id", "src", "dst")
        left = cut_lineage(left)


def components(edges: DataFrame, tarjan_edges: int = TARJAN_EDGES) -> DataFrame:
    """project_id, component (its smallest module), module: the members of the cycles, that is of components of two or more modules.

    A project's graph of up to tarjan_edges edges is solved in one task, larger ones by rounds of joins; the result is the same.
    """
    counts = edges.groupBy("project_id").agg(F.count("*").alias("_n"))
    small = edges.join(counts.where(F.col("_n") <= tarjan_edges), "project_id", "left_semi")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        label = _tarjan(group)
        return pd.DataFrame({"project_id": group["project_id"].iloc[0], "module": list(label), "component": list(label.values())})

    out = small.groupBy("project_id").applyInPandas(solve, f"project_id {dict(edges.dtypes)['project_id']}, module string, component string")
    if not counts.where(F.col("_n") > tarjan_edges).isEmpty():
        out = out.unionByName(_components_by_colour(edges.join(counts.where(F.col("_n") > tarjan_edges), "project_id", "left_semi")))
    cycles = out.groupBy("project_id", "component").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return out.join(cycles, ["project_id", "component"])


def dependency_score(degree: DataFrame, members: DataFrame) -> DataFrame:
    """project_id, cycles, largest, top_fan_in, score."""
    sizes = members.groupBy("project_id", "component").agg(F.count("*").alias("n"))
    per_project = sizes.groupBy("project_id").agg(F.count("*").alias("cycles"), F.max("n").alias("largest"), F.sum(F.least(F.lit(20), F.col("n") * 4)).alias("_pen"))
    base = degree.groupBy("project_id").agg(F.max("fan_in").alias("top_fan_in")).join(per_project, "project_id", "left")
    cycle_pen = F.least(F.lit(40.0), F.coalesce("_pen", F.lit(0)).cast("double"))
    top_pen = F.when(F.col("top_fan_in") >= 15, F.least(F.lit(15.0), F.col("top_fan_in") * 0.5)).otherwise(0.0)
    return base.select(
        "project_id", F.coalesce("cycles", F.lit(0)).alias("cycles"), F.coalesce("largest", F.lit(0)).alias("largest"), "top_fan_in", rounded(F.greatest(F.lit(0.0), 100 - cycle_pen - top_pen), 1).alias("score")
    )
