"""The findings of a scan, one function for each kind. All take what the other operators measured.

Each gives the rows of report.finding(): project_id, analyzer, category, title, severity, path and score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodewright.functions.scores import rounded
from lodewright.operators.report import finding
from lodewright.operators.structure import MARKERS, MAX_DEPTH, is_generated, is_vendored

# How many of each kind a project reports, and the thresholds of severities.
TOP_GOD, TOP_DEEP, TOP_CYCLES, TOP_IMPORTED, TOP_FUNCTIONS, TOP_MARKERS = 3, 5, 5, 3, 10, 30
HEAVY_IMPORTS, SHORT_CYCLE, CYCLE_NAMES, VERY_LONG_FUNCTION, VERY_COMPLEX = 10, 4, 25, 200, 20
# The ends of test files, whose markers weigh nothing, and the markers that weigh more.
TEST_ENDS = ("test.py", "_test.go", ".test.ts", ".test.js", "Test.java")
GRAVE_MARKERS = ("fixme", "hack", "deprecated")


def _first(rows: DataFrame, top: int, *order) -> DataFrame:
    """The first rows of each project."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("project_id").orderBy(*order))).where(F.col("_n") <= top).drop("_n")


def hotspot(hot: DataFrame) -> DataFrame:
    return finding(hot, "git_history", "hotspot", F.concat(F.lit("Hotspot: "), F.col("path")), F.col("severity"), F.col("path"), F.col("composite"))


def knowledge_island(lone: DataFrame) -> DataFrame:
    """lone is history.first_islands()."""
    return finding(lone, "git_history", "knowledge_island", F.concat(F.lit("Knowledge island: "), F.col("path")), F.lit("medium"), F.col("path"), F.lit(60.0))


def god_module(god: DataFrame, top: int = TOP_GOD) -> DataFrame:
    name = F.concat("module", F.lit("/"))
    return finding(god.where(F.col("place") <= top), "architecture", "god_module", F.concat(F.lit("God module: "), name), F.col("severity"), name, F.lit(80.0))


def deep_nesting(modules: DataFrame, deepest: int = MAX_DEPTH, top: int = TOP_DEEP) -> DataFrame:
    deep = _first(modules.where(F.col("max_depth") > deepest), top, F.desc("loc"), "module")
    name = F.concat("module", F.lit("/"))
    return finding(deep, "architecture", "deep_nesting", F.format_string("Deep nesting: %s (depth %d)", name, "max_depth"), F.lit("medium"), name, F.lit(50.0))


def import_cycle(members: DataFrame, top: int = TOP_CYCLES, names: int = CYCLE_NAMES) -> DataFrame:
    """The first cycles by name. A title lists at most names members; of larger cycles it says how many more there are."""
    key = ["project_id", "component"]
    sizes = _first(members.groupBy(*key).agg(F.count("*").alias("size")), top, "component")
    listed = members.join(sizes, key).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("module"))).where(F.col("_n") <= names)
    cycles = listed.groupBy(*key, "size").agg(F.array_join(F.sort_array(F.collect_list("module")), " → ").alias("_names"))
    more = F.when(F.col("size") > names, F.format_string(" → ... and %d more", F.col("size") - names)).otherwise("")
    short = F.col("size") <= SHORT_CYCLE
    return finding(cycles, "dependencies", "import_cycle", F.concat(F.lit("Import cycle: "), "_names", more), F.when(short, "high").otherwise("medium"), F.lit(None).cast("string"), F.when(short, 70.0).otherwise(40.0))


def heavy_import(degree: DataFrame, least: int = HEAVY_IMPORTS, top: int = TOP_IMPORTED) -> DataFrame:
    heavy = _first(degree.where(F.col("fan_in") >= least), top, F.desc("fan_in"), "module")
    return finding(heavy, "dependencies", "god_module_imports", F.concat(F.lit("Heavy import target: "), "module"), F.lit("medium"), F.col("module"), F.lit(50.0))


def long_file(long: DataFrame) -> DataFrame:
    """long is structure.long_files()."""
    return finding(long, "complexity", "long_file", F.format_string("Long file: %s (%,d LOC)", "path", "loc"), F.col("severity"), F.col("path"), F.col("score"))


def long_function(metrics: DataFrame, least: int = 60, top: int = TOP_FUNCTIONS) -> DataFrame:
    """metrics is functions_of.function_metrics()."""
    long = _first(metrics.where(F.col("lines") > least), top, F.desc("lines"), "path", "line")
    title = F.format_string("Long function: %s() in %s (%d lines)", "function", "path", "lines")
    return finding(long, "complexity", "long_function", title, F.when(F.col("lines") < VERY_LONG_FUNCTION, "medium").otherwise("high"), F.col("path"), F.col("lines") / 2)


def complex_function(metrics: DataFrame, least: int = 10, top: int = TOP_FUNCTIONS) -> DataFrame:
    found = _first(metrics.where(F.col("complexity") > least), top, F.desc("complexity"), "path", "line")
    title = F.format_string("Complex function: %s() in %s (CC %d)", "function", "path", "complexity")
    return finding(found, "complexity", "high_complexity", title, F.when(F.col("complexity") > VERY_COMPLEX, "high").otherwise("medium"), F.col("path"), F.col("complexity") * 4)


def marker_locations(texts: DataFrame, top: int = TOP_MARKERS) -> DataFrame:
    """project_id, path, line, marker, weight: the first places of debt markers in each project, by path, line and marker.

    texts has project_id, path and content. A line holds a marker once, however often it is written there.
    """
    any_marker = "|".join(f"(?:{p})" for p, _ in MARKERS.values())
    kept = texts.where(~is_vendored(F.col("path")) & F.col("content").rlike(any_marker)).where(~is_generated(F.col("content")))
    lines = kept.select("project_id", "path", F.posexplode(F.split("content", "\n")).alias("_at", "_line")).where(F.col("_line").rlike(any_marker))
    said = F.array(*[F.when(F.col("_line").rlike(p), F.struct(F.lit(name).alias("marker"), F.lit(w).alias("weight"))) for name, (p, w) in MARKERS.items()])
    return _first(lines.select("project_id", "path", (F.col("_at") + 1).alias("line"), F.inline(F.array_compact(said))), top, "path", "line", "marker")


def debt_marker(places: DataFrame) -> DataFrame:
    """places is marker_locations()."""
    test = F.lit(False)
    for end in TEST_ENDS:
        test = test | F.col("path").endswith(end)
    severity = F.when(test, "info").when(F.col("marker").isin(*GRAVE_MARKERS) & (F.col("weight") >= 1.5), "medium").otherwise("low")
    out = finding(places, "tech_debt", "debt_marker", F.format_string("%s at %s:%d", F.upper("marker"), "path", "line"), severity, F.col("path"), F.col("weight") * 10)
    return out.withColumn("category", F.concat(F.lit("debt_"), F.lower(F.substring_index("title", " ", 1))))


def debt_hotspot(files: DataFrame) -> DataFrame:
    """files is structure.debt_files()."""
    return finding(files, "tech_debt", "debt_hotspot", F.concat(F.lit("Debt hotspot: "), F.col("path")), F.lit("medium"), F.col("path"), rounded(F.col("weighted") * 5, 4))


def stable_concrete(pain: DataFrame) -> DataFrame:
    """pain is graph.painful()."""
    return finding(pain, "coupling", "stable_concrete", F.concat(F.lit("Painful to change: "), F.col("module")), F.col("severity"), F.col("module"), F.col("distance") * 100)
