"""The file inventory and what is read off it: modules, languages, size, comments, debt markers.

An inventory has project_id, path (relative, with slashes) and content; inventory() adds the rest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodewright.functions.paths import depth, extension, top_segment
from lodewright.functions.scores import guarded_ratio, rounded

# The language of each known extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".rb": "ruby", ".c": "c", ".h": "c", ".cpp": "cpp",
    ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp", ".swift": "swift", ".php": "php", ".md": "markdown", ".json": "json", ".yaml": "yaml",
    ".yml": "yaml", ".toml": "toml", ".html": "html", ".css": "css", ".scss": "scss", ".sql": "sql", ".sh": "shell", ".bash": "shell",
}
# Directories that hold other people's or generated files.
VENDORED = ("node_modules", "vendor", "venv", ".venv", "dist", "build", "__pycache__", ".git")
# Debt markers with their patterns and weights.
MARKERS = {
    "todo": (r"\bTODO\b", 1.0), "fixme": (r"\bFIXME\b", 2.0), "hack": (r"\bHACK\b", 1.5), "xxx": (r"\bXXX\b", 1.2), "bug": (r"\bBUG\b", 1.0),
    "deprecated": (r"(?i)\bDEPRECATED\b", 1.8), "noqa": (r"(?i)\bnoqa\b", 0.5),
}
# The first line of a generated file, comment lines, and the thresholds of findings.
GENERATED = r"^(?i:#|//|/\*).*(?i:auto[-_]?generated)"
COMMENTS = (r"(?md)^\s*#.*$", r"(?md)^\s*//.*$")
GOD_LOC, GOD_SHARE, MAX_DEPTH, LONG_FILE, VERY_LONG_FILE = 5000, 0.5, 4, 500, 1500


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def lines_of_code(text: Column) -> Column:
    """Line ends, and one more where the last line has none; an empty text has none."""
    return (newlines(text) + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("bigint")


def estimated_lines(text: Column, big_bytes: int = 2 << 20, sample_bytes: int = 1 << 16) -> Column:
    """lines_of_code(), but for texts over big_bytes an estimate from their first sample_bytes."""
    size = F.octet_length(text)
    first = F.substring(F.encode(text, "UTF-8"), 1, sample_bytes)
    found = F.greatest(sample_bytes - F.length(F.translate(F.decode(first, "ISO-8859-1"), "\n", "")), F.lit(1))
    return F.when(size <= big_bytes, lines_of_code(text)).otherwise(F.floor(size / (F.lit(float(sample_bytes)) / found)))


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; * also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        first = i + 1 + (pattern[i + 1 : i + 2] == "!")
        end = pattern.find("]", first + (pattern[first : first + 1] == "]")) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            members = "".join(c if c.isalnum() or c == "-" else "\\" + c for c in pattern[first:end])
            out, i = f"{out}[{'^' if first > i + 1 else ''}{members}]", end
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches any of the shell patterns; the patterns become one expression."""
    return path.rlike("|".join(f"(?:{glob_to_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def is_vendored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDORED)))


def is_generated(text: Column) -> Column:
    """Whether the first line says the file is generated."""
    return F.substring_index(text, "\n", 1).rlike(GENERATED)


def inventory(files: DataFrame) -> DataFrame:
    """project_id, path, module, depth, language, size_bytes, loc, content. Files without a path are left out; null content counts as empty."""
    content = F.coalesce("content", F.lit(""))
    return files.where("path IS NOT NULL AND path <> ''").select(
        "project_id", "path", top_segment(F.col("path")).alias("module"), depth(F.col("path")).alias("depth"), language_of(F.col("path")).alias("language"),
        F.octet_length(content).cast("bigint").alias("size_bytes"), lines_of_code(content).alias("loc"), content.alias("content"),
    )


# ---- architecture


def module_rollup(inv: DataFrame) -> DataFrame:
    """project_id, module, files, loc, max_depth, languages (sorted, joined by commas), share of the project's lines."""
    modules = inv.groupBy("project_id", "module").agg(
        F.count("*").alias("files"), F.sum("loc").alias("loc"), F.max("depth").alias("max_depth"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages")
    )
    return modules.withColumn("share", rounded(guarded_ratio(F.col("loc"), F.sum("loc").over(Window.partitionBy("project_id"))), 3))


def god_modules(modules: DataFrame) -> DataFrame:
    """Modules that hold too many lines or more than half the project, with their place by size and the severity."""
    order = Window.partitionBy("project_id").orderBy(F.desc("loc"), "module")
    god = modules.where((F.col("loc") > GOD_LOC) | (F.col("share") > GOD_SHARE))
    return god.select("project_id", "module", "loc", "share", F.row_number().over(order).alias("place"), F.when(F.col("share") > 0.6, "high").otherwise("medium").alias("severity"))


def module_imbalance(modules: DataFrame) -> DataFrame:
    """project_id, modules, imbalance: the largest module over all others together; 0 for fewer than three modules."""
    out = modules.groupBy("project_id").agg(F.count("*").alias("modules"), F.max("loc").alias("_top"), F.sum("loc").alias("_all"))
    ratio = guarded_ratio(F.col("_top"), F.col("_all") - F.col("_top"))
    return out.select("project_id", "modules", F.when(F.col("modules") >= 3, rounded(ratio, 4)).otherwise(F.lit(0.0)).alias("imbalance"))


def architecture_score(modules: DataFrame) -> DataFrame:
    """project_id, god, deep, score."""
    god = god_modules(modules).groupBy("project_id").agg(F.count("*").alias("god"), F.max(F.when(F.col("place") == 1, F.col("share"))).alias("_share"))
    base = modules.groupBy("project_id").agg(F.count_if(F.col("max_depth") > MAX_DEPTH).alias("deep")).withColumnRenamed("project_id", "_p")
    both = base.join(god, F.col("_p").eqNullSafe(F.col("project_id")), "left")
    god_pen = F.least(F.lit(35.0), F.coalesce(F.col("god") * 15 + (F.col("_share") - 0.4) * 30, F.lit(0.0)))
    deep_pen = F.least(F.lit(15.0), F.col("deep") * 5.0)
    return both.select(F.col("_p").alias("project_id"), F.coalesce("god", F.lit(0)).alias("god"), "deep", rounded(F.greatest(F.lit(0.0), 100 - god_pen - deep_pen), 1).alias("score"))


def language_rollup(inv: DataFrame) -> DataFrame:
    return inv.groupBy("project_id", "language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("size_bytes").alias("size_bytes"))


# ---- complexity


def size_medians(inv: DataFrame) -> DataFrame:
    """project_id, files, median_loc, max_loc, long_files."""
    return inv.groupBy("project_id").agg(
        F.count("*").alias("files"), F.median("loc").alias("median_loc"), F.max("loc").alias("max_loc"), F.count_if(F.col("loc") > LONG_FILE).alias("long_files")
    )


def long_files(inv: DataFrame, least: int = LONG_FILE, top: int = 10) -> DataFrame:
    """The longest files of each project over least lines, at most top, with place, severity and score."""
    order = Window.partitionBy("project_id").orderBy(F.desc("loc"), "path")
    found = inv.where(F.col("loc") > least).select("project_id", "path", "loc").withColumn("place", F.row_number().over(order))
    return found.where(F.col("place") <= top).withColumns(
        {"severity": F.when(F.col("loc") > VERY_LONG_FILE, "high").otherwise("medium"), "score": rounded(F.least(F.lit(100.0), F.col("loc") / 15), 4)}
    )


def comment_ratio(inv: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """project_id, comment_lines, measured_loc, comment_ratio over the files of these languages; null where none was measured."""
    kept = inv if languages is None else inv.where(F.col("language").isin(languages))
    count = sum((F.regexp_count("content", F.lit(p)) for p in COMMENTS), F.lit(0))
    out = kept.groupBy("project_id").agg(F.sum(count).alias("comment_lines"), F.sum("loc").alias("measured_loc"))
    return out.withColumn("comment_ratio", F.when(F.col("measured_loc") > 0, rounded(F.col("comment_lines") / F.col("measured_loc"), 4)))


def complexity_score(long_count: Column, long_functions: Column, complex_functions: Column, ratio: Column) -> Column:
    """100 less the penalties; what was not measured (null) costs nothing."""
    capped = lambda most, rate, n: F.least(F.lit(most), F.coalesce(n, F.lit(0)) * rate)
    return rounded(
        F.greatest(F.lit(0.0), 100 - capped(30.0, 4.0, long_count) - capped(25.0, 2.0, long_functions) - capped(20.0, 1.5, complex_functions) - F.when(ratio < 0.05, 10.0).otherwise(0.0)), 1
    )


# ---- debt


def marker_counts(texts: DataFrame) -> DataFrame:
    """project_id, path, marker, n, first_line: the markers of each text that is neither vendored nor generated."""
    kept = texts.where(~is_vendored(F.col("path")) & F.col("content").isNotNull()).where(~is_generated(F.col("content")))
    found = [
        F.struct(
            F.lit(name).alias("marker"), F.regexp_count("content", F.lit(p)).cast("bigint").alias("n"),
            (newlines(F.substring(F.col("content"), F.lit(1), F.regexp_instr("content", F.lit(p)))) + 1).cast("bigint").alias("first_line"),
        )
        for name, (p, _) in MARKERS.items()
    ]
    any_marker = F.col("content").rlike("|".join(f"(?:{p})" for p, _ in MARKERS.values()))
    return kept.where(any_marker).select("project_id", "path", F.inline(F.array(*found))).where("n > 0")


def marker_weight() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for name, (_, w) in MARKERS.items() for x in (name, w)]), F.col("marker"))


def debt_density(markers: DataFrame, loc: DataFrame) -> DataFrame:
    """project_id, weighted, fixmes, loc, density, score. loc has project_id and loc; density is per 1,000 lines, below that as if there were 1,000."""
    total = markers.groupBy("project_id").agg(F.sum(F.col("n") * marker_weight()).alias("weighted"), F.sum(F.when(F.col("marker") == "fixme", F.col("n")).otherwise(0)).alias("fixmes"))
    both = loc.withColumnRenamed("project_id", "_p").join(total, F.col("_p").eqNullSafe(F.col("project_id")), "left")
    weighted, fixmes = F.coalesce("weighted", F.lit(0.0)), F.coalesce("fixmes", F.lit(0))
    density = weighted / F.greatest(F.col("loc") / 1000, F.lit(1.0))
    penalty = F.when(density <= 0.5, 0).when(density <= 2, 5).when(density <= 5, 15).otherwise(30) + F.when(fixmes >= 10, 5).otherwise(0)
    return both.select(
        F.col("_p").alias("project_id"), rounded(weighted, 1).alias("weighted"), fixmes.cast("bigint").alias("fixmes"), "loc", rounded(density, 4).alias("density"), (100.0 - penalty).cast("double").alias("score")
    )


def debt_files(markers: DataFrame, least: float = 5, top: int = 3) -> DataFrame:
    """The texts of each project with most weighted debt, at most top."""
    per_file = markers.groupBy("project_id", "path").agg(rounded(F.sum(F.col("n") * marker_weight()), 1).alias("weighted"))
    order = Window.partitionBy("project_id").orderBy(F.desc("weighted"), "path")
    return per_file.where(F.col("weighted") >= least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
