"""Source trees, decision records and session logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.operators.structure import LANGUAGES

# Directories that hold no source of the project.
EXCLUDED = (
    ".git", ".hg", ".svn", "node_modules", "vendor", "venv", ".venv", "__pycache__", "dist", "build", "target", ".next", ".nuxt", ".cache", ".idea", ".vscode",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", "coverage", ".coverage", ".gradle", "_next", "out", ".output", ".svelte-kit", ".turbo", ".parcel-cache",
    "site-packages", ".tox", ".nox", ".eggs", "htmlcov",
)
MAX_BYTES = 2 << 20
MAX_LINE = 8 << 20


def _relative(path: Column, root: str) -> Column:
    """A file's path below root. Spark gives paths as URIs, percent-encoded."""
    plain = F.url_decode(F.replace(F.regexp_replace(path, r"^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    return F.when(plain.startswith(root.rstrip("/") + "/"), F.substring(plain, F.lit(len(root.rstrip("/")) + 2), F.length(plain)))


def read_tree(spark: SparkSession, root: str, project_id: int, excluded: tuple[str, ...] = EXCLUDED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """project_id, path, size_bytes, content of the source files below a local or shared directory.

    Files of unknown kind and those below excluded directories are left out; the content of files over max_bytes is
    null, and bytes that are no UTF-8 are replaced.
    """
    endings = ",".join(e[1:] for e in LANGUAGES)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{endings}}}").load(root)
    rows = raw.select(F.lit(project_id).cast("long").alias("project_id"), _relative(F.col("path"), root).alias("path"), F.col("length").alias("size_bytes"), "content")
    kept = rows.where(~F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), F.array(*map(F.lit, excluded))))
    return kept.withColumn("content", F.when(F.col("size_bytes") <= max_bytes, F.make_valid_utf8(F.col("content").cast("string"))))


def read_records(spark: SparkSession, directory: str, project_id: int) -> DataFrame:
    """project_id, path, text of the Markdown files of a directory of decision records."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(directory, wholetext=True)
    return raw.select(F.lit(project_id).cast("long").alias("project_id"), F.element_at(F.split(F.url_decode("_metadata.file_path"), "/"), -1).alias("path"), F.col("value").alias("text"))


def read_session_logs(spark: SparkSession, directory: str, max_line: int = MAX_LINE) -> DataFrame:
    """line_id, feed, file_name, line_no, line, received_at of the JSON Lines logs below a directory, as quarantine reads them.

    A line over max_line characters keeps its place but not its text, and so is unreadable.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(directory, wholetext=True)
    lines = raw.select(F.element_at(F.split(F.url_decode("_metadata.file_path"), "/"), -1).alias("file_name"), F.col("_metadata.file_modification_time").alias("received_at"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    kept = lines.withColumns({"line_no": F.col("line_no") + 1, "line": F.when(F.length("line") <= max_line, F.col("line")).otherwise(F.lit("\x00"))})
    return kept.select(F.xxhash64("file_name", "line_no").alias("line_id"), F.lit("session_log").alias("feed"), "file_name", "line_no", "line", "received_at")
