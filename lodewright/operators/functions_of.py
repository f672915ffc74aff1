"""Functions of Python files with their lengths and cyclomatic complexity, and the top-level imports of their syntax trees."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LONG_LINES, COMPLEX = 60, 10
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension, ast.match_case)


def functions_in(source: str) -> list[tuple[str, int, int, int]]:
    """(name, first line, lines, cyclomatic complexity) of each function; none for a text that does not parse.

    Complexity is one more than the branches: conditions, loops, handlers, asserts, comprehensions, cases and each further
    operand of and/or. Nested functions count for themselves.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out, todo = [], [(tree, "")]
    while todo:
        node, prefix = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                branches, inner = 0, list(child.body)
                while inner:
                    part = inner.pop()
                    if isinstance(part, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                        continue
                    branches += isinstance(part, _BRANCHES) + (len(part.values) - 1 if isinstance(part, ast.BoolOp) else 0)
                    inner += ast.iter_child_nodes(part)
                out.append((prefix + child.name, child.lineno, child.end_lineno - child.lineno + 1, branches + 1))
            todo.append((child, f"{prefix}{child.name}." if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) else prefix))
    return sorted(out, key=lambda f: (f[1], f[0]))


def imports_in(source: str) -> list[str]:
    """What the top-level import statements of a Python text name, relative ones with their dots; none for a text that does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            out += [alias.name for alias in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append("." * node.level + (node.module or ""))
    return list(dict.fromkeys(out))


def python_imports(inv: DataFrame) -> DataFrame:
    """project_id, path, specs, content of the Python files of an inventory: their top-level imports, an empty list where there are none."""

    @F.pandas_udf("array<string>")
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: imports_in(t or ""))

    return inv.where("language = 'python'").select("project_id", "path", walk("content").alias("specs"), "content")


def function_metrics(inv: DataFrame) -> DataFrame:
    """project_id, path, function, line, lines, complexity of the Python files of an inventory; other languages are not measured."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, path, *f) for p, path, text in zip(batch["project_id"], batch["path"], batch["content"]) for f in functions_in(text or "")]
            yield pd.DataFrame(rows, columns=["project_id", "path", "function", "line", "lines", "complexity"])

    files = inv.where("language = 'python'").select("project_id", "path", "content")
    return files.mapInPandas(measure, "project_id long, path string, function string, line int, lines int, complexity int")


def function_summary(metrics: DataFrame) -> DataFrame:
    """project_id, functions, median_lines, median_complexity, max_complexity, long_functions, complex_functions."""
    return metrics.groupBy("project_id").agg(
        F.count("*").alias("functions"), F.median("lines").alias("median_lines"), F.median("complexity").alias("median_complexity"), F.max("complexity").alias("max_complexity"),
        F.count_if(F.col("lines") > LONG_LINES).alias("long_functions"), F.count_if(F.col("complexity") > COMPLEX).alias("complex_functions"),
    )


def worst_functions(metrics: DataFrame, top: int = 10) -> DataFrame:
    """The most complex functions of each project, at most top, with place and score."""
    order = Window.partitionBy("project_id").orderBy(F.desc("complexity"), "path", "line")
    found = metrics.where(F.col("complexity") > COMPLEX).withColumn("place", F.row_number().over(order))
    return found.where(F.col("place") <= top).withColumn("score", F.least(F.lit(100.0), F.col("complexity") * 4.0))
