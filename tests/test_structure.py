import fnmatch

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodewright.functions.scores import band, clamp, python_rounded, rounded
from lodewright.operators import structure as s
from lodewright.operators.functions_of import function_metrics, function_summary, functions_in, worst_functions


def files(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "project_id long, path string, content string, loc int")


def test_inventory(spark):
    inv = s.inventory(files(spark, [(1, "src/a.py", "x\ny"), (1, "README.md", "x\n"), (1, "b/c/D.TSX", ""), (None, "x/y.z", None), (1, None, "x"), (1, ".env", "a")]))
    got = {r.path: (r.module, r.depth, r.language, r.size_bytes, r.loc) for r in inv.collect()}
    assert got == {"src/a.py": ("src", 1, "python", 3, 2), "README.md": ("(root)", 0, "markdown", 2, 1), "b/c/D.TSX": ("b", 2, "typescript", 0, 0), "x/y.z": ("x", 1, "unknown", 0, 0), ".env": ("(root)", 0, "unknown", 1, 1)}


def test_god_module_and_score(spark):
    inv = s.inventory(files(spark, [(1, f"core/f{i}.py", "x\n" * 1200) for i in range(5)] + [(1, "a/b.py", "x\n" * 10), (1, "c/b.py", "x\n" * 10)] + [(2, f"m{i}/a.py", "x\n" * 100) for i in range(3)] + [(3, "a/b/c/d/e/f.py", "x")]))
    modules = s.module_rollup(inv)
    assert [(r.project_id, r.module, r.severity) for r in s.god_modules(modules).orderBy("project_id").collect()] == [(1, "core", "high"), (3, "a", "high")]
    scores = {r.project_id: (r.god, r.deep, r.score) for r in s.architecture_score(modules).collect()}
    assert scores == {1: (1, 0, 67.1), 2: (0, 0, 100.0), 3: (1, 1, 62.0)}
    assert {r.project_id: r.imbalance for r in s.module_imbalance(modules).collect()} == {1: 300.0, 2: 0.5, 3: 0.0}


def test_estimated_lines(spark):
    text = "abcdefg\n" * 1000
    row = files(spark, [(1, "a", text), (1, "b", "x\n" * 5)]).select(s.estimated_lines(F.col("content"), 100, 64)).collect()
    assert [r[0] for r in row] == [1000, 5]


def test_comments_and_complexity(spark):
    inv = s.inventory(files(spark, [(1, "a.py", "# x\n\n  # y\nz = 1 # no\n// q\n"), (2, "b.md", "# title\n"), (3, "c.py", "x = 1\n" * 100)]))
    got = {r.project_id: r.comment_ratio for r in s.comment_ratio(inv, ["python"]).collect()}
    assert got == {1: 0.6, 3: 0.0}
    score = spark.range(1).select(s.complexity_score(F.lit(3), F.lit(None).cast("int"), F.lit(2), F.lit(None).cast("double")), s.complexity_score(F.lit(99), F.lit(99), F.lit(99), F.lit(0.01)))
    assert tuple(score.first()) == (85.0, 15.0)


def test_markers(spark):
    rows = [(1, "a", "x\nTODO FIXME\nTODO TODOS\ndeprecated"), (1, "vendor/a", "TODO"), (1, "g", "# auto-generated\nTODO"), (1, "h", "x\n# auto-generated\nHACK NOQA"), (1, "n", None), (2, "b", "FIXME " * 10)]
    markers = s.marker_counts(files(spark, rows))
    got = {(r.path, r.marker): (r.n, r.first_line) for r in markers.collect()}
    assert got == {("a", "todo"): (2, 2), ("a", "fixme"): (1, 2), ("a", "deprecated"): (1, 4), ("h", "hack"): (1, 3), ("h", "noqa"): (1, 3), ("b", "fixme"): (10, 1)}
    loc = spark.createDataFrame([(1, 2000), (2, 10), (3, 5)], "project_id long, loc long")
    scores = {r.project_id: (r.weighted, r.density, r.score) for r in s.debt_density(markers, loc).collect()}
    assert scores == {1: (7.8, 3.9, 85.0), 2: (20.0, 20.0, 65.0), 3: (0.0, 0.0, 100.0)}
    assert [(r.path, r.place) for r in s.debt_files(markers).orderBy("project_id").collect()] == [("a", 1), ("b", 1)]


@settings(max_examples=200, deadline=None)
@given(st.text("ab./*?[]!x^&", max_size=8), st.text("ab./x-", max_size=8))
def test_globs_like_fnmatch(pattern, name):
    import re

    assert bool(re.search(s.glob_to_regex(pattern).replace(r"\z", r"\Z"), name)) == fnmatch.fnmatchcase(name, pattern)


def test_numbers(spark):
    row = spark.range(1).select(rounded(F.lit(0.25), 1), python_rounded(F.lit(0.25), 1), python_rounded(F.lit(0.35), 1), clamp(F.lit(None).cast("double"), 0, 1), clamp(F.lit(7.0), 0, 1), band(F.lit(85.0)), band(F.lit(29.9)), band(F.lit(None).cast("double"))).first()
    assert tuple(row) == (0.3, 0.2, 0.3, None, 1.0, "excellent", "critical", None)


SOURCE = '''
import os
class A:
    def m(self, x):
        return [i for i in x if i] if x and self or 1 else None
def f(a):
    for i in a:
        if i: pass
        elif a: pass
    def g():
        while True: pass
    try: pass
    except ValueError: pass
'''


def test_functions(spark):
    assert functions_in(SOURCE) == [("A.m", 4, 2, 5), ("f", 6, 8, 5), ("f.g", 10, 2, 2)]
    assert functions_in("def (") == [] and functions_in("\0") == []
    inv = s.inventory(files(spark, [(1, "a.py", SOURCE), (1, "b.js", "function x() {}"), (1, "c.py", None)]))
    metrics = function_metrics(inv)
    assert tuple(function_summary(metrics).first()) == (1, 3, 2.0, 5.0, 5, 0, 0)
    assert worst_functions(metrics).count() == 0


def test_only_very_large_texts_are_estimated(spark, tmp_path):
    from lodewright.plans import structure

    uneven = "x" * 5000 + "\n" * 20_000  # no prefix tells its lines
    large = "abcdefg\n" * 300_000
    spark.createDataFrame([(1, "a", uneven), (1, "b", large)], "project_id long, doc_path string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: r.loc for r in structure.loc_estimated(spark, str(tmp_path)).collect()}
    exact = files(spark, [(1, "a", uneven)]).select(s.lines_of_code(F.col("content"))).first()[0]
    assert got == {"a": exact, "b": 300_000}
