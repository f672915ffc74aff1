from datetime import datetime

from pyspark.sql import functions as F

from lodewright.operators import findings as f
from lodewright.operators import functions_of as fn
from lodewright.operators import graph as g
from lodewright.operators import report as r
from lodewright.operators import sessions as s
from lodewright.operators.pipeline import scan
from lodewright.operators.structure import inventory

T0 = datetime(2026, 1, 1)


def test_a_scan_reports_every_kind(spark):
    long = "def f(x):\n" + "".join(f"    if x == {i}:\n        x += 1\n" for i in range(120)) + "    return x\n"
    files = [(1, "core/long.py", long + "\n" * 300), (1, "a/b/c/d/e/deep.py", "import cyc.one\n# TODO one\n# FIXME two TODO\n"), (1, "cyc/one.py", "import cyc.two\n"), (1, "cyc/two.py", "from cyc import one\nimport cyc.one\n"), (1, "cyc/x_test.py", "# TODO x\n" + "# HACK\n" * 4)]
    files += [(1, f"user/u{i}.py", "import cyc.one\n") for i in range(12)]
    commits = [(i, 1, "A", "a@x", T0.replace(day=1 + i)) for i in range(6)]
    changed = [(i, 1, "core/long.py", 40, 0) for i in range(6)]
    out = scan(
        spark.createDataFrame(files, "project_id long, path string, content string"),
        spark.createDataFrame(commits, "commit_id long, project_id long, author_name string, author_email string, authored_at timestamp"),
        spark.createDataFrame(changed, "commit_id long, project_id long, path string, added int, removed int"),
    )
    found = out["findings"].collect()
    titles = {x.category: x.title for x in found}
    assert set(titles) == {
        "hotspot", "knowledge_island", "god_module", "deep_nesting", "import_cycle", "god_module_imports", "long_file", "long_function", "high_complexity", "debt_todo", "debt_fixme", "debt_hack", "debt_hotspot", "stable_concrete"
    }
    assert titles["import_cycle"] == "Import cycle: cyc/one → cyc/two" and titles["deep_nesting"] == "Deep nesting: a/ (depth 5)"
    assert titles["long_function"] == "Long function: f() in core/long.py (242 lines)" and titles["high_complexity"] == "Complex function: f() in core/long.py (CC 121)"
    assert titles["long_file"] == "Long file: core/long.py (542 LOC)" and titles["god_module_imports"] == "Heavy import target: cyc/one"
    marks = {x.title: (x.severity, x.score) for x in found if x.category.startswith("debt_") and x.category != "debt_hotspot"}
    assert marks["FIXME at a/b/c/d/e/deep.py:3"] == ("medium", 20.0) and marks["TODO at a/b/c/d/e/deep.py:3"] == ("low", 10.0) and marks["HACK at cyc/x_test.py:5"] == ("info", 15.0)
    assert out["stats"].first()[1:] == (17, sum(len(c.splitlines()) for _, _, c in files), 6)


def test_large_cycles_are_cut_in_the_title(spark):
    members = spark.createDataFrame([(1, "m00", f"m{i:02d}") for i in range(30)], "project_id long, component string, module string")
    row = f.import_cycle(members).first()
    assert row.title.startswith("Import cycle: m00 → m01") and row.title.endswith("m24 → ... and 5 more") and (row.severity, row.score) == ("medium", 40.0)
    assert f.import_cycle(members.limit(0)).count() == 0


def test_imports_of_syntax_trees(spark):
    assert fn.imports_in("import a.b, c\nfrom ..d import e\nfrom . import f\nif x:\n    import g\n'''\nimport h\n'''\n") == ["a.b", "c", "..d", "."]
    assert fn.imports_in("import (") == [] and fn.imports_in("") == []
    files = [(1, "p/a.py", "'''\nimport p.b\n'''\nimport p.c\n"), (1, "p/b.py", "def f():\n    import p.c\n"), (1, "p/c.py", "import p.a\nprint 'old'\n"), (1, "p/d.ts", "import x from './e'\n"), (1, "p/e.ts", None)]
    inv = inventory(spark.createDataFrame(files, "project_id long, path string, content string"))
    # b has no import at the top and c does not parse, so the pattern reads them
    assert {(x.src, x.dst) for x in g.import_edges(inv).collect()} == {("p/a", "p/c"), ("p/b", "p/c"), ("p/c", "p/a"), ("p/d", "p/e")}


def test_calls_of_turns_in_the_workspace(spark):
    line = lambda n, kind, parts, cwd="/r": (n, "s.jsonl", f'{{"type":"{kind}","sessionId":"s","cwd":"{cwd}","message":{{"content":[{parts}]}}}}')
    call = lambda i, path: f'{{"type":"tool_use","id":"{i}","name":"Write","input":{{"file_path":"{path}"}}}}'
    lines = [line(1, "assistant", call("a", "/r/x/../y.py")), line(2, "assistant", call("b", "/elsewhere/z.py")), line(3, "system", call("c", "/r/z.py")), line(4, "assistant", call("d", "w.py")), line(5, "user", '{"type":"tool_result","tool_use_id":"d","is_error":true}')]
    records = s.parse_records(spark.createDataFrame(lines, "line_no int, file_name string, line string"))
    assert {(x.call_id, x.outcome) for x in s.tool_touches(records).collect()} == {("a", "open"), ("b", "open"), ("d", "failed")}
    assert [(x.call_id, x.file_path) for x in s.touches_within(s.tool_touches(records), records).collect()] == [("a", "y.py")]
    # the same text with another call is another turn
    two = spark.createDataFrame([line(1, "assistant", call("a", "/r/x.py")), (1, "t.jsonl", line(1, "assistant", call("a", "/r/y.py"))[2])], "line_no int, file_name string, line string")
    assert len({x.content_hash for x in s.turns(s.parse_records(two)).collect()}) == 2


def test_reports_and_runs(spark):
    runs = spark.createDataFrame([("a", "completed", T0, T0.replace(second=2), 84.96), ("b", "failed", T0, None, None)], "analyzer string, status string, started_at timestamp, finished_at timestamp, score double")
    got = {x.analyzer: (x.duration_ms, x.score, x.band, x.is_measured, x.passed) for x in r.run_records(runs).collect()}
    assert got == {"a": (2000, 85.0, "excellent", True, True), "b": (None, None, None, False, False)}
    a, b = (spark.createDataFrame(x, "k string") for x in ([("x",), ("y",), ("y",)], [("y",), ("z",), ("w",)]))
    assert tuple(r.detection(a, b, ["k"]).first()) == (2, 3, 1, 0.5, 0.6667)
    assert r.detection(a.limit(0), b.limit(0), ["k"]).first().recall is None
    told = spark.createDataFrame([(1, "f", 9.0, 1.0, [("risk",), ("sessions",)]), (1, "g", 9.0, 2.0, [("sessions",)]), (1, "h", 99.0, 9.0, [("risk",)])], "project_id long, file_path string, base_risk double, weighted_risk double, factors array<struct<name:string>>")
    assert [(x.file_path, x.place) for x in r.with_evidence(told).orderBy("place").collect()] == [("g", 1), ("f", 2)]
    old, new = (spark.createDataFrame(x, "project_id long, files long, loc long, commits long") for x in ([(1, 2, 20, 3)], [(1, 7, 520, 3), (2, 1, 1, 1)]))
    assert sorted(map(tuple, r.stats_diff(old, new).collect())) == [(1, 5, 500, 0), (2, 1, 1, 1)]
    results = r.sarif_results(
        spark.createDataFrame([(1, "git_history", "hotspot", 'x "q"', "high", "p", 3.0)], "project_id long, analyzer string, category string, title string, severity string, path string, score double"),
        spark.createDataFrame([], "project_id long, path string, ai double"),
    )
    import json

    log = json.loads(r.sarif_runs(results).first().sarif)
    assert log["version"] == "2.1.0" and log["runs"][0]["results"][0]["message"]["text"] == 'x "q"'
    report = json.loads(r.json_report(spark.createDataFrame([(1, 50.0, "fair")], "project_id long, overall double, band string"), spark.createDataFrame([(1, "a", None)], "project_id long, analyzer string, score double"), r.top_findings(results.select("project_id", F.lit("a").alias("analyzer"), F.lit("c").alias("category"), "title", F.lit("low").alias("severity"), "path", F.lit(1.0).alias("score")))).first().report)
    assert report["scores"] == [{"analyzer": "a"}] and report["findings"][0]["place"] == 1
