from datetime import datetime

from pyspark.sql import functions as F

from lodewright.functions import validate as v
from lodewright.operators import consequences as q
from lodewright.operators import sessions as s
from lodewright.operators.pipeline import scan

T0 = datetime(2026, 1, 1)


def test_golden_repository(spark):
    """Two commits of one author over two small files at the top."""
    app = "import os\n\n\ndef main(a):\n    if a:\n        return 1\n    return 2\n\n\ndef other():\n    return 3\n# end\n"
    util = "def f():\n    return 1\n"
    files = spark.createDataFrame([(1, "app.py", app), (1, "util.py", util)], "project_id long, path string, content string")
    commits = spark.createDataFrame([(1, 1, "A", "a@x", T0), (2, 1, "A", "a@x", T0.replace(day=2))], "commit_id long, project_id long, author_name string, author_email string, authored_at timestamp")
    changed = spark.createDataFrame([(1, 1, "app.py", 8, 0), (1, 1, "util.py", 2, 0), (2, 1, "app.py", 4, 0)], "commit_id long, project_id long, path string, added int, removed int")
    out = scan(files, commits, changed)
    assert {r.analyzer: r.score for r in out["scores"].collect()} == {"git_history": 65.0, "architecture": 67.0, "dependencies": 100.0, "complexity": 100.0, "tech_debt": 100.0, "coupling": 100.0}
    overall = out["overall"].first()
    assert (overall.overall, overall.band, overall.measured) == (87.8, "excellent", 6)
    assert [(r.category, r.severity, r.path) for r in out["findings"].collect()] == [("god_module", "high", "(root)/")]
    assert sorted((r.path, r.loc) for r in out["inventory"].collect()) == [("app.py", 12), ("util.py", 2)]


def test_validators(spark):
    def ask(value, column):
        return spark.createDataFrame([(value,)], "t string").select(column).first()[0]

    t = F.col("t")
    assert [ask(x, v.is_uuid(t)) for x in ("8B1f3c1e-0000-4000-8000-000000000000", "x", "", None)] == [True, False, False, False]
    assert [ask(x, v.is_branch(t)) for x in ("main", "release/1.2", "-x", "a..b", "a b", "x.lock", "a/", "", None)] == [True, True] + [False] * 7
    assert [ask(x, v.is_slug(t)) for x in ("a-b.c", "-a", "a/b", None)] == [True, False, False, False]
    assert [ask(x, v.is_inside(t, "/r", "/s/")) for x in ("/r", "/r/a", "/rx", "/s/b", "/r/\0", "/r/" + "a" * 5000, None)] == [True, True, False, True, False, False, False]


def test_counts_in_windows(spark):
    day = lambda n: datetime(2024, 1, n)
    windows = spark.createDataFrame([(1, 1, day(2), day(5)), (1, 2, day(1), day(1)), (1, 3, day(9), day(8)), (2, 4, day(1), day(9)), (None, 5, day(1), day(9))], "project_id long, window_id long, starts_at timestamp, ends_at timestamp")
    events = spark.createDataFrame([(1, i, day(i)) for i in range(1, 8)] + [(1, 90, day(5)), (None, 91, day(5)), (1, 92, None)], "project_id long, event_id long, at timestamp")
    assert {r.window_id: r.n for r in q.counted_in(windows, events).collect()} == {1: 5, 2: 1, 3: 0, 4: 0, 5: 0}


def test_logs_of_workspace_and_touch_turns(spark):
    records = spark.createDataFrame([("a", 1, ""), ("a", 2, "/r/x"), ("b", 1, "/rx"), ("b", 2, "/r"), ("c", 1, None)], "file_name string, line_no int, cwd string")
    assert {r.file_name for r in s.logs_of_workspace(records, "/r/").collect()} == {"a"}
    touches = spark.createDataFrame([("s", 1), ("s", 2)], "session string, seq int")
    turns = spark.createDataFrame([("s", 1, 7), ("s", 1, 9), ("t", 2, 8)], "session string, seq int, event_id long")
    assert {r.seq: r.event_id for r in s.touch_turns(touches, turns, ["session"], "event_id").collect()} == {1: 7, 2: None}
