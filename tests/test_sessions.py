import json

import pytest
from pyspark.sql import functions as F

from lodewright.operators import sessions as s
from lodewright.operators import store

LINE = "file_name string, line_no int, line string"


def use(i, name="Write", path="/r/a.py"):
    return {"type": "tool_use", "id": i, "name": name, "input": {"file_path": path}}


def result(i, error=None):
    return {"type": "tool_result", "tool_use_id": i, **({} if error is None else {"is_error": error})}


def log(spark, *records, name="s.jsonl"):
    rows = [(name, i + 1, json.dumps({"type": "user", "sessionId": "s", **r})) for i, r in enumerate(records)]
    return s.parse_records(spark.createDataFrame(rows, LINE))


@pytest.mark.parametrize(
    ("parts", "expected"),
    [
        ([[use("1")], [result("1")]], [("ok", 0.9)]),
        ([[use("1")], [result("1", True)]], [("failed", None)]),
        ([[use("1")]], [("open", 0.5)]),
        ([[use("1")], [use("1")], [result("1")]], [("ok", 0.9), ("reused", 0.5)]),
        ([[use("1"), result("0")], [result("1"), use("2")], [result("2", False)]], [("ok", 0.9), ("ok", 0.9)]),
        ([[result("1")], [use("1")]], [("open", 0.5)]),
        ([[use(None)], [result("1")]], [("open", 0.5)]),
        ([[use("1", "Shell")], [result("1")]], []),
        ([[use("1"), result("1")]], [("open", 0.5)]),
    ],
)
def test_tool_calls(spark, parts, expected):
    got = s.tool_touches(log(spark, *[{"message": {"content": p}} for p in parts])).collect()
    assert sorted((r.outcome, r.confidence) for r in got) == sorted(expected, key=lambda x: x[0])


def test_turns_and_counts(spark):
    records = log(
        spark, {"type": "summary", "cwd": ""}, {"message": {"content": "hello"}, "cwd": "/r"}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}, use("1"), {"type": "text", "text": "b"}]}}, {"sessionId": "other", "message": {"content": "x"}}
    )
    turns = {r.seq: (r.line_no, r.role, r.text) for r in s.turns(records).collect()}
    assert turns == {1: (2, "user", "hello"), 2: (3, "assistant", "a\nb")}
    row = s.file_counts(records).first()
    assert (row.session, row.workspace, row.records, row.turns, row.foreign) == ("s", "/r", 4, 2, 1)
    assert s.tool_touches(records).first().touch_kind == "write"


TURN = "session string, seq int, content_hash string"


def test_ingest(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 2, "z")], TURN)
    arriving = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "n"), ("b", 1, "CHANGED"), ("b", 2, "q"), ("c", 1, "w"), ("d", 1, "v")], TURN)
    got = {(r.session, r.seq, r.action) for r in s.ingest(stored, arriving, ["session"]).collect()}
    assert got == {("a", 3, "new"), ("b", 1, "rewritten"), ("b", 2, "rewritten"), ("c", 1, "rewritten"), ("d", 1, "new")}
    assert s.ingest(stored, stored, ["session"]).count() == 0 and s.ingest(stored.limit(0), arriving, ["session"]).count() == 7


def test_store(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (None, "n", "y")], "k long, v string, w string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (None, None)], "k long, v string")
    assert {tuple(r) for r in store.upsert(old, new, ["k"]).collect()} == {(1, "a", None), (2, "c", "x"), (3, "d", None), (None, "n", "y")}
    more = spark.createDataFrame([(2, "z", "z"), (5, "q", "q"), (5, "p", "p"), (None, "z", "z")], old.schema)
    assert {tuple(r) for r in store.insert_new(old, more, ["k"]).collect()} == {(1, "a", None), (2, "b", "x"), (None, "n", "y"), (5, "p", "p")}
    assert {tuple(r) for r in store.replace_scope(old, more, ["k"]).collect()} == {(1, "a", None), (2, "z", "z"), (5, "q", "q"), (5, "p", "p"), (None, "z", "z")}
    assert {r.v for r in store.delete_where(old, F.col("w") == "x").collect()} == {"a", "n"}
    rows, sessions = spark.createDataFrame([(1, None), (2, 7), (3, None)], "session_id long, project_id long"), spark.createDataFrame([(1, 5), (2, 6)], "session_id long, project_id long")
    assert {tuple(r) for r in store.adopt_projects(rows, sessions, ["session_id"]).collect()} == {(1, 5), (2, 7), (3, None)}
    events = spark.createDataFrame([("x", True), ("x", False), (None, True)], "content string, keep boolean")
    assert [r.content for r in store.redacted(events, F.col("keep")).collect()] == ["x", None, None]
    assert store.missing_tables(["a"], ["a", "b"]) == ["b"]
