import json
import random
from datetime import datetime

import pytest

from lodewright.functions import strict_json
from lodewright.functions.iso8601 import names_instant
from lodewright.operators import quarantine as q

UID = "46e67b33-264a-4092-b0eb-54e29c54adfb"
GOOD = f"{UID},285,call_7f,store/a.py,delete,0.9,2025-03-03T16:32:50+00:00,false,note"


@pytest.mark.parametrize("text", ["2024-02-29T10:00:00Z", "20240229T100000Z", "2024-02-29T10Z", "2024-02-29T10:00:00,5+01:00", "2024-W09-4T10:00-05", "2024-060T24:00:00Z"])
def test_instants_named(text):
    assert names_instant(text)


@pytest.mark.parametrize(
    "text", ["2023-02-29T10:00:00Z", "2024-02-29T10:00:00", "2024-02-29", "2024-02-29T24:01Z", "2024-02-29T1000Z", "2024-02-29 10:00:00Z", "2024-02-29T10:00:00Z\n", "", "soon", "2024-02-29T10:60Z", "2023-366T10:00Z", "1704721376"]
)
def test_instants_not_named(text):
    assert not names_instant(text)


@pytest.mark.parametrize("text", ["NaN", "[1,]", '{"a":1,}', "{'a':1}", '{"a":01}', '"\t"', '{"a":1}{"b":2}', "", "﻿{}", '{"a" 1}', "[1 2]", "{,}", "]", '{"a":}', "+1", ".5", '"\\x"'])
def test_json_refused(text):
    for parse in (strict_json.loads, strict_json._loads_deep):
        with pytest.raises(ValueError):
            parse(text)


@pytest.mark.parametrize("text", ['{"a":[1,{"b":null}],"c":"\\ud800"}', " [] ", "{}", "-0.5e+3", "1" * 6000, '{"a":1,"a":"x"}', "[[],{}]"])
def test_json_accepted_alike(text):
    assert strict_json.loads(text) == strict_json._loads_deep(text)


def test_deep_json_is_readable():
    assert q.parse_session_log('{"type":"u","sessionId":"s","x":' + "[" * 200_000 + "]" * 200_000 + "}")[0] == "s"


@pytest.mark.parametrize(
    "line", [GOOD, GOOD + "\r\n", GOOD.replace("note", '"a ""b"", c\nd"'), GOOD.replace("2025-03-03T16:32:50+00:00", ""), GOOD.replace(",0.9,", ",1,"), GOOD.replace(",285,", ",007,"), GOOD.replace(",0.9,", ",001.000,")]
)
def test_touch_lines_readable(line):
    assert len(q.parse_touch_export(line)) == 9


@pytest.mark.parametrize(
    "line",
    [GOOD.replace("note", '"open'), GOOD.replace("note", 'a"b'), GOOD.replace("note", '"a"b'), GOOD + ",x", GOOD.replace(",285,", ",0,"), GOOD.replace(",285,", ",-1,"), GOOD.replace("call_7f", ""), GOOD.replace("delete", "Delete"), GOOD.replace(",0.9,", ",1.01,"), GOOD.replace(",0.9,", ",1.00000000000000000001,"), GOOD.replace(",0.9,", ",.9,"), GOOD.replace("false", "False"), GOOD.upper(), GOOD + "\n" + GOOD, GOOD.replace("-03-03T", "-02-30T")],
)
def test_touch_lines_unreadable(line):
    with pytest.raises(q.Unreadable):
        q.parse_touch_export(line)


def test_session_lines():
    base = {"type": "user", "sessionId": "s", "timestamp": "2024-02-29T10:00:00Z", "message": {"content": [{"is_error": True}, {"type": "tool_use"}, 5]}}
    assert q.parse_session_log(json.dumps(base)) == ("s", "user", "2024-02-29T10:00:00Z", 1, 1)
    for change in ({"type": 1}, {"sessionId": ""}, {"timestamp": None}, {"timestamp": "soon"}, {"message": []}, {"message": {}}, {"message": {"content": [{"is_error": 1}]}}):
        with pytest.raises(q.Unreadable):
            q.parse_session_log(json.dumps(base | change))


SCHEMA = "line_id long, feed string, file_name string, line_no int, line string, received_at timestamp, reason string"


def test_unreadable_is_the_remainder(spark):
    at = datetime(2024, 1, 1)
    ok = json.dumps({"type": "user", "sessionId": "s", "message": {"content": [{"is_error": True}]}})
    long = json.dumps({"type": "u", "sessionId": "s", "x": "y" * 300_000})
    rows = [
        (1, "session_log", "s.jsonl", 1, ok, at, "clash"), (2, "session_log", "s.jsonl", 2, ok[:-1], at, None), (3, "session_log", "s.jsonl", 3, " \t", at, None),
        (4, "touch_export", "e.csv", 1, GOOD, at, None), (5, "touch_export", "e.csv", 2, GOOD + ",", at, None), (5, "touch_export", "e.csv", 2, GOOD + ",", at, None),
        (None, "touch_export", None, None, GOOD, None, None), (None, "touch_export", None, None, "x", None, None), (6, None, None, 1, ok, at, None),
        (7, "other", "f", 1, ok, at, None), (8, "session_log", "s.jsonl", 4, None, at, None), (9, "session_log", "s.jsonl", 5, "", at, None), (10, "session_log", "s.jsonl", 6, long, at, None), (11, "session_log", "s.jsonl", 7, "\0\0", at, None),
    ]
    raw = spark.createDataFrame(rows, SCHEMA)
    bad = q.unreadable(raw).collect()
    assert sorted((r.line_id or 0) for r in bad) == [0, 2, 5, 5, 6, 7, 11]
    reasons = {r.line_id: r.reason for r in bad}
    assert reasons[5] == "10 fields instead of 9" and reasons[7] == reasons[6] == "unknown feed" and reasons[2].startswith("not one JSON")
    counts = {r.external_id: (r.unreadable_lines, r.failed_calls) for r in q.session_counts(raw).collect()}
    assert counts["s"] == (2, 1) and counts[UID] == (0, 0) and counts["e.csv"] == (2, 0)
    assert q.unreadable(raw.limit(0)).count() == 0


def test_any_line_leaves_the_others_loaded(spark):
    rng, at = random.Random(11), datetime(2024, 1, 1)
    lone = r'{"type":"\ud800","sessionId":"s\udfff","timestamp":"2024-02-29T10:00:00Z","message":{"content":"\ud83d\ude00"}}'
    lines = [("session_log", lone), ("touch_export", GOOD), ("session_log", '{"type":"' + "\x00" + '"}'), ("session_log", '{"type":"u","sessionId":"s","a":1e999999}')]
    alphabet = ['"', ",", "\n", "\r", "\\", "{", "}", "[", "]", ":", "a", "1", "\\ud800", "\ufeff", "\x00", "é", "😀", " "]
    for i in range(300):
        feed, base = ("session_log", lone) if i % 2 else ("touch_export", GOOD)
        at_ = rng.randrange(len(base))
        cut = base[:at_] + "".join(rng.choices(alphabet, k=rng.randrange(3))) + base[at_ + rng.randrange(3) :]
        lines.append((feed, cut))
    raw = spark.createDataFrame([(i, f, "x", i, line, at) for i, (f, line) in enumerate(lines)], "line_id long, feed string, file_name string, line_no int, line string, received_at timestamp")

    def readable(feed, line):
        try:
            q.FEEDS[feed].parse(line)
            return True
        except q.Unreadable:
            return False

    good = {i for i, (f, line) in enumerate(lines) if readable(f, line)}
    bad = {i for i, (f, line) in enumerate(lines) if line.strip() and i not in good}
    assert 10 < len(good) < 290 and {0, 1, 3} <= good
    loaded = [r for f in q.FEEDS for r in q.strict_load(raw, f).collect()]
    assert {r.line_id for r in loaded} == good
    assert next(r for r in loaded if r.line_id == 0)[4:6] == ("s\\udfff", "\\ud800")
    assert {r.line_id for r in q.unreadable(raw).collect()} == bad == {r.line_id for r in q.unreadable_offsets(raw).collect()}


def test_bytes_that_are_no_utf8(spark):
    raw = spark.sql("SELECT 1L AS line_id, 'session_log' AS feed, 'f' AS file_name, 1 AS line_no, CAST(X'7BFF7D' AS STRING) AS line, current_timestamp() AS received_at")
    assert [r.reason for r in q.unreadable(raw).select("reason").collect()] == ["not UTF-8"]
