import random
from datetime import datetime, timedelta

import pytest

from lodewright.operators import consequences as q
from lodewright.operators import evidence as e
from lodewright.operators.asof import asof_join, numbered

T0 = datetime(2024, 1, 1)
D = timedelta(days=1)


def test_asof_against_brute_force(spark):
    rng = random.Random(6)
    time = lambda: T0 + D * rng.randrange(120)
    left = [(i, "hot" if rng.random() < 0.5 else rng.choice("ab"), time()) for i in range(200)] + [(900, None, T0), (901, "a", None), (902, "none", T0)]
    right = [(i, "hot" if rng.random() < 0.5 else rng.choice("ab"), time()) for i in range(150)] + [(900, None, T0), (901, "a", None)]
    left.append(left[0])
    ldf, rdf = spark.createDataFrame(left, "id long, k string, t timestamp"), spark.createDataFrame(right, "v long, k string, s timestamp")
    for direction in ("backward", "forward"):
        for inclusive in (True, False):
            got = asof_join(ldf, rdf, by=["k"], left_time="t", right_time="s", take=["v"], direction=direction, inclusive=inclusive, bucket_us=9 * 86_400_000_000).collect()
            assert len(got) == len(left)
            for r in got:
                ok = [(s, v) for v, k, s in right if k is not None and k == r.k and s is not None and r.t is not None and ((s < r.t or (inclusive and s == r.t)) if direction == "backward" else (s > r.t or (inclusive and s == r.t)))]
                best = None
                if ok:
                    at = max(s for s, _ in ok) if direction == "backward" else min(s for s, _ in ok)
                    best = min(v for s, v in ok if s == at)
                assert r.matched_v == best, (direction, inclusive, r)
    assert asof_join(ldf, rdf.limit(0), by=["k"], left_time="t", right_time="s", take=["v"]).where("matched_v IS NOT NULL").count() == 0


def test_numbered(spark):
    rows = [(i, "a" if i % 3 else "b", T0 + D * (i * 7 % 11)) for i in range(60)]
    got = {(r.k, r.id): r["_rank"] for r in numbered(spark.createDataFrame(rows, "id long, k string, t timestamp"), "k", "t", "id").collect()}
    for k in "ab":
        order = sorted((t, i) for i, x, t in rows if x == k)
        assert [got[k, i] for _, i in order] == list(range(1, len(order) + 1))


TOUCH = "touch_id long, session_id long, project_id long, file_path string, touch_kind string, confidence double, occurred_at timestamp, commit_sha string"


def test_forward_links(spark):
    t = lambda i, path, day, kind="write", sha=None, p=1: (i, 1, p, path, kind, 0.9, None if day is None else T0 + D * day, sha)
    touches = spark.createDataFrame([t(1, "f", 2), t(2, "f", 3), t(3, "f", 9), t(4, "g", 2), t(5, "f", 2, "read"), t(6, "f", 2, sha="x"), t(7, "f", None), t(8, "f", 2, p=2), t(9, "f", 4), t(9, "f", 4)], TOUCH)
    history = spark.createDataFrame([(1, "f", 10, T0), (1, "f", 11, T0 + 3 * D), (1, "f", 12, T0 + 8 * D), (1, "f", 13, T0 + 8 * D)], "project_id long, path string, commit_id long, authored_at timestamp")
    linked = e.link_forward(touches, history)
    assert {r.touch_id: r.linked_commit_id for r in linked.collect()} == {1: 11, 2: 11, 3: None, 4: None, 8: None, 9: 12}
    assert {r.project_id: (r.changes, r.uncommitted) for r in e.uncommitted(linked).collect()} == {1: (5, 2), 2: (1, 1)}


def test_evidence_and_risk(spark):
    rows = [(i, i, 1, "w", "write", 0.9, T0 + D * i, None) for i in range(10)] + [(20, 1, 1, "r", "read", 0.9, T0, None), (21, 1, 1, "d", "delete", 0.8, T0, None), (22, 2, 1, "m", "write", 0.3, None, None)]
    ev = e.file_evidence(spark.createDataFrame(rows, TOUCH))
    got = {r.file_path: (r.writes, r.reads, r.deletes, r.sessions, r.strength, r.last_write) for r in ev.collect()}
    assert got == {"w": (10, 0, 0, 10, 0.9, T0 + 9 * D), "r": (0, 1, 0, 0, 0.0, None), "d": (0, 0, 1, 1, 0.8, T0), "m": (1, 0, 0, 1, 0.3, None)}
    risks = spark.createDataFrame([(1, "w", 70.0), (1, "m", 95.0), (1, "none", 99.0), (1, "d", 50.0)], "project_id long, file_path string, base_risk double")
    out = sorted(e.weighted_risk(risks, ev).collect(), key=lambda r: (-r.weighted_risk, -r.base_risk))
    assert [(r.file_path, r.weighted_risk) for r in out] == [("w", 63.0), ("d", 40.0), ("m", 28.5), ("none", 0.0)]
    with pytest.raises(Exception, match="negative"):
        e.weighted_risk(spark.createDataFrame([(1, "w", -1.0)], risks.schema), ev).collect()


def test_line_shares(spark):
    touches = spark.createDataFrame([(1, 1, 1, "a", "write", 0.9, T0, "s1"), (2, 1, 1, "a", "write", 0.5, T0, "s1"), (3, 1, 1, "a", "read", 0.9, T0, "s2"), (4, 1, 2, "a", "write", 0.9, T0, "s3")], TOUCH)
    lines = spark.createDataFrame([(1, "a", "s1", 30), (1, "a", "s2", 50), (1, "a", "s3", 20), (1, "b", "s2", 5)], "project_id long, path string, sha string, n_lines long")
    got = {r.path: (r.total, r.ai, r.human, r.unattributed, r.confidence) for r in e.line_shares(lines, e.commit_confidence(touches)).collect()}
    assert got == {"a": (100, 30.0, 0.0, 70.0, 0.9), "b": (5, 0.0, 0.0, 100.0, 0.0)}


ANCHOR, SAMPLE = "anchor_id long, project_id long, starts_at timestamp, summary string", "project_id long, metric string, value double, measured_at timestamp"


def measured(spark, anchors, samples):
    rows = q.consequences(spark.createDataFrame(anchors, ANCHOR), spark.createDataFrame(samples, SAMPLE)).collect()
    return {(r.anchor_id, r.metric): (r.baseline, r.observed, r.delta, r.claim, r.confounders, r.confidence) for r in rows}


def test_consequences(spark):
    s = lambda day, v, m="m", p=1: (p, m, v, T0 + D * day)
    assert measured(spark, [(1, 1, T0 + 10 * D, "x")], [s(1, 60.0), s(20, 75.0)]) == {(1, "m"): (60.0, 75.0, 15.0, "correlation", 0, 0.6)}
    assert measured(spark, [(1, 1, T0 + 10 * D, "x")], [s(1, 60.0), s(20, 60.4)])[1, "m"][2:] == (0.4, "none", 0, 0.0)
    assert measured(spark, [(1, 1, T0 + 10 * D, "x")], [s(10, 60.0), s(20, 70.0), s(40, 75.0), s(41, 9.0)])[1, "m"][:2] == (60.0, 75.0)
    for samples in ([s(20, 75.0)], [s(1, 60.0)], [s(1, 60.0), s(41, 75.0)], [s(1, 60.0, p=2), s(20, 75.0, p=2)], [s(1, float("inf")), s(20, 75.0)]):
        assert measured(spark, [(1, 1, T0 + 10 * D, "x"), (2, 1, None, "undated")], samples) == {}
    three = measured(spark, [(1, 1, T0 + 10 * D, "x"), (2, 1, T0 + 12 * D, "y"), (3, 1, T0 + 40 * D, "z"), (4, 1, T0 + 9 * D, "before"), (5, 2, T0 + 12 * D, "other")], [s(1, 60.0), s(20, 75.0)])
    assert three[1, "m"][4:] == (2, 0.2)


def test_many_confounders_are_sampled(spark):
    rows = [(i, 1, T0 + D * (0 if i < 3 else i % 30), f"s{i}") for i in range(71)]
    got = {r.anchor_id: r for r in q.confounders(spark.createDataFrame(rows, ANCHOR)).collect()}
    for i, _, at, _ in rows:
        others = sorted((t, j) for j, _, t, _ in rows if j != i and at <= t <= at + 30 * D)
        assert got[i].confounders == len(others)
        listed = [f"s{j}" for _, j in others[:50]]
        assert got[i].sample == listed + ([f"... and {len(others) - 50} more decision(s) in this window"] if len(others) > 50 else [])


def test_sessions_that_changed_the_same_file_confound(spark):
    rng = random.Random(4)
    anchors = [(i, 1, T0 + timedelta(hours=rng.randrange(24 * 90)), f"a{i}", rng.choice(["f", "g", None])) for i in range(60)]
    touches = [(i, 1, rng.choice("fg"), f"s{rng.randrange(9)}", rng.choice(["write", "create", "delete", "read"]), T0 + timedelta(hours=rng.randrange(24 * 120))) for i in range(150)]
    touches += [(900, 1, "f", "s1", "write", None), (901, 2, "f", "other", "write", T0), (902, 1, "f", None, "write", T0)]
    # at the very start and the very end of a window
    touches += [(903, 1, "f", "edge", "write", next(a[2] for a in anchors if a[4] == "f")), (904, 1, "f", "far", "write", next(a[2] for a in anchors if a[4] == "f") + 30 * D)]
    a = spark.createDataFrame(anchors, ANCHOR + ", file_path string")
    t = spark.createDataFrame(touches, "touch_id long, project_id long, file_path string, session_id string, touch_kind string, occurred_at timestamp")
    got = {r.anchor_id: r for r in q.confounders(a, touches=t).collect()}
    counted = {r.anchor_id: r.sessions for r in q.same_file_sessions(a, t).collect()}
    for i, _, at, _, file in anchors:
        near = {s for _, p, f, s, k, when in touches if p == 1 and f == file and s and k != "read" and when and at <= when <= at + 30 * D}
        others = [x for x in anchors if x[0] != i and at <= x[2] <= at + 30 * D]
        assert counted.get(i, 0) == len(near) and got[i].confounders == len(near) + len(others)
        assert {x for x in got[i].sample if "session" in x} == {f"the file was also modified in agent session '{s}' during the window" for s in near} or len(others) + len(near) > 50
    samples = spark.createDataFrame([(1, "m", 40.0, T0 - D), (1, "m", 55.0, T0 + 20 * D)], SAMPLE)
    one = spark.createDataFrame([(1, 1, T0 + 5 * D, "x", "h")], ANCHOR + ", file_path string")
    other = spark.createDataFrame([(1, 1, "h", "other-sess", "write", T0 + 15 * D)], t.schema)
    assert q.consequences(one, samples, touches=other).first().confidence == 0.3 and q.consequences(one, samples).first().confidence == 0.6


def test_of_commits_at_the_same_time_the_one_committed_first_counts(spark):
    touches = spark.createDataFrame([(1, 1, "f", "write", T0, None)], "touch_id long, project_id long, file_path string, touch_kind string, occurred_at timestamp, commit_sha string")
    history = spark.createDataFrame([(1, "f", 5, T0 + D, T0 + 3 * D), (1, "f", 9, T0 + D, T0 + 2 * D)], "project_id long, path string, commit_id long, authored_at timestamp, committed_at timestamp")
    assert e.link_forward(touches, history).first().linked_commit_id == 9
    assert e.link_forward(touches, history.drop("committed_at")).first().linked_commit_id == 5


def test_touched_files_are_found_under_any_spelling(spark, tmp_path):
    from lodewright.plans import serving

    spark.createDataFrame([(1, "/ws/p")], "project_id long, path string").write.parquet(f"{tmp_path}/projects.parquet")
    spark.createDataFrame([(1, f) for f in ("a/x.py", "a/y.py", "a/z.py", "a/r.py", "b.py")], "project_id long, path string").write.parquet(f"{tmp_path}/commit_files.parquet")
    paths = [(1, r"a\x.py", "write"), (1, "/ws/p/a/y.py", "create"), (1, "./b/../a/z.py", "write"), (1, "a//r.py", "read")]
    spark.createDataFrame(paths, "project_id long, file_path string, touch_kind string").write.parquet(f"{tmp_path}/session_file_touches.parquet")
    assert {r.path for r in serving.semi_touched_files(spark, str(tmp_path)).collect()} == {"a/x.py", "a/y.py", "a/z.py"}
    assert {r.path for r in serving.anti_untouched_files(spark, str(tmp_path)).collect()} == {"b.py"}
