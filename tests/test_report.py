import json

from pyspark.sql import functions as F

from lodewright.functions.scores import signed_general
from lodewright.operators import report as r

SCORE, FINDING = "project_id long, analyzer string, score double", "project_id long, analyzer string, category string, title string, severity string, path string, score double"


def test_composite(spark):
    rows = [(1, "git_history", 65.0), (1, "architecture", 67.0), (1, "dependencies", 100.0), (1, "complexity", 100.0), (1, "tech_debt", 100.0), (1, "coupling", 100.0), (2, "git_history", None), (3, "git_history", None), (3, "coupling", 40.0)]
    got = {x.project_id: (x.overall, x.band, x.measured) for x in r.composite(spark.createDataFrame(rows, SCORE)).collect()}
    assert got == {1: (87.8, "excellent", 6), 2: (50.0, "fair", 0), 3: (40.0, "poor", 1)}


def test_findings(spark):
    rows = [(1, "a", "c", f"t{i:03d}", "high" if i % 2 else "odd", "p", None if i == 7 else float(i % 150)) for i in range(260)]
    df = spark.createDataFrame(rows, FINDING)
    top = r.top_findings(df).collect()
    assert len(top) == 200 and [x.title for x in sorted(top, key=lambda x: x.place)][:2] == ["t149", "t148"]
    assert tuple(r.counts(df).first()) == (1, 0, 130, 0, 0, 0)
    made = r.finding(spark.createDataFrame([(1, "p", 140.0), (1, "q", None)], "project_id long, p string, s double"), "a", "c", F.col("p"), F.lit("low"), F.col("p"), F.col("s"))
    assert [x.score for x in made.orderBy("path").collect()] == [100.0, None]


def test_diff(spark):
    before = spark.createDataFrame([(1, "a", "c", "same", "low", "p", 1.0), (1, "a", "c", "gone", "low", "p", 1.0), (1, "a", "c", "worse", "low", "p", 1.0)], FINDING)
    after = spark.createDataFrame([(1, "a", "c", "same", "low", "p", 9.0), (1, "a", "c", "new", "low", "p", 1.0), (1, "a", "c", "worse", "high", "p", 1.0)], FINDING)
    got = {(x.finding.split(":")[-1], x.change, x.old, x.new) for x in r.findings_diff(before, after).collect()}
    assert got == {("gone", "removed", "low", None), ("new", "added", None, "low"), ("worse", "severity", "low", "high")}
    scores = r.scores_diff(spark.createDataFrame([(1, "x", 60.0), (1, "old", 5.0)], SCORE), spark.createDataFrame([(1, "x", 70.0), (1, "new", 3.0)], SCORE))
    assert {(x.analyzer, x.old, x.new, x.delta) for x in scores.collect()} == {("x", 60.0, 70.0, 10.0), ("old", 5.0, 0.0, -5.0), ("new", 0.0, 3.0, 3.0)}


def test_exports(spark):
    df = spark.createDataFrame([(1, "a", "c", "t", "critical", "p", 9.0), (1, "a", "c", "u", "what", None, None)], FINDING)
    shares = spark.createDataFrame([(1, "p", 30.0), (2, "p", 99.0)], "project_id long, path string, ai double")
    rows = {x.title: x for x in r.sarif_results(df, shares).collect()}
    assert (rows["t"].level, rows["t"].ai, rows["u"].level, rows["u"].ai) == ("error", 30.0, "note", None)
    parsed = json.loads(rows["t"].result)
    assert parsed["ruleId"] == "a/c" and parsed["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "p" and parsed["properties"] == {"score": 9.0, "aiShare": 30.0}
    quality = {x.description: (x.severity, x.path, x.fingerprint) for x in r.code_quality(df).collect()}
    assert quality == {"t": ("blocker", "p", "a:c:t"), "u": ("major", ".", "a:c:u")}
    row = r.histogram(spark.createDataFrame([("x", 0.5), ("x", 2.0), ("x", None)], "k string, v double"), ["k"], "v", [0.5, 1, 5]).first()
    assert tuple(row) == ("x", 2, 2.5, 1, 1, 2)


def test_guards(spark):
    shares = spark.createDataFrame([("p", 40.0, 35.0, 10.0, "m", 0.5), ("q", 100.0, 0.0, 0.0, "blame_session_commit", 0.9), ("r", 80.0, 20.0, 0.0, "blame_session_commit", 1.0), ("s", -1.0, 0.0, 101.0, "m", None)], "path string, ai double, human double, unattributed double, method string, confidence double")
    touches = spark.createDataFrame([(1, 1.0), (2, 0.9), (3, None)], "touch_id long, confidence double")
    moves = spark.createDataFrame([(1, "m", "causation", 9.0, 0.1), (2, "m", "correlation", 0.4, 0.1), (3, "m", "none", 0.4, 0.0), (4, "m", "correlation", None, 1.7)], "anchor_id long, metric string, claim string, delta double, confidence double")
    decisions = spark.createDataFrame([(1, 1.0), (2, 0.95)], "decision_id long, confidence double")
    got = sorted((x.rule, x.ref) for x in r.violations(shares, touches, moves, decisions).collect())
    assert got == [
        ("confidence_below_1", "authorship r"), ("confidence_below_1", "consequence 4 m"), ("confidence_below_1", "decision 1"), ("inconclusive_claims_nothing", "consequence 2 m"), ("never_causation", "consequence 1 m"),
        ("no_human_from_blame", "authorship r"), ("share_in_range", "authorship s ai"), ("share_in_range", "authorship s unattributed"), ("shares_sum_to_100", "authorship p"), ("touch_confidence_below_1", "touch 1"),
    ]


def test_calibration(spark):
    a = spark.createDataFrame([(1, 100.0), (2, 50.0)], "k long, expected double")
    assert tuple(r.calibration(a, spark.createDataFrame([(1, 90.0)], "k long, computed double"), ["k"]).first()) == (2, 50.0, 30.0)


def test_explain(spark):
    files = spark.createDataFrame(
        [(1, "f", 70.0, 30.0, 70.0, 0.0, 0.9, 2, 1, 1, 0.9, 63.0), (1, "g", None, None, None, None, None, 1, 0, 2, 0.5, None), (1, "h", None, None, None, None, None, None, None, None, None, None)],
        "project_id long, file_path string, base_risk double, ai double, unattributed double, human double, share_confidence double, writes long, reads long, sessions long, strength double, weighted_risk double",
    )
    decisions = spark.createDataFrame([(1, "f", i, f"d{i}") for i in (1, 2, 3, 4)] + [(1, "f", 1, "d1")], "project_id long, file_path string, decision_id long, summary string")
    moves = spark.createDataFrame([(1, "m", 2.5, "correlation"), (2, "m", 0.1, "none"), (3, "m", None, "none")], "decision_id long, metric string, delta double, claim string")
    got = {x.file_path: x for x in r.explain(files, decisions, moves).collect()}
    assert [f.name for f in got["f"].factors] == ["risk", "ai_authorship", "weighted_risk", "sessions", "decisions", "consequences"]
    assert got["f"].prose.endswith("4 decision(s) touch it: “d1”; “d2”; “d3”, and 1 more. Since then: m +2.5 (correlation), no discernible change — correlation, not causation.")
    assert [f.name for f in got["g"].factors] == ["ai_evidence", "sessions"] and "2 agent sessions (1 write, 0 read)" in got["g"].prose
    assert got["h"].prose == "h: no fusion evidence — not touched by a recorded agent session."


def test_numbers_with_sign(spark):
    values = [2.5, 0.4, -12.0, 123456.789, 1234567.0, 0.0, 0.00001234, 100.0, -0.05, 999999.5, 1e-4]
    got = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").select(signed_general(F.col("v"))).collect()]
    assert got == [f"{v:+g}" for v in values]


def test_long_explanations_are_counted(spark):
    files = spark.createDataFrame([(1, "f", 70.0, None, None, None, None, None, None, None, None, None)], "project_id long, file_path string, base_risk double, ai double, unattributed double, human double, share_confidence double, writes long, reads long, sessions long, strength double, weighted_risk double")
    decisions = spark.createDataFrame([(1, "f", i, f"d{i}") for i in range(150)], "project_id long, file_path string, decision_id long, summary string")
    moves = spark.createDataFrame([(i, "m", float(i), "correlation") for i in range(130)], "decision_id long, metric string, delta double, claim string")
    prose = r.explain(files, decisions, moves).first().prose
    assert "150 decision(s) touch it: “d0”; “d1”; “d2”, and 147 more." in prose and prose.endswith("m +99 (correlation), and 30 more — correlation, not causation.")
