from datetime import datetime, timedelta

from lodewright.operators import history as h

T0 = datetime(2024, 1, 1)
COMMITS = "commit_id long, project_id long, author_name string, author_email string, authored_at timestamp, path string"
FILES = "commit_id long, project_id long, path string, added int, removed int, author string"


def frames(spark, commits, files):
    return spark.createDataFrame([(*c, "clash") for c in commits], COMMITS), spark.createDataFrame([(*f, "clash") for f in files], FILES)


def test_churn_counts_repeats_once_and_binary_as_zero(spark):
    c, f = frames(spark, [(1, 1, "A", "A@x", T0), (2, 1, "B", None, T0), (3, 1, "a", "a@X", T0), (4, 1, "", "", T0)], [(1, 1, "p", 10, 0), (1, 1, "p", 10, 0), (2, 1, "p", None, None), (3, 1, "p", 0, 5), (4, 1, "q", 1, 1), (9, 1, "q", 1, 1)])
    got = {r.path: (r.churn, r.commits, r.authors) for r in h.file_churn(h.changes(c, f)).collect()}
    assert got == {"p": (15, 3, 2), "q": (2, 1, 1)}
    authors = {r.author: r.commits for r in h.author_commits(c).collect()}
    assert authors == {"a@x": 2, "b": 1, "unknown": 1}
    empty = h.changes(c.limit(0), f.limit(0))
    assert h.file_churn(empty).count() == 0 and h.hotspots(h.file_churn(empty)).count() == 0


def test_hotspots_come_from_the_most_churned(spark):
    rows = [(1, f"f{i:02d}", 1000 - i, 2 if i < 12 else 4, 1, T0) for i in range(30)] + [(2, "x", 49, 9, 1, T0), (2, "y", 50, 3, 2, T0)]
    churned = spark.createDataFrame(rows, "project_id long, path string, churn long, commits long, authors long, first_seen timestamp")
    hot = h.hotspots(churned).orderBy("project_id", "place").collect()
    assert [r.path for r in hot if r.project_id == 1] == [f"f{i}" for i in range(12, 20)]
    only = [r for r in hot if r.project_id == 2]
    assert [(r.path, r.composite, r.severity) for r in only] == [("y", 5.1, "low")]


def test_bus_factor_and_score(spark):
    authored = spark.createDataFrame([(1, "a", 80), (1, "b", 20), (2, "a", 40), (2, "b", 40), (2, "c", 20), *[(3, f"a{i}", 1) for i in range(10)]], "project_id long, author string, commits long")
    bus = h.bus_factor(authored)
    assert {r.project_id: r.bus_factor for r in bus.collect()} == {1: 1, 2: 2, 3: 8}
    churned = spark.createDataFrame([(1, "p", 10000, 9, 1, T0), (2, "q", 4, 6, 1, T0)], "project_id long, path string, churn long, commits long, authors long, first_seen timestamp")
    lone = h.islands(churned)
    assert [(r.project_id, r.path, r.place) for r in h.first_islands(lone).orderBy("project_id").collect()] == [(1, "p", 1), (2, "q", 1)]
    scores = {r.project_id: (r.score, r.ledger) for r in h.score(h.hotspots(churned), bus, lone).collect()}
    assert scores[1] == (100 - 39.6 - 35 - 1.5, "top hotspot 'p' = 99.0 (-39.6); bus_factor = 1 (-35.0); 1 knowledge islands (-1.5)")
    assert scores[2][0] == 78.5 and scores[3] == (100.0, "bus_factor = 8 (healthy)")


def test_cadence(spark):
    d = timedelta(days=1)
    rows = [(i, 1, "A", None, t) for i, t in enumerate([T0, T0 - 90 * d, T0 - 91 * d, T0 - 180 * d, T0 - 181 * d])] + [(9, 2, "A", None, T0)]
    c, _ = frames(spark, rows, [(1, 1, "p", 1, 1)])
    got = {r.project_id: (r.recent, r.prior, r.ratio) for r in h.cadence(c).collect()}
    assert got == {1: (2, 2, 1.0), 2: (1, 0, None)}
