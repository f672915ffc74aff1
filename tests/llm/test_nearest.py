import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodewright.functions.paths import resolve_path
from lodewright.llm.nearest import grouped, link_touches, nearest_in_time

T0 = datetime(2024, 1, 1)
TOL = 30 * 60 * 1_000_000


def brute(left, right, tol):
    out = set()
    for lid, e, t in left:
        if e is None or t is None:
            continue
        best = min(((abs((rt - t).total_seconds()), rt, rid) for rid, re, rt in right if re == e and rt is not None), default=None)
        if best and best[0] * 1e6 <= tol:
            out.add((lid, best[2]))
    return out


def pairs(spark, left, right, **tuning):
    a = spark.createDataFrame(left, "id long, e string, t timestamp").withColumn("us", F.lit("clash"))
    b = spark.createDataFrame(right, "id long, e string, t timestamp").withColumn("left_id", F.lit("clash"))
    got = nearest_in_time(a, b, entity=["e"], left_id="id", left_time="t", right_id="id", right_time="t", tolerance_us=TOL, **tuning).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {(r.left_id, r.right_id) for r in got}


def test_matches_brute_force_with_a_hot_entity(spark):
    rng = random.Random(1)
    entity = lambda: "hot" if rng.random() < 0.4 else rng.choice("abcdef")
    time = lambda: T0 + timedelta(minutes=5 * rng.randrange(3000))
    left = [(i, entity(), time()) for i in range(800)] + [(900, None, T0), (901, "a", None)]
    right = [(i, entity(), time()) for i in range(800)] + [(900, None, T0), (901, "a", None)]
    left += left[:50]
    for tuning in ({}, {"rows_per_range": 7, "slices": 3}, {"rows_per_range": 60, "slices": 1}):
        assert pairs(spark, left, right, **tuning) == brute(left, right, TOL)


def test_groups_stay_small_with_an_outlier_and_a_hot_entity(spark):
    rng = random.Random(2)
    left = [(i, "hot" if i % 3 else f"e{i % 50}", T0 + timedelta(seconds=rng.randrange(40 * 86_400))) for i in range(12_000)]
    # a third of everything within two hours of one file, and one record in the year 9998
    left += [(20_000 + i, "hot", T0 + timedelta(seconds=rng.randrange(7200))) for i in range(6_000)] + [(99_999, "e1", datetime(9998, 1, 1))]
    right = [(i, "hot" if i % 3 else f"e{i % 50}", T0 + timedelta(seconds=rng.randrange(40 * 86_400))) for i in range(3_000)]
    a, b = spark.createDataFrame(left, "id long, e string, t timestamp"), spark.createDataFrame(right, "id long, e string, t timestamp")
    l_cut, r_cut = grouped(a, b, ["e"], "id", "t", "id", "t", TOL, 1000, 4)
    assert l_cut.count() == len(left)
    keys = ["_range", "_slice", "_part"]
    sizes = l_cut.select(*keys).unionByName(r_cut.select(*keys)).groupBy(*keys).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2000 and sizes.count() > 20


def test_edges(spark):
    m = timedelta(minutes=1)
    left = [(1, "a", T0), (2, "b", T0), (3, "c", T0), (4, "d", T0)]
    right = [(9, "a", T0 + 30 * m), (8, "b", T0 + 31 * m), (7, "c", T0 + 5 * m), (6, "c", T0 - 5 * m), (5, "c", T0 - 5 * m), (5, "c", T0 - 5 * m)]
    assert pairs(spark, left, right) == {(1, 9), (3, 5)}
    assert pairs(spark, left, []) == pairs(spark, [], right) == set()


def test_paths(spark):
    rows = ["a/b.py", "./a/b.py", "a//b.py", "a\\b.py", "x/../a/b.py", "/r/p/a/b.py", "../p/a/./b.py", "../../../../r/p/a/b.py", "", None, "/"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "f string").select(resolve_path(F.col("f"), F.lit("/r/p"))).collect()]
    assert got == ["/r/p/a/b.py"] * 8 + ["/r/p", None, "/"]


def test_touches(spark):
    touches = spark.createDataFrame(
        [(1, 1, "a\\b.py", "write", T0, None), (1, 1, "a\\b.py", "write", T0, None), (2, 1, "a/b.py", "read", T0, None), (3, 1, "a/b.py", "write", T0, "x"), (4, 2, "a/b.py", "delete", T0, None), (5, None, "a/b.py", "create", T0, None)],
        "touch_id long, project_id long, file_path string, touch_kind string, occurred_at timestamp, commit_sha string",
    )
    commits = spark.createDataFrame([(10, T0 + timedelta(minutes=3)), (11, T0)], "commit_id long, authored_at timestamp")
    files = spark.createDataFrame([(10, 1, "a/b.py"), (10, 1, "a/b.py"), (11, 3, "a/b.py")], "commit_id long, project_id long, path string")
    projects = spark.createDataFrame([(1, "/r/p"), (2, "/r/q"), (3, "/r/s")], "project_id long, path string")
    assert [tuple(r) for r in link_touches(touches, commits, files, projects).collect()] == [(1, 10, 180_000_000)]
