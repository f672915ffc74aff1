import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodewright.operators import windows as w
from lodewright.streaming import incremental as inc

T0 = datetime(2024, 1, 1)
S = timedelta(seconds=1)
EVENT = "id long, k string, t timestamp, v double"


def events(spark, n=200, seed=2):
    r = random.Random(seed)
    return [(i, "hot" if r.random() < 0.5 else r.choice("ab"), T0 + S * r.randrange(400), float(r.randrange(9))) for i in range(n)]


def test_rolling_and_change_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(w, "CHUNK_ROWS", 7)
    rows = events(spark)
    df = spark.createDataFrame(rows, EVENT)
    rolling = {x.id: x.rolling for x in w.rolling_mean(df, ["k"], "t", "v", "id", 5).collect()}
    delta = {x.id: x.delta for x in w.change(df, ["k"], "t", "v", "id").collect()}
    for k in ("hot", "a", "b"):
        order = sorted((t, i, v) for i, x, t, v in rows if x == k)
        for n, (_, i, v) in enumerate(order):
            last = [x[2] for x in order[max(0, n - 4) : n + 1]]
            assert abs(rolling[i] - sum(last) / len(last)) < 1e-4
            assert delta[i] == (None if n == 0 else v - order[n - 1][2])


def test_rate_limit_and_rank(spark):
    rows = events(spark)
    got = {x.id: (x.hits, x.rejected) for x in w.rate_limit(spark.createDataFrame(rows, EVENT), "k", "t", 3, 5).collect()}
    for i, k, t, _ in rows:
        hits = sum(x == k and t - 5 * S < u <= t for _, x, u, _ in rows)
        assert got[i] == (hits, hits > 3)
    values = [(i, float(v)) for i, v in enumerate([5, 5, 1, 9, 9, 2])] + [(9, None)]
    ranks = {x.id: x.place for x in w.global_rank(spark.createDataFrame(values, "id long, v double"), "v").collect()}
    assert ranks == {0: 3, 1: 3, 2: 6, 3: 1, 4: 1, 5: 5, 9: None}
    assert w.global_rank(spark.createDataFrame([], "id long, v double"), "v").count() == 0


def test_ranks_with_outliers_and_many_ties(spark):
    rng = random.Random(8)
    values = [rng.choice([1.0, 2.0, rng.random()]) for _ in range(400)] + [1e300, float("inf"), -float("inf")]
    ranks = {x.id: x.place for x in w.global_rank(spark.createDataFrame(list(enumerate(values)), "id long, v double"), "v").collect()}
    assert ranks == {i: 1 + sum(x > v for x in values) for i, v in enumerate(values)}


def run(spark, tmp_path, build, schema, *batches, mode="append"):
    """The rows a stream writes when the batches arrive one after another."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = build(spark.readStream.schema(schema).parquet(str(source))).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(out)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        del i
    return spark.read.parquet(str(out)).collect()


def test_stream_once_per_key(spark, tmp_path):
    batches = [[(1, "a", T0, 0.0), (1, "a", T0, 0.0), (2, "a", T0, 0.0)], [(1, "a", T0 + S, 0.0), (3, "b", T0, 0.0)]]
    got = run(spark, tmp_path, lambda s: inc.once_per_key(s, ["id"], "t"), EVENT, *batches)
    assert sorted(x.id for x in got) == [1, 2, 3]


def test_stream_bursts_equal_batch(spark, tmp_path):
    rows = events(spark, 60)
    far = [(999, "z", T0 + timedelta(days=1), 0.0)]
    got = run(spark, tmp_path, lambda s: inc.bursts(s, ["k"], "t", "5 seconds"), EVENT, rows[:30], rows[30:], far, [(1000, "z", T0 + timedelta(days=2), 0.0)])
    want = w.bursts(spark.createDataFrame(rows, EVENT), ["k"], "t", "5 seconds").collect()
    late = {(x.k, x.starts_at, x.ends_at, x.n) for x in got if x.k != "z"}
    assert late <= {(x.k, x.starts_at, x.ends_at, x.n) for x in want} | late and len(late) > 10
    first = run(spark, tmp_path / "b", lambda s: inc.first_per_window(s, ["k"], "t", "id", "10 seconds"), EVENT, rows, far, [(1000, "z", T0 + timedelta(days=2), 0.0)]) if (tmp_path / "b").mkdir() is None else []
    whole = w.first_per_window(spark.createDataFrame(rows, EVENT), ["k"], "t", "id", "10 seconds").collect()
    assert {tuple(x) for x in first if x.k != "z"} == {tuple(x) for x in whole}


def test_stream_new_turns(spark, tmp_path):
    schema = "session string, seq int, content_hash string"
    got = run(spark, tmp_path, lambda s: inc.new_turns(s, ["session"]), schema, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "n")], [("b", 1, "CHANGED")], mode="append")
    assert sorted((x.session, x.seq, x.action) for x in got) == [("a", 1, "new"), ("a", 2, "new"), ("a", 3, "new"), ("b", 1, "new"), ("b", 1, "rewritten")]


def test_bursts(spark):
    rows = [(1, "a", T0, 0.0), (2, "a", T0 + S, 0.0), (3, "a", T0 + 3 * S, 0.0), (5, "a", T0 + 5.001 * S, 0.0), (4, "b", T0, 0.0)]
    got = {(x.k, x.n) for x in w.bursts(spark.createDataFrame(rows, EVENT), ["k"], "t").collect()}
    assert got == {("a", 3), ("a", 1), ("b", 1)}
    assert w.bursts(spark.createDataFrame(rows, EVENT).where(F.lit(False)), ["k"], "t").count() == 0
