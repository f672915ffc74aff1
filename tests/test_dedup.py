import base64
import random
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lodewright.operators import dedup as d

SF = "/root/testdata/sf0.01"

T0 = datetime(2024, 1, 1)
U, H = "202559db-e249-4aa7-a2bf-2b551ce9acf9", "255ea213d1e28e38c6a6414768e1a3056ca9fcffa075893231be2e4ea96dc049"
SCHEMA = "delivery_id long, source string, external_id string, seq int, content_hash string, delivered_at timestamp, arrival string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def ids(df):
    return sorted(r.delivery_id for r in df.collect())


def test_spellings_order_and_nulls(spark):
    m = timedelta(minutes=1)
    b64 = base64.b64encode(bytes.fromhex(H)).decode()
    rows = [
        (1, "s", U, 1, H, T0 + m), (2, "s", U.upper(), 1, "sha256:" + H, T0), (3, "s", "{" + U + "}", 1, H.upper(), T0), (4, "s", "urn:uuid:" + U, 1, b64, T0 + m),
        (5, "t", U, 1, H, T0), (6, "s", U, 2, H, T0), (7, "s", U, 1, "", T0), (8, "s", U, 1, "", T0), (9, "s", U, 1, "x" + H[1:], T0),
        (10, "s", None, 1, H, T0), (11, "s", None, 1, H, T0), (12, "s", U, 3, None, T0), (13, "s", U, 3, None, None), (14, "s", U, 4, H, None), (15, "s", U, 4, H, T0 + 9 * m), (-5, "s", U, 5, H, T0), (16, "s", U, 5, H, T0), (16, "s", U, 5, H, T0),
        (17, "s", "agent-1", 1, H, T0), (18, "s", " agent-1", 1, H, T0), (19, "s", "Agent-1", 1, H, T0),
    ]
    df = frame(spark, rows)
    assert ids(d.redeliveries(df)) == [1, 3, 4, 8, 13, 14, 16, 16, 18]
    assert ids(d.deduplicate(df)) == [-5, 2, 5, 6, 7, 9, 10, 11, 12, 15, 17, 19]
    assert ids(d.redeliveries(df.limit(0))) == []


def test_batches_through_a_store_equal_one_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "s", U, 1 if rng.random() < 0.3 else rng.randrange(60), H, T0 + timedelta(seconds=i)) for i in range(400)]
    whole = ids(d.redeliveries(frame(spark, rows)))
    store, parts = d.SeenStore(spark, f"file://{tmp_path}/seen", shards=3), []
    for k in range(0, 400, 150):
        parts += ids(d.redeliveries(frame(spark, rows[k : k + 150]), d.SeenStore(spark, f"file://{tmp_path}/seen", shards=3)))
    assert sorted(parts) == whole
    assert store.version == 0 and d.SeenStore(spark, f"file://{tmp_path}/seen").shards == 3


def test_failed_batch_leaves_no_trace(spark, tmp_path):
    df = frame(spark, [(1, "s", U, 1, H, T0), (2, "s", U, 1, H, T0)])
    store = d.SeenStore(spark, f"file://{tmp_path}/seen", shards=2)
    d.select_unseen(df, d.turn_identity, "delivered_at", "delivery_id", 2, [], store).write.parquet(f"file://{tmp_path}/seen/batch-1")
    assert ids(d.redeliveries(df, store)) == [2]
    assert ids(d.redeliveries(df, store)) == [1, 2]


def test_the_bitmap_decides(spark, monkeypatch):
    """With a bitmap that never answers "seen", redeliveries in later waves would be kept."""
    from lodewright.plans.general import p4_found
    from lodewright.session import table

    found = ids(p4_found(spark, SF))
    assert found
    events = table(spark, SF, "session_events")
    rows, edges = d.waves_of(events, "delivered_at")
    assert len(edges) == d.WAVES - 1
    one = d.turn_identity(events).groupBy("_ident").count().count()

    def blind(rows, remember=True):
        import numpy
        from lodewright.operators import dedup

        real, dedup.SeenBits.contains = dedup.SeenBits.contains, lambda self, codes: numpy.zeros(len(codes), dtype=bool)
        try:
            return dedup._select(rows, remember=remember)
        finally:
            dedup.SeenBits.contains = real

    assert d.kept_deliveries(events).count() == one
    monkeypatch.setattr(d, "_select", blind)
    assert d.kept_deliveries(events).count() > one and ids(p4_found(spark, SF)) != found


def test_a_batch_reads_only_its_own_entries(spark, tmp_path):
    store = d.SeenStore(spark, f"file://{tmp_path}/seen", shards=40)
    first = frame(spark, [(i, "s", U, i, H, T0) for i in range(200)])
    assert d.kept_deliveries(first, store).count() == 200
    again = frame(spark, [(1000, "s", U, 7, H, T0), (1001, "s", U, 777, H, T0)])
    coded = store.codes_of(d.turn_identity(again).select(F.pmod(F.xxhash64("_ident"), F.lit(40)).cast("int").alias("shard"), F.col("_ident").alias("ident"))).collect()
    assert sorted(r.code is None for r in coded) == [False, True]
    state = store.bitmaps([r.shard for r in coded])
    assert {r.shard for r in state.collect()} == {r.shard for r in coded} and len(state.inputFiles()) == len({r.shard for r in coded})
    assert ids(d.kept_deliveries(again, store)) == [1001]
    assert ids(d.kept_deliveries(again, d.SeenStore(spark, f"file://{tmp_path}/seen"))) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 300_000), max_size=200), st.lists(st.integers(0, 300_000), max_size=200), st.integers(0, 70_000))
def test_bits_round_trip(a, b, run):
    bits = d.SeenBits()
    bits.union(np.array(a, dtype=np.int64))
    bits.union(np.arange(run))
    bits = d.SeenBits.loads(bits.dumps())
    assert len(bits) == len(set(a) | set(range(run)))
    assert bits.contains(np.array(b, dtype=np.int64)).tolist() == [x in a or x < run for x in b]
