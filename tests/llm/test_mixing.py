import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodewright.llm import mixing


def test_raking_meets_marginals():
    rng = np.random.default_rng(2)
    cells = pd.DataFrame([(s, lang, t, float(rng.integers(50, 500))) for s in "abc" for lang in range(3) for t in range(4)], columns=["source", "lang", "topic", "tokens"])
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    weight = mixing.rake(cells, shares, 8, total=cells["tokens"].sum() * 0.8)
    got = cells.assign(w=weight)
    for s, share in shares.items():
        assert got[got.source == s].w.sum() / got.w.sum() == pytest.approx(share, abs=1e-6)
    for c in ("lang", "topic"):
        have, want = got.groupby(c).w.sum() / got.w.sum(), got.groupby(c).tokens.sum() / got.tokens.sum()
        assert np.allclose(have, want, atol=5e-3)
    assert (weight <= 8 * cells["tokens"] + 1e-6).all()


def test_raking_respects_caps_and_fills_them():
    cells = pd.DataFrame([("a", 0, 0, 10.0), ("a", 1, 0, 30.0), ("b", 0, 0, 1000.0)], columns=["source", "lang", "topic", "tokens"])
    weight = mixing.rake(cells, {"a": 0.5, "b": 0.5}, 4)
    assert weight == pytest.approx([40, 120, 160])


def test_draws_stay_close_to_expectation():
    rng = np.random.default_rng(3)
    tokens = np.sort(rng.lognormal(5, 1.5, 400).astype(int) + 1)[::-1]
    for p in (0.05, 0.5, 0.93):
        gaps = [abs((mixing.balanced(tokens, np.full(400, p), np.random.default_rng(k)) * tokens).sum() - p * tokens.sum()) for k in range(50)]
        assert max(gaps) <= tokens[0] + 1 and np.median(gaps) <= 2 * np.median(tokens)


def test_each_document_is_drawn_with_its_own_probability():
    rng = np.random.default_rng(5)
    tokens = np.sort(rng.lognormal(5, 1.5, 120).astype(int) + 1)[::-1]
    chance = np.where(rng.random(120) < 0.2, rng.integers(0, 2, 120), rng.random(120))
    drawn = np.mean([mixing.balanced(tokens, chance, np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert (np.abs(drawn - chance) <= 4.5 * np.sqrt(chance * (1 - chance) / 4000) + 1e-9).all()


def test_inclusion_over_mixes_does_not_depend_on_size(spark):
    rows = [(i, "ab"[i % 2], "en", "x/p-1", 1 + i // 2, None) for i in range(400)]
    mixes = [f"m{k}" for k in range(10)]
    targets = spark.createDataFrame([(m, s, 0.5, 1) for m in mixes for s in "ab"], "mix_name string, source string, target_share double, max_repeats int")
    sized = mixing.sizes(spark.createDataFrame(rows, SCHEMA), F.col("n"))
    used = np.zeros(400)
    for m in mixes:
        for r in mixing.draw(sized, targets, m, total=0.4 * 40_200).collect():
            used[r.doc_id] += 1
    assert [used[k : k + 100].mean() / len(mixes) for k in range(0, 400, 100)] == pytest.approx([0.4] * 4, abs=0.04)


SCHEMA = "doc_id long, source string, lang string, doc_path string, n int, repeats string"


def test_operator(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [" A", "a", "B b", "bb", "C"][i % 5], ["en", "de", None][i % 3], f"x/{'pq'[i % 2]}-{i}.md", int(rng.integers(1, 40)), "clash") for i in range(600)]
    rows += [(1000, None, "en", None, 10, None), (1001, "d", "en", "x/p", 10, None), (1002, "a", "en", "x/p", 0, None), (1003, "a", "en", "x/p", None, None)]
    targets = spark.createDataFrame([("m", "a ", 0.6, 3), ("m", "BB", 0.3, 3), ("m", "missing", 0.1, 3), ("n", "c", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    sized = mixing.sizes(spark.createDataFrame(rows, SCHEMA), F.col("n"))
    drawn = mixing.draw_all(sized, targets)
    got = drawn.collect()
    assert len({(r.mix_name, r.doc_id) for r in got}) == len(got) and all(1 <= r.repeats <= 3 for r in got if r.mix_name == "m")
    assert {r.doc_id for r in got if r.mix_name == "n"} == {i for i in range(600) if i % 5 == 4}
    shares = {(r.mix_name, r.source): r for r in mixing.shares_reached(drawn, targets).collect()}
    assert shares["m", "a"].share == pytest.approx(2 / 3, abs=0.01) and shares["m", "bb"].share == pytest.approx(1 / 3, abs=0.01)
    assert shares["m", "missing"].tokens == 0 and shares["n", "c"].share == 1.0
    assert sorted(map(tuple, mixing.draw_all(sized, targets).collect())) == sorted(map(tuple, got))
    assert mixing.draw_all(sized.limit(0), targets).count() == 0


def test_hot_source_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_PART", 50)
    rows = [(i, "a" if i % 3 else "b", "en", "x/p-1", 1 + i % 50, None) for i in range(900)]
    targets = spark.createDataFrame([("m", "a", 0.2, 2), ("m", "b", 0.8, 2)], "mix_name string, source string, target_share double, max_repeats int")
    sized = mixing.sizes(spark.createDataFrame(rows, SCHEMA), F.col("n"))
    shares = {r.source: r.share for r in mixing.shares_reached(mixing.draw_all(sized, targets), targets).collect()}
    assert shares["a"] == pytest.approx(0.2, abs=0.02)


def test_caps_differ_by_source(spark):
    rows = [(i, "ab"[i % 2], "en", "x/p-1", 10, None) for i in range(40)]
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.25, 4), ("m", "b", 0.25, 3)], "mix_name string, source string, target_share double, max_repeats int")
    got = mixing.draw(mixing.sizes(spark.createDataFrame(rows, SCHEMA), F.col("n")), targets, "m").collect()
    assert {(r.source, r.repeats) for r in got} == {("a", 1), ("b", 1)} and len(got) == 40
    lone = targets.where("source = 'b'")
    assert {r.repeats for r in mixing.draw(mixing.sizes(spark.createDataFrame(rows, SCHEMA), F.col("n")), lone, "m").collect()} == {3}


def by_topic(sized, drawn):
    rows = drawn.join(sized.select("doc_id", "topic"), "doc_id").groupBy("topic").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).collect()
    whole = sum(r.t for r in rows)
    return {r.topic: r.t / whole for r in rows}


def test_each_topic_has_its_own_marginal(spark):
    # ledger and ranker fall into one of 32 classes by hash
    rows = [(i, "ab"[i % 2], "en", f"x/{('ledger', 'ranker')[(i // 2 % 5 < 4) == i % 2]}-{i}.md", 10, None) for i in range(2000)]
    targets = spark.createDataFrame([("m", "a", 0.6, 8), ("m", "b", 0.4, 8)], "mix_name string, source string, target_share double, max_repeats int")
    sized = mixing.sizes(spark.createDataFrame(rows, SCHEMA), F.col("n"))
    got = by_topic(sized, mixing.draw(sized, targets, "m", total=16_000))
    assert got["ledger"] == pytest.approx(0.5, abs=0.02) and got["ranker"] == pytest.approx(0.5, abs=0.02)


def test_more_cells_than_one_place_holds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_CELLS", 20)
    monkeypatch.setattr(mixing, "HEAD_TOPICS", 3)
    names = [f"t{chr(97 + k)}" for k in range(16)]
    rows = [(i, "ab"[i % 2], ("en", None)[i // 2 % 2], f"x/{names[(i // 4 * i // 3 + i % 2 * 5) % 16]}-{i}.md", 10 + i % 7, None) for i in range(6000)]
    targets = spark.createDataFrame([("m", "a", 0.6, 8), ("m", "b", 0.4, 8)], "mix_name string, source string, target_share double, max_repeats int")
    sized = mixing.sizes(spark.createDataFrame(rows, SCHEMA), F.col("n"))
    drawn = mixing.draw(sized, targets, "m", total=60_000)
    whole = sum(r[4] for r in rows)
    want = {r.topic: r.t / whole for r in sized.groupBy("topic").agg(F.sum("n_tokens").alias("t")).collect()}
    got = by_topic(sized, drawn)
    assert len(want) == 16 and all(got[k] == pytest.approx(w, abs=0.01) for k, w in want.items())
    assert {r.source: r.share for r in mixing.shares_reached(drawn, targets).collect()} == pytest.approx({"a": 0.6, "b": 0.4}, abs=0.01)
