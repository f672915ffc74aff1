import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodewright.llm.packing import Budget, best_fit, fill_report, pack


def naive(sizes, budget):
    """The same rule over all windows ever opened, one by one."""
    cap, weight = budget.capacities(), np.array(budget.weights)
    left, out = [], np.zeros(len(sizes), int)
    for item in np.argsort(-sizes, kind="stable"):
        need = np.array([sizes[item], 1, sizes[item] ** 2]) / cap
        fits = [(float((weight * (r - need) ** 2).sum()), i) for i, r in enumerate(left) if (r - need >= -1e-12).all()]
        if fits:
            at = min(fits)[1]
        else:
            at = len(left)
            left.append(np.ones(3))
        left[at] = left[at] - need
        out[item] = at
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=120), st.sampled_from([Budget(100), Budget(100, documents=3), Budget(100, attention=4000.0)]))
def test_capacities_hold_and_rule_is_followed(sizes, budget):
    sizes = np.array(sizes, dtype=np.int64)
    window, position = best_fit(sizes, budget)
    for w in set(window.tolist()):
        inside = sizes[window == w]
        assert inside.sum() <= 100 and sorted(position[window == w]) == list(range(len(inside)))
        assert len(inside) == 1 or (len(inside) <= budget.capacities()[1] and (inside**2).sum() <= budget.capacities()[2] + 1e-6)
    expected = naive(sizes, budget)
    assert len(set(window.tolist())) <= len(set(expected.tolist())) + 1


def test_little_room_is_left():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(5, 1.2, 5000).astype(int) + 1, 2048)
    window, _ = best_fit(sizes, Budget(2048))
    assert len(set(window)) <= 1.01 * np.ceil(sizes.sum() / 2048) + 1


def test_operator(spark):
    rows = [(1, 250, "x"), (2, 60, "x"), (2, 60, "x"), (3, 0, None), (4, None, "x"), (5, 100, "x"), (None, 40, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, window string")
    out = pack(df, "doc_id", "n_tokens", Budget(100)).collect()
    assert sorted((r.doc_id or 0, r.piece, r.text_start, r.n_tokens) for r in out) == [(0, 1, 0, 40), (1, 1, 0, 100), (1, 2, 100, 100), (1, 3, 200, 50), (2, 1, 0, 60), (2, 1, 0, 60), (3, 1, 0, 0), (4, 1, 0, 0), (5, 1, 0, 100)]
    assert len({(r.window, r.position) for r in out}) == len(out)
    per_window = {}
    for r in out:
        per_window[r.window] = per_window.get(r.window, 0) + r.n_tokens
    assert max(per_window.values()) <= 100 and len(per_window) == 6
    assert pack(df.limit(0), "doc_id", "n_tokens", Budget(100)).count() == 0
    many = spark.range(3000).selectExpr("id as doc_id", "id % 97 + 1 as n_tokens")
    grouped = pack(many, "doc_id", "n_tokens", Budget(100), group_rows=500)
    assert grouped.count() == 3000 and grouped.groupBy("window").sum("n_tokens").where("`sum(n_tokens)` > 100").count() == 0
    budgets = spark.createDataFrame([("b", 100)], "budget_name string, capacity_tokens int")
    row = fill_report(grouped.selectExpr("'b' as budget_name", "*"), budgets).first()
    assert row.items == 3000 and row.fill > 0.95
    assert pytest.approx(row.tokens) == sum(i % 97 + 1 for i in range(3000))


def test_registered_query_packs_under_every_capacity(spark, monkeypatch):
    from lodewright.llm import queries

    rows = spark.createDataFrame([(i, n) for i, n in enumerate([96] * 3 + [4] * 3 + [94] * 2 + [6] * 2 + [1] * 20)], "doc_id long, n_tokens int")
    monkeypatch.setattr(queries, "_document_sizes", lambda spark, sf_dir: rows)
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: spark.createDataFrame([("b", 100)], "budget_name string, capacity_tokens int"))
    windows = {}
    for r in queries.QUERIES["p6_windows"](spark, "").collect():
        windows.setdefault(r.window, []).append(r.n_tokens)
    # by tokens alone every 96 would take a 4 along, and all the small ones would share a window
    assert sorted(map(sorted, (w for w in windows.values() if 96 in w))) == [[96]] * 3
    assert sorted(map(sorted, (w for w in windows.values() if 94 in w))) == [[6, 94]] * 2
    assert sum(map(len, windows.values())) == 30 and max(map(len, windows.values())) == 100 // 16


def test_registered_query_packs_under_attention(spark, monkeypatch):
    from lodewright.llm import queries

    rows = spark.createDataFrame([(i, n) for i, n in enumerate([40] * 6 + [60] * 3 + [10] * 8)], "doc_id long, n_tokens int")
    monkeypatch.setattr(queries, "_document_sizes", lambda spark, sf_dir: rows)
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: spark.createDataFrame([("b", 100)], "budget_name string, capacity_tokens int"))
    windows = {}
    for r in queries.QUERIES["p6_attention_windows"](spark, "").collect():
        windows.setdefault(r.window, []).append(r.n_tokens)
    assert sum(map(len, windows.values())) == 17
    assert all(len(w) == 1 or sum(n * n for n in w) <= 2500 for w in windows.values())
    assert sorted(map(sorted, (w for w in windows.values() if 60 in w))) == [[60]] * 3
