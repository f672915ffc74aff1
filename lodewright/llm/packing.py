"""Filling windows of fixed capacity with documents: vector best fit.

A window has a capacity of tokens, of documents and of attention cost (the sum of squared lengths, as each
document attends to itself only). Documents go in by decreasing size; each takes, of the open windows where
it fits under every capacity, the one whose weighted residual is smallest afterwards. Documents are dealt
into groups of bounded size by a hash, and each group is packed by itself: what that costs is at most a
partly filled window or so per group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents packed together; also the base of window numbers.
GROUP_ROWS, GROUP_BASE = 20_000, 1 << 20
#: The attention capacity of a window unless one is given, as a share of its squared tokens.
ATTENTION_SHARE = 0.9


@dataclass(frozen=True)
class Budget:
    """The capacities of a window. By default it holds a document for every 16 tokens and nine tenths of the attention cost
    that one document of all its tokens has, so a document of more than 95 % of the tokens shares its window with none. A document beyond
    the attention budget gets a window to itself."""

    tokens: int
    documents: int | None = None
    attention: float | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)

    def capacities(self) -> np.ndarray:
        documents = max(1, self.tokens // 16) if self.documents is None else self.documents
        return np.array([self.tokens, documents, ATTENTION_SHARE * float(self.tokens) ** 2 if self.attention is None else self.attention], dtype=float)


def best_fit(sizes: np.ndarray, budget: Budget) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of each item, both from 0. No item is larger than the capacity.

    Equal items keep their order.
    """
    capacity = budget.capacities()
    weight = np.array(budget.weights)[:, None]
    order = np.argsort(-sizes, kind="stable")
    window, position = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    # residuals as shares of the capacities, one column for each open window
    left, number, filled = np.empty((3, 1024)), np.empty(1024, np.int64), np.empty(1024, np.int64)
    count = opened = 0
    smallest = float(sizes.min()) / capacity[0] if len(sizes) else 0.0
    least_cost = float(sizes.min()) ** 2 / capacity[2] if len(sizes) else 0.0
    for k, item in enumerate(order):
        n = float(sizes[item])
        need = np.array([n, 1.0, n * n]) / capacity
        at = -1
        if count:
            after = left[:, :count] - need[:, None]
            score = (weight * after * after).sum(axis=0)
            score[(after < -1e-12).any(axis=0)] = np.inf
            at = int(score.argmin())
            if score[at] == np.inf:
                at = -1
        if at < 0:
            if count == left.shape[1]:
                left, number, filled = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([number, number]), np.concatenate([filled, filled])
            at, count = count, count + 1
            left[:, at], number[at], filled[at] = 1.0, opened, 0
            opened += 1
        left[:, at] -= need
        window[item], position[item] = number[at], filled[at]
        filled[at] += 1
        if k % 512 == 511 or left[0, at] < smallest:  # close what nothing fits into any more
            open_ = np.flatnonzero((left[0, :count] >= smallest - 1e-12) & (left[1, :count] > 1e-12) & (left[2, :count] >= least_cost - 1e-12))
            count = len(open_)
            left[:, :count], number[:count], filled[:count] = left[:, open_], number[open_], filled[open_]
    return window, position


def pack(df: DataFrame, key: str, size: str, budget: Budget, group_rows: int = GROUP_ROWS) -> DataFrame:
    """window, position, key, piece, text_start, n_tokens: where each document goes; positions and pieces count from 1.

    An item larger than the capacity is cut into full pieces and a rest; no other is split. text_start is the
    token of the document at which a piece begins. Items of size 0 take a place but no tokens; a null size
    counts as 0. Repeated rows are items of their own. Window numbers are unique, not consecutive.
    """
    cap = budget.tokens
    pieces = df.select(F.col(key).alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size")).withColumn(
        "piece", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("size") / F.lit(cap)), F.lit(1)).cast("int")))
    )
    items = pieces.select(
        "key", "piece", ((F.col("piece") - 1) * cap).cast("long").alias("text_start"),
        F.least(F.lit(cap).cast("long"), F.col("size") - (F.col("piece") - 1) * cap).alias("n_tokens"),
    )
    groups = max(1, -(-items.count() // group_rows))
    kind = dict(df.dtypes)[key]

    def fill(group: int, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "piece"], kind="stable", ignore_index=True)
        window, position = best_fit(rows["n_tokens"].to_numpy(), budget)
        rows["window"], rows["position"] = group * GROUP_BASE + window, position + 1
        return rows[["window", "position", "key", "piece", "text_start", "n_tokens"]]

    dealt = items.withColumn("_group", F.pmod(F.xxhash64("key", "piece"), F.lit(groups)))
    return (
        dealt.groupBy("_group")
        .applyInPandas(lambda k, rows: fill(int(k[0]), rows), f"window long, position int, key {kind}, piece int, text_start long, n_tokens long")
        .withColumnRenamed("key", key)
    )


def pack_budgets(sizes: DataFrame, budgets: DataFrame, key: str = "doc_id", size: str = "n_tokens", name: str = "budget_name", capacity: str = "capacity_tokens", attention_share: float | None = None) -> DataFrame:
    """pack() for every budget of a small table, with its name in front; under an attention capacity of this share of the squared tokens if one is given."""
    out = None
    for row in budgets.select(name, capacity).distinct().orderBy(name).collect():
        packed = pack(sizes, key, size, Budget(row[1], attention=attention_share and attention_share * row[1] ** 2)).select(F.lit(row[0]).alias(name), "*")
        out = packed if out is None else out.unionByName(packed)
    return out


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_name, windows, items, tokens, fill: how full the windows are."""
    total = packed.groupBy("budget_name").agg(F.countDistinct("window").alias("windows"), F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return total.join(budgets, "budget_name").select("budget_name", "windows", "items", "tokens", (F.col("tokens") / (F.col("windows") * F.col("capacity_tokens"))).alias("fill"))
