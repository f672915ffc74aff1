"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

The corpus is counted in cells of source, language and topic. Raking fits the cells' token weights to the
marginals: the sources' target shares, and the shares that languages and topics have in the corpus, as far as
the cap on repeats leaves room. A cell's weight over its tokens is the expected number of uses of each of its
documents; whole uses are given, the remaining fraction is the document's probability of one more. Documents are drawn by
sampling balanced on tokens: exactly with that probability each, and so that the tokens drawn stay close to their expectation.

Cells are those of the actual languages and topics. Where they are too many for the driver, the rarer topics are
raked there in classes, and then each class by itself in a task, from its weights of source and language down to
the topics it holds, so that every topic still has a marginal of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.session import cut_lineage

#: The most cells raked in one place, and the topics that are raked one by one on the driver where there are more.
MAX_CELLS, HEAD_TOPICS = 100_000, 256
ROWS_PER_PART = 50_000


def same_source(source: Column) -> Column:
    """A source without regard to case and blanks."""
    return F.regexp_replace(F.lower(source), r"\s+", "")


def rake(cells: pd.DataFrame, shares: dict[str, float], max_repeats: float | np.ndarray, total: float | None = None, rounds: int = 60) -> np.ndarray:
    """Token weights of cells (columns source, lang, topic, tokens) under the cap of max_repeats (one for all or one for each cell) times their tokens.

    Sources meet their shares exactly where they hold enough; total is the largest at which all do, unless a
    smaller one is given. Languages and topics come as near to their shares in these sources as the caps allow.
    """
    tokens = cells["tokens"].to_numpy(dtype=float)
    codes = {c: pd.factorize(cells[c])[0] for c in ("source", "lang", "topic")}
    share = np.array([shares[s] for s in cells["source"].drop_duplicates()])
    by_source = np.bincount(codes["source"], tokens, minlength=len(share))
    cap = max_repeats * tokens
    cap_by_source = np.bincount(codes["source"], cap, minlength=len(share))
    most = float(np.min(cap_by_source[share > 0] / share[share > 0])) if (share > 0).any() else 0.0
    total = most if total is None else min(total, most)
    weight = tokens * (share * total / np.maximum(by_source, 1))[codes["source"]]

    def to_source(w: np.ndarray) -> np.ndarray:
        """Scales each source to its target; what hits the cap stays there and the rest takes it over."""
        w = np.minimum(w, cap)
        for _ in range(50):
            missing = share * total - np.bincount(codes["source"], w, minlength=len(share))
            if (np.abs(missing) <= 1e-9 * max(total, 1)).all():
                break
            free = np.where((missing[codes["source"]] > 0) & (w >= cap), 0.0, w)
            room = np.bincount(codes["source"], free, minlength=len(share))
            w = np.minimum(w + free * (missing / np.maximum(room, 1e-12))[codes["source"]], cap)
        return w

    for _ in range(rounds):
        for c in ("lang", "topic"):
            target = np.bincount(codes[c], tokens) / max(tokens.sum(), 1) * total
            have = np.bincount(codes[c], weight)
            weight = weight * (target / np.maximum(have, 1e-12))[codes[c]]
        weight = to_source(weight)
    return weight


def sizes(documents: DataFrame, n_tokens: Column, key: str = "doc_id") -> DataFrame:
    """key, source, lang, topic, n_tokens of each document, written once because every mix reads it twice.

    The topic is the word that the document's path names after its directory. An unknown language or topic is empty.
    """
    topic = F.regexp_extract("doc_path", r"/([A-Za-z]+)", 1)
    rows = documents.select(
        F.col(key), same_source(F.col("source")).alias("source"), F.coalesce(F.lower("lang"), F.lit("")).alias("lang"),
        F.coalesce(topic, F.lit("")).alias("topic"), n_tokens.alias("n_tokens"),
    )
    return cut_lineage(rows)


def balanced(tokens: np.ndarray, chance: np.ndarray, chances: np.random.Generator) -> np.ndarray:
    """Which documents are drawn: each exactly with its own probability, and their tokens as near to the expectation as one document allows.

    Two undecided documents trade tokens of expectation until one of them is certain; the odds of either direction are such
    that no probability changes on average, and what one gives the other takes, so the sum stays. By decreasing tokens the
    documents that meet are of like size, and the one left at the end is mostly a small one.
    """
    taken = np.zeros(len(tokens), dtype=np.int32)
    open_, p_open, n_open = -1, 0.0, 0.0
    for j, (n, p, x) in enumerate(zip(tokens.tolist(), chance.tolist(), chances.random(len(tokens)).tolist())):
        if p <= 1e-9 or p >= 1 - 1e-9:
            taken[j] = p > 0.5
            continue
        if open_ < 0:
            open_, p_open, n_open = j, p, n
            continue
        gain, loss = min((1 - p_open) * n_open, p * n), min(p_open * n_open, (1 - p) * n)
        moved = gain if x * (gain + loss) < loss else -loss
        p_open, p = p_open + moved / n_open, p - moved / n
        settled = p_open <= 1e-9 or p_open >= 1 - 1e-9
        if settled:
            taken[open_] = p_open > 0.5
        if p <= 1e-9 or p >= 1 - 1e-9:
            taken[j] = p > 0.5
            open_ = -1 if settled else open_
        else:
            open_, p_open, n_open = j, p, n
    if open_ >= 0:
        taken[open_] = chances.random() < p_open
    return taken


def _rates_of_classes(cells: DataFrame, shares: dict[str, float], repeats: dict[str, int], total: float | None) -> DataFrame:
    """source, lang, topic, rate of any number of cells."""
    spark = cells.sparkSession
    cells = cut_lineage(cells)
    classes = -(-cells.count() // MAX_CELLS)
    head = cells.groupBy("topic").agg(F.sum("tokens").alias("_of_topic")).orderBy(F.desc("_of_topic"), "topic").limit(HEAD_TOPICS)
    tail = F.when(F.col("_of_topic").isNull(), F.pmod(F.xxhash64("topic"), F.lit(classes)))
    classed = cells.join(head, "topic", "left").withColumn("tail", F.coalesce(tail, F.lit(-1)))
    coarse = classed.groupBy("source", "lang", "tail", F.when(F.col("tail") < 0, F.col("topic")).alias("name")).agg(F.sum("tokens").alias("tokens")).toPandas()
    coarse["topic"] = [*zip(coarse["tail"], coarse["name"].fillna(""))]
    coarse["weight"] = rake(coarse, shares, coarse["source"].map(repeats).to_numpy(dtype=float), total)
    rows = [(r.source, r.lang, int(r.tail), r.name_, float(r.weight), float(r.weight / r.tokens)) for r in coarse.rename(columns={"name": "name_"}).itertuples()]
    weights = spark.createDataFrame(rows, "source string, lang string, tail long, topic string, weight double, rate double")

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        weight = rows.groupby(["source", "lang"])["weight"].first()
        pair = pd.Series([*zip(rows["source"], rows["lang"])], index=rows.index)
        inner = pd.DataFrame({"source": pair, "lang": 0, "topic": rows["topic"], "tokens": rows["tokens"]})
        whole = float(weight.sum())
        if whole > 0:
            inner["rate"] = rake(inner, {k: w / whole for k, w in weight.items()}, rows["source"].map(repeats).to_numpy(dtype=float), whole) / rows["tokens"]
        else:
            inner["rate"] = 0.0
        return rows[["source", "lang", "topic"]].assign(rate=inner["rate"])

    rare = classed.where("tail >= 0").join(weights.where("tail >= 0").select("source", "lang", "tail", "weight"), ["source", "lang", "tail"])
    fitted = rare.groupBy("tail").applyInPandas(within, "source string, lang string, topic string, rate double")
    return weights.where("tail < 0").select("source", "lang", "topic", "rate").unionByName(fitted)


def draw(sized: DataFrame, targets: DataFrame, mix: str, key: str = "doc_id", total: float | None = None) -> DataFrame:
    """mix_name, key, source, n_tokens, repeats of the documents chosen for one mix of targets.

    Documents of sources outside the mix, without a source or without tokens are not used. A source of the mix
    without documents is left out, and the shares of the others are scaled up. Where a source is listed twice its shares add up and
    the smaller cap holds. The draw depends on the keys and the name of the mix only.
    """
    wanted = [r for r in targets.where(F.col("mix_name") == mix).select(same_source(F.col("source")).alias("source"), "target_share", "max_repeats").collect() if r.target_share > 0]
    shares: dict[str, float] = {}
    repeats: dict[str, int] = {}
    for r in wanted:
        shares[r.source] = shares.get(r.source, 0.0) + r.target_share
        repeats[r.source] = min(repeats.get(r.source, r.max_repeats), r.max_repeats)
    inside = sized.where(F.col("source").isin([*shares]) & (F.col("n_tokens") > 0))
    by_cell = inside.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    cells = by_cell.limit(MAX_CELLS + 1).toPandas()
    many = len(cells) > MAX_CELLS
    held = {r.source: r.n for r in by_cell.groupBy("source").agg(F.sum("n").alias("n")).collect()} if many else cells.groupby("source")["n"].sum().to_dict()
    found = {s: w for s, w in shares.items() if s in held}
    scale = sum(found.values())
    found = {s: w / scale for s, w in found.items()}
    if many:
        rates = _rates_of_classes(by_cell.drop("n"), found, repeats, total)
    else:
        caps = cells["source"].map(repeats).to_numpy(dtype=float)
        cells["rate"] = rake(cells, found, caps, total) / cells["tokens"] if len(cells) else 0.0
        rows = [(r.source, r.lang, r.topic, float(r.rate)) for r in cells.itertuples()]
        rates = sized.sparkSession.createDataFrame(rows, "source string, lang string, topic string, rate double")
    parts = max(1, -(-int(sum(held.values())) // ROWS_PER_PART))
    number = F.xxhash64(F.lit(mix), F.col(key))
    dealt = inside.join(rates, ["source", "lang", "topic"]).select(
        F.col(key).alias("key"), "source", "n_tokens", "rate", number.alias("_number"), F.pmod(number, F.lit(parts)).alias("_part")
    )

    def choose(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "_number", "key"], ascending=[False, True, True], ignore_index=True)
        rate = rows["rate"].to_numpy()
        whole = np.floor(rate + 1e-9)
        chances = np.random.default_rng([zlib.crc32(f"{mix}/{group[0]}".encode()), int(group[1])])
        extra = balanced(rows["n_tokens"].to_numpy(), np.maximum(rate - whole, 0.0), chances)
        rows["repeats"] = np.minimum(whole + extra, repeats[rows["source"].iloc[0]]).astype(np.int32)
        return rows.loc[rows["repeats"] > 0, ["key", "source", "n_tokens", "repeats"]]

    drawn = dealt.groupBy("source", "_part").applyInPandas(choose, f"key {dict(sized.dtypes)[key]}, source string, n_tokens long, repeats int")
    return drawn.select(F.lit(mix).alias("mix_name"), F.col("key").alias(key), "source", "n_tokens", "repeats")


def draw_all(sized: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """draw() for every mix of a small table of targets."""
    out = None
    for row in targets.select("mix_name").distinct().orderBy("mix_name").collect():
        part = draw(sized, targets, row[0], key)
        out = part if out is None else out.unionByName(part)
    return out


def shares_reached(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, documents, uses, tokens, share: what each source of each mix came to."""
    per_source = drawn.groupBy("mix_name", "source").agg(
        F.count("*").alias("documents"), F.sum("repeats").alias("uses"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens")
    )
    whole = per_source.groupBy("mix_name").agg(F.sum("tokens").alias("_all"))
    wanted = targets.groupBy("mix_name", same_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    return (
        wanted.join(per_source, ["mix_name", "source"], "left")
        .join(whole, "mix_name", "left")
        .select("mix_name", "source", "target_share", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "uses", "tokens")), F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("share"))
    )
