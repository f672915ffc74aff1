"""The reading level of documents: one smoothed unigram language model for each level.

Trained on the graders' labels; a document gets the level under which its words, taken together, are most
probable. Headings, code and tables are left out, and as every word of the prose weighs the same, a few
easier sentences do not lower the level.

Languages without labels are seeded by a formula: a sample of their documents gets the level whose labelled
documents have the nearest LIX, and each language's model is trained on its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 5
#: The most labels a model is trained on. It keeps every word of their documents, so this bounds the model as well.
MAX_LABELS = 20_000
#: The weight of the words' overall frequencies in each level's model.
SMOOTHING = 0.2

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1|\Z)", re.DOTALL | re.MULTILINE)
_ASIDE = re.compile(r"^[ \t]{0,3}#{1,6}[ \t].*$|^[ \t]*\|.*$|^(?: {4}|\t).*$|`[^`\n]*`|https?://\S+", re.MULTILINE)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_STOP = re.compile(r"[.!?:]+(?=\s|$)|\n\s*\n")


def _prose(text: str) -> str:
    return _ASIDE.sub(" ", _FENCE.sub(" ", text))


def prose_words(text: str) -> list[str]:
    """The words of a text's prose in lower case."""
    return _WORD.findall(_prose(text).lower())


def lix(text: str) -> float | None:
    """Words of a sentence plus words of more than six letters in a hundred, of a text's prose; None without words."""
    sentences = [w for part in _STOP.split(_prose(text)) if (w := _WORD.findall(part))]
    words = [w for sentence in sentences for w in sentence]
    return len(words) / len(sentences) + 100 * sum(len(w) > 6 for w in words) / len(words) if words else None


@dataclass(frozen=True)
class LevelModel:
    """log P(word | level) and log P(level)."""

    words: dict[str, int]
    table: np.ndarray
    prior: np.ndarray

    def known(self, words: list[str]) -> list[int]:
        return [i for w in words if (i := self.words.get(w)) is not None]

    def scores(self, text: str, others: tuple[LevelModel, ...] = ()) -> np.ndarray | None:
        """The log posterior of each level up to a constant; None for a text without a known word.

        Of several models the one that knows most of the text's words decides, of equal ones the first.
        """
        words = prose_words(text)
        model, rows = self, self.known(words)
        for other in others:
            if len(rows) < len(words) and len(theirs := other.known(words)) > len(rows):
                model, rows = other, theirs
        return model.table[rows].sum(axis=0) + model.prior if rows else None


def fit(counts: dict[str, np.ndarray], labels: np.ndarray) -> LevelModel:
    """The model of word counts by level (arrays of LEVELS numbers) and of the number of labels of each level."""
    words = {w: i for i, w in enumerate(sorted(counts))}
    seen = np.array([counts[w] for w in words], dtype=float).reshape(len(words), LEVELS)
    overall = (seen.sum(axis=1) + 0.5) / (seen.sum() + 0.5 * max(len(words), 1))
    table = np.log((1 - SMOOTHING) * seen / np.maximum(seen.sum(axis=0), 1) + SMOOTHING * overall[:, None])
    return LevelModel(words, table, np.log((labels + 0.5) / (labels.sum() + 0.5 * LEVELS)))


def _marked(documents: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """doc_id, text, level, count of the documents of all labels, or of max_labels of them chosen by a hash."""
    marks = labels.where(F.col("level").between(1, LEVELS) & F.col("doc_id").isNotNull()).select("doc_id", "grader", "level")
    marks = marks.orderBy(F.xxhash64("doc_id", "grader"), "doc_id", "grader").limit(max_labels)
    # The marks are at most max_labels rows, so they go to the documents and only marked documents are moved.
    marked = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(marks.groupBy("doc_id", "level").count()), "doc_id")
    return marked.dropDuplicates(["doc_id", "level"])


def _fit_marked(marked: DataFrame) -> dict[str, LevelModel]:
    """The model of each language of marked (columns lang, text, level, count)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for lang, text, level, times in zip(batch["lang"], batch["text"], batch["level"], batch["count"]):
                total[(lang, "", int(level))] += int(times)
                for word, n in Counter(prose_words(text)).items():
                    total[(lang, word, int(level))] += n * int(times)
            yield pd.DataFrame([(*key, n) for key, n in total.items()], columns=["lang", "word", "level", "n"])

    per_level = marked.mapInPandas(count, "lang string, word string, level int, n long").groupBy("lang", "word").pivot("level", list(range(1, LEVELS + 1))).agg(F.sum("n")).na.fill(0)
    counts: dict[str, dict[str, np.ndarray]] = {}
    for lang, word, *n in per_level.toPandas().itertuples(index=False):
        counts.setdefault(lang, {})[word] = np.array(n, dtype=float)
    return {lang: fit({w: c for w, c in of.items() if w}, of.get("", np.zeros(LEVELS))) for lang, of in sorted(counts.items())}


def train(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> LevelModel:
    """The model of all labels, or of max_labels of them chosen by a hash. Each grader's label counts once."""
    models = _fit_marked(_marked(documents, labels, max_labels).withColumn("lang", F.lit("")))
    return models.get("", fit({}, np.zeros(LEVELS)))


def lix_of_levels(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> dict[int, float]:
    """The median LIX of the labelled documents of each level that has any."""

    @F.pandas_udf("double")
    def lix_of(texts: pd.Series) -> pd.Series:
        return texts.map(lix).astype("float64")

    rows = _marked(documents, labels, max_labels).select("level", lix_of("text").alias("lix")).where("lix IS NOT NULL")
    return {r.level: r.lix for r in rows.groupBy("level").agg(F.median("lix").alias("lix")).collect()}


def seed(documents: DataFrame, scale: dict[int, float], max_labels: int = MAX_LABELS) -> tuple[LevelModel, ...]:
    """A model for each lang of documents without labels, or of max_labels of them chosen by a hash: each has the level of the nearest LIX of scale."""
    if not scale:
        return ()

    @F.pandas_udf("int")
    def nearest(texts: pd.Series) -> pd.Series:
        values = texts.map(lix)
        return pd.Series([None if x is None or np.isnan(x) else min(sorted(scale), key=lambda k: abs(scale[k] - x)) for x in values], dtype="Int32")

    named = documents.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    chosen = named.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    marked = named.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    models = _fit_marked(marked.select("lang", "text", nearest("text").alias("level"), F.lit(1).alias("count")).where("level IS NOT NULL"))
    return tuple(models.values())


def estimate(df: DataFrame, model: LevelModel, text: str = "text", others: tuple[LevelModel, ...] = ()) -> DataFrame:
    """df with level (1 to 5) and level_margin, by how much its log posterior beats the next level's.

    Of several models, each text is judged by the one that knows most of its words.
    Both are null for a null text and for one without any known word of prose.
    """
    shared = df.sparkSession.sparkContext.broadcast((model, others))

    @F.pandas_udf("level int, level_margin double")
    def grade(texts: pd.Series) -> pd.DataFrame:
        levels, margins = [], []
        for t in texts:
            s = shared.value[0].scores(t, shared.value[1]) if t else None
            order = None if s is None else np.sort(s)
            levels.append(None if s is None else int(s.argmax()) + 1)
            margins.append(None if s is None else float(order[-1] - order[-2]))
        return pd.DataFrame({"level": pd.array(levels, dtype="Int32"), "level_margin": pd.array(margins, dtype="Float64")})

    rows = df.drop("level", "level_margin").withColumn("_grade", grade.asNondeterministic()(F.col(text)))
    return rows.select("*", "_grade.level", "_grade.level_margin").drop("_grade")
