import random

from lodewright.llm import reading
from lodewright.llm.tokens import encoding, token_count

BANKS = {k: [f"{c}{i}word" for i in range(60)] for k, c in enumerate(("ab", "cd", "ef", "gh", "ij"), start=1)}
SHARED = "the of and to in".split()


def text(r, level, n=60):
    words = [r.choice(SHARED) if r.random() < 0.4 else "".join(c for c in r.choice(BANKS[level]) if c.isalpha()) + "xyz"[r.randrange(3)] * (level) for _ in range(n)]
    return " ".join(words) + "."


def corpus(spark, n=300):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        level = 1 + i % 5
        body = text(r, level)
        if level == 5:
            body = "# " + text(r, 1, 8) + "\n\n" + body + " " + text(r, 2, 12) + "\n\n```\n" + text(r, 1, 90) + "\n```\n| " + text(r, 1, 40) + " |\n"
        docs.append((i, body, 9, "x"))
        if i % 2 == 0:
            for g in ("g1", "g2")[: 1 + (i % 4 == 0)]:
                labels.append((i, g, min(5, max(1, level + (r.random() < 0.1) - (r.random() < 0.1)))))
    docs += [(900, None, 9, "x"), (901, "", 9, "x"), (902, "# heading only\n\n```\ncode\n```", 9, "x"), (903, "?!", 9, None), (0, docs[0][1], 9, "x")]
    labels += [(None, "g1", 3), (5, None, 1), (0, "g1", None), (7, "g1", 9), (7777, "g1", 2)]
    return spark.createDataFrame(docs, "doc_id long, text string, level int, grader string"), spark.createDataFrame(labels, "doc_id long, grader string, level int")


def test_words_of_prose():
    assert reading.prose_words("# Head\n\nPlain don't μ-x.\n\n```py\ncode\n```\nAfter `inline` it\n| a | b |\n~~~\nopen fence") == ["plain", "don't", "μ-x", "after", "it"]


def test_held_out_levels(spark):
    docs, labels = corpus(spark)
    model = reading.train(docs, labels)
    got = {r.doc_id: r for r in reading.estimate(docs, model).collect()}
    held_out = [i for i in range(300) if i % 2]
    assert sum(got[i].level == 1 + i % 5 for i in held_out) >= 0.97 * len(held_out)
    assert all(got[i].level == 5 for i in held_out if i % 5 == 4)
    assert all(got[i].level is None and got[i].level_margin is None for i in (900, 901, 902, 903))
    assert got[0].grader == "x"


def test_bound_and_empty_tables(spark):
    docs, labels = corpus(spark, 60)
    model = reading.train(docs, labels, max_labels=10)
    marked = {r.text for r in reading._marked(docs, labels, 10).collect()}
    assert set(model.words) == {w for t in marked for w in reading.prose_words(t)} and 1 <= len(marked) <= 10
    empty = reading.train(docs.limit(0), labels.limit(0))
    assert {r.level for r in reading.estimate(docs, empty).collect()} == {None}
    assert reading.estimate(docs.limit(0), model).count() == 0


def test_token_counts(spark):
    rows = [("hello world <|endoftext|>",), ("",), (None,), ("é" * 20_000,), ("a b " * 20_000,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(token_count("t")).collect()]
    encode = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary
    assert got == [len(encode(t)) if t else 0 for (t,) in rows]


def test_lix():
    assert reading.lix("# Heading\n\nThe dog ran. It barked!\n\n```\nx y\n```") == 2.5
    assert reading.lix("Notwithstanding all. So be it.") == 5 / 2 + 100 / 5
    assert reading.lix("# Head") is None


def test_every_document_has_a_row(spark, monkeypatch):
    from lodewright.llm import queries

    plain, dense = "The dog ran. We cut the key. It is old.", "Notwithstanding idiosyncratic commensurability, the concomitant indeterminacy presupposes epistemological ramifications."
    easy, hard = "Die Liste ist neu. Wir lesen die Karte.", "Die Nachvollziehbarkeit der Entscheidungsgrundlagen unter Nebenläufigkeit ist entbehrlich, sofern Urheberschaftsanteile zuordenbar bleiben."
    rows = [(i, (plain, dense)[i % 2], "en", "s") for i in range(10)] + [(20 + i, (easy, hard)[i % 2], "de", "s") for i in range(8)]
    rows += [(40, hard, None, "s"), (41, None, "de", "s"), (42, "# x", "es", None), (43, plain, None, None)]
    whole = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, "g", (1, 5)[i % 2]) for i in range(4)], "doc_id long, grader string, level int")
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: {"documents": whole, "reading_labels": labels}[name])
    got = {r.doc_id: r.level for r in queries.p8_levels(spark, "").collect()}
    assert got == {r[0]: None if r[0] in (41, 42) else 5 if r[1] in (dense, hard) else 1 for r in rows}
    assert sum(r.documents for r in queries.p8_profile(spark, "").collect()) == len(rows)
    assert {r.doc_id for r in queries.p8_found(spark, "").collect()} == {1, 3, 5, 7, 9}
