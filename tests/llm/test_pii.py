import random
import re
from pathlib import Path

import pytest

from lodewright.llm import pii, train_pii


def kinds(text):
    return [(text[a:b], k) for a, b, k in pii.mentions(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Author: Noor Dunmore <noor+x@uni.example.edu>", [("Noor Dunmore", "person_name"), ("noor+x@uni.example.edu", "email")]),
        ("write to jo_hn [at] mail [dot] example please", [("jo_hn [at] mail [dot] example", "email")]),
        ("denied for a.b%40corp.example at step 3", [("a.b%40corp.example", "email")]),
        ("reach me at x.y@mail.example when done", [("x.y@mail.example", "email")]),
        ("mail ann at corp dot example", [("ann at corp dot example", "email")]),
        ("text me: +1-415-555-0193", [("+1-415-555-0193", "phone")]),
        ("on-call is 0044 1632 960196 until Friday", [("0044 1632 960196", "phone")]),
        ("call 312 555 0104 ext. 34 now", [("312 555 0104 ext. 34", "phone")]),
        ("the form has SSN 958-02-5137, remove it", [("958-02-5137", "id_number")]),
        ("found DNI 99188433-W again", [("99188433-W", "id_number")]),
        ("passport no. ZX0914693, made by hand", [("ZX0914693", "id_number")]),
        ("user QQ 84 52 42 A is here", [("QQ 84 52 42 A", "id_number")]),
        ("office moved to Flat 6, 34 Juniper Road, Fennville", [("Flat 6, 34 Juniper Road, Fennville", "street_address")]),
        ("she works from 5 bis, rue de la Grive, Lyon now", [("5 bis, rue de la Grive, Lyon", "street_address")]),
        ("Lindenallee 94, 00295 Fennham", [("Lindenallee 94, 00295 Fennham", "street_address")]),
        ("send it to Calle del Olmo Viejo 175, 5º A", [("Calle del Olmo Viejo 175, 5º A", "street_address")]),
        ("the seed user is called viktor gristelhollow", [("viktor gristelhollow", "person_name")]),
        ("TODO(Mr. Haskell): drop this", [("Mr. Haskell", "person_name")]),
        ("thanks, Moravec, Hiroko", [("Moravec, Hiroko", "person_name")]),
        ("Ilan Kestrel's branch breaks the build", [("Ilan Kestrel", "person_name")]),
    ],
)
def test_mentions(text, expected):
    assert kinds(text) == expected


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "git@git.hub.example:cache/filter.git", "bump @scope/core@0.6.8 and fluxpad@4.2.7", "GET 10.168.55.217:6688/health -> 200 in 12 ms", "Trace 74787-79-74401 covers it",
        "Port map 20.79.0766 replaces 17.346.6219", "build 5339056-14", "run id c8851f0d-1234-4424-8040-6fdb1b6bdfe9", "renamed in 4823750192.", "2024-01-08T04:15:22.442027Z",
        "Merge Request template and Bus Factor for Quick Sort", "Tarjan Order and Git History agree", "The walker saw 52 Drive errors and 25 Close calls in a row", "raised TimeoutError I think",
        "TODO at line 9 in parse/a.ts street map loader", "@dataclass on x hides it", "until Friday Pinned it", "Lane 34 of the pipeline", "a" * 50_000, "1" * 50_000, "A. " * 5_000,
    ],
)
def test_nothing_personal(text):
    assert kinds(text) == []


def held_out(name):
    """(text, mentions) of each line of a file of texts written apart from the training frames."""
    for line in Path(__file__).with_name(name).read_text().splitlines():
        text, gold, pos = "", set(), 0
        for m in re.finditer(r"\[\[(\w+)\|(.*?)\]\]", line):
            text += line[pos : m.start()]
            gold.add((len(text), len(text) + len(m[2]), m[1]))
            text, pos = text + m[2], m.end()
        yield text + line[pos:], gold


def accuracy(texts):
    right = said = true = 0
    for text, gold in texts:
        got = set(pii.mentions(text))
        right, said, true = right + len(got & gold), said + len(got), true + len(gold)
    return right / said, right / true


# The first file was read while the candidates were widened, the second was measured once, afterwards.
@pytest.mark.parametrize("name", ["pii_heldout.txt", "pii_heldout_b.txt"])
def test_texts_of_other_wording(name):
    precision, recall = accuracy(held_out(name))
    assert precision >= 0.9 and recall >= 0.9


def test_held_out_accuracy():
    """On further texts of the training grammar, half of whose numbers and names are made to be mistaken."""
    r = random.Random(123)
    precision, recall = accuracy((text, {(a, b, pii.TYPES[t]) for a, b, t in gold}) for text, gold in (train_pii.invent(r) for _ in range(800)))
    assert precision > 0.95 and recall > 0.93


def best_by_enumeration(found, w):
    """The best score of all sets of candidates without overlaps, with transitions."""
    best = 0.0
    for mask in range(1 << len(found)):
        chosen = sorted((found[i] for i in range(len(found)) if mask >> i & 1), key=lambda c: c[1])
        if all(x[1] <= y[0] for x, y in zip(chosen, chosen[1:])):
            best = max(best, score_of(chosen, w))
    return best


def score_of(chosen, w):
    last, total = len(pii.TYPES), 0.0
    for _, _, t, score in chosen:
        total, last = total + score + w.get(pii.transition(last, t), 0.0), t
    return total


def test_decoding_is_the_best_segmentation():
    """Against all sets of candidates without overlaps."""
    r, compared = random.Random(5), 0
    w = {k: v + r.uniform(-1.5, 1.5) for k, v in pii.weights().items()}
    for _ in range(250):
        text, _gold = train_pii.invent(r)
        found = [(a, b, t, sum(w.get(x, 0) for x in f)) for a, b, t, f in pii.candidates(text)]
        if len(found) <= 10:
            index = {(a, b, pii.TYPES[t]): (a, b, t, s) for a, b, t, s in found}
            assert score_of([index[m] for m in pii.mentions(text, w)], w) == pytest.approx(best_by_enumeration(found, w))
            compared += 1
    assert compared > 60


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("mailto:ann.lee@corp.example", "mailto:[EMAIL]"),
        ("P.O. Box 123", "P.O. Box 123"),
        ("IBAN DE89 3704 0044 0532 0130 00", "IBAN DE89 3704 0044 0532 0130 00"),
        ("Sincerely, Nguyen", "Sincerely, Nguyen"),
        ("aadhaar 1234 5678 9012", "aadhaar [ID_NUMBER]"),
        ("CPF 123.456.789-09", "CPF [ID_NUMBER]"),
        ("via Roma 12, Milano", "[STREET_ADDRESS]"),
        ("Kerkstraat 12", "[STREET_ADDRESS]"),
        ("ul. Marszałkowska 10", "[STREET_ADDRESS]"),
        ("负责人：王伟，电话", "负责人：[PERSON_NAME]，电话"),
        ("written by J.R. Hawthorne", "written by [PERSON_NAME]"),
    ],
)
def test_other_scripts_and_kinds(text, masked):
    assert pii.redact_text(text) == masked


def test_partition_function_against_enumeration():
    import numpy as np

    spans, scores = [(0, 3, 0), (2, 5, 1), (4, 6, 0), (0, 6, 2)], np.array([0.3, 1.2, -0.4, 0.9])
    none = len(pii.TYPES)
    step = np.random.default_rng(1).normal(size=(none + 1, none))
    total, marginal, moves = 0.0, np.zeros(4), np.zeros_like(step)
    for mask in range(16):
        chosen = sorted((i for i in range(4) if mask >> i & 1), key=lambda i: spans[i][1])
        if all(spans[x][1] <= spans[y][0] for x, y in zip(chosen, chosen[1:])):
            taken = list(zip([none, *(spans[i][2] for i in chosen)], [spans[i][2] for i in chosen]))
            weight = np.exp(scores[chosen].sum() + sum(step[m] for m in taken))
            total += weight
            marginal[chosen] += weight
            for m in taken:
                moves[m] += weight
    order = sorted(range(4), key=lambda i: (spans[i][1], spans[i][0]))
    log_z, got, steps = train_pii._expected([spans[i] for i in order], scores[order], step)
    assert log_z == pytest.approx(np.log(total)) and got == pytest.approx((marginal / total)[order]) and steps == pytest.approx(moves / total)


def test_operators(spark):
    text = "Author: Noor Dunmore <noor@uni.example>"
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing here", None), (None, "call +1-415-555-0193", "x")]
    df = spark.createDataFrame(rows, "id long, body string, pii_type string")
    found = pii.find_mentions(df, "id", "body").collect()
    assert sorted((r.id or 0, r.pii_type) for r in found) == [(0, "phone")] + [(1, "email")] * 2 + [(1, "person_name")] * 2
    assert {text[r.start : r.start + r.length] for r in found if r.id == 1} == {"Noor Dunmore", "noor@uni.example"}
    masked = {(r.id, r.body, r.pii_type) for r in pii.redact(df, "body").collect()}
    assert (1, "Author: [PERSON_NAME] <[EMAIL]>", "x") in masked and (2, None, "x") in masked and (4, "nothing here", None) in masked
    assert pii.find_mentions(df.limit(0), "id", "body").count() == 0


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("please ask Mark Hill about it", [("Mark Hill", "person_name")]),
        ("thanks, Otto van der Meer", [("Otto van der Meer", "person_name")]),
        ("Иван Петров wrote this", [("Иван Петров", "person_name")]),
        ("Reviewed by Ḿira Ḱestrelsen", [("Ḿira Ḱestrelsen", "person_name")]),
        ("mail JANE AT CORP DOT COM now", [("JANE AT CORP DOT COM", "email")]),
        ("office at 12345 Juniper Road, Fennville", [("12345 Juniper Road, Fennville", "street_address")]),
    ],
)
def test_mentions_are_left_to_the_weights(text, expected):
    assert kinds(text) == expected
