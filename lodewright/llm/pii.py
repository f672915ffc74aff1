"""Personal information in free text: a semi-Markov conditional random field over whole spans.

A text is a sequence of segments, each outside or one whole mention. Candidate mentions are proposed
generously, with every plausible pair of boundaries; their length is bounded. Features look at a candidate as a
whole: its shape, the words in it, what stands before and after; transitions weigh which type of mention follows which.
Dynamic programming over the candidates and the type of the last mention then chooses boundaries and types
together. The weights are trained by maximum likelihood on invented texts (train_pii.py) and kept beside this file.
"""

from __future__ import annotations

import json
import pkgutil
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.llm import pii_lexicon as lex

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
#: The longest mention, in characters; the length that bounds the dynamic programming. The longest valid e-mail address has 320.
LONGEST = 320
#: The most words of a name and the most groups of a telephone number.
NAME_WORDS, PHONE_GROUPS = 8, 9

_UPPER = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Lu")
_CAP = rf"[{_UPPER}](?:[^\W\d_]|['’](?=[^\W\d_]))*(?:-[^\W\d_]+)*(?![\d_])"
_LOW = r"[^\W\d_]+(?:-[^\W\d_]+)*"
_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")


def _plain(word: str) -> str:
    """A word in lower case without accents."""
    word = word.lower()
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word.replace("ł", "l").replace("ø", "o")) if not unicodedata.combining(c))


# ---- what stands around a span


def _before(text: str, start: int) -> tuple[str, str]:
    """The character before start and the word before that."""
    if start == 0:
        return "^", ""
    left = text[max(0, start - 40) : start]
    words = _WORD.findall(left)
    return left[-1], _plain(words[-1]) if words else ""


def _after(text: str, end: int) -> tuple[str, str]:
    if end >= len(text):
        return "$", ""
    right = text[end : end + 24]
    m = _WORD.search(right)
    return right[0], _plain(m.group()) if m else ""


def _sort_of(char: str) -> str:
    if char in "^$\n":
        return "edge"
    if char == " " or char == "\t":
        return "space"
    return char if char in "@/\\_-.:=<>()\"';,|[]{}#%+" else "letter" if char.isalnum() else "mark"


# ---- candidates: (start, end, type, features)

_LABELS = r"[\w-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[\w-]+)+"
_EMAIL = re.compile(rf"(?<![\w.+%-])(?P<local>[\w.+-]+)(?P<at>@|%40|＠| ?[(\[{{]at[)\]}}] ?)(?P<host>{_LABELS})", re.IGNORECASE)
_SPELLED = re.compile(r"(?<![\w.+%-])(?P<local>[\w.+-]+)(?P<at> at )(?P<host>[\w-]+(?: dot [\w-]+)+)", re.IGNORECASE)
_AT = re.compile(r"@|%40|＠|[(\[{]at[)\]}]", re.IGNORECASE)


def _emails(text: str) -> Iterator[tuple]:
    found = [*_EMAIL.finditer(text)] if _AT.search(text) else []
    if " dot " in text.lower():
        found += _SPELLED.finditer(text)
    for m in found:
        local, at, host = m.group("local", "at", "host")
        labels = [x for x in re.split(r"[.\s()\[\]]+|\bdot\b", host.lower()) if x]
        left, _ = _before(text, m.start())
        right, _ = _after(text, m.end())
        f = ["email", "email:tld" if labels[-1].isalpha() and len(labels[-1]) > 1 else "email:no-tld", f"email:left{_sort_of(left)}", f"email:right{_sort_of(right)}"]
        f.append("email:sign" if at == "@" else "email:spelled" if at.lower() == " at " else "email:disguised")
        if any(x.isdigit() for x in labels):
            f.append("email:number-host")
        if local.lower() in ("git", "ssh", "hg", "svn", "root", "www"):
            f.append("email:service-user")
        if right == ":" and re.match(r":[\w~/]", text[m.end() : m.end() + 2]):
            f.append("email:path-follows")
        if text[max(0, m.start() - 3) : m.start()] == "://":
            f.append("email:in-url")
        yield m.start(), m.end(), 0, f


_MANY_DIGITS = re.compile(r"[0-9](?:[ ./()\-]{0,2}[0-9]){5}")
_DIGITS = re.compile(r"[0-9]+")
_NUMBER_RUN = re.compile(r"(?:tel:)?(?:\+|\(\+?)?[0-9]+(?:(?:[ .\-/]|\)[ ]?|[ ]\(|-\(|\) ?-?)[0-9]+)*(?:[ ,]{0,2}(?:ext\.?|x|#) ?[0-9]{1,5})?")
_EXTENSION = re.compile(r"[ ,]{0,2}(?:ext\.?|x|#) ?[0-9]{1,5}$")


def _signature(body: str) -> str:
    """Lengths of the digit groups and what separates them."""
    return re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 9)), body)


@cache
def _phone_shape(signature: str) -> tuple[str, ...]:
    out = []
    if signature.startswith(("+", "(+")):
        out.append("phone:plus")
    if re.match(r"\(", signature):
        out.append("phone:area-in-brackets")
    if re.fullmatch(r"(\+?1[ .\-])?\(?3\)?[ .\-]?3[ .\-]4", signature):
        out.append("phone:nanp")
    if re.search(r"\d/\d", signature):
        out.append("phone:slash")
    groups = re.findall(r"\d", signature)
    out.append(f"phone:as-{signature}")
    out.append(f"phone:groups{min(len(groups), 6)}")
    if len(set(re.findall(r"[^\d+()]+", signature))) > 2:
        out.append("phone:mixed-marks")
    if re.fullmatch(r"3[- ]2[- ]4", signature):
        out.append("phone:ssn-like")
    if re.fullmatch(r"[1-3](\.[1-3]){3}", signature):
        out.append("phone:ip-like")
    return tuple(out)


_CODED = re.compile(r"(?:[^\W\d_]+[0-9]|[0-9]+[^\W\d_])[^\W_]*[ .-]\Z")
_GLUED_LEFT, _GLUED_RIGHT = re.compile(r"[^\W_]-?\Z"), re.compile(r"-?[^\W\d_]")


def _phones(text: str) -> Iterator[tuple]:
    for run in _NUMBER_RUN.finditer(text):
        whole = run.group()
        if len(whole) < 7:
            continue
        ext = _EXTENSION.search(whole)
        body_end = run.end() - (ext.end() - ext.start() if ext else 0)
        groups = [m.span() for m in _DIGITS.finditer(text, run.start(), body_end)]
        lead = groups[0][0] - run.start()
        for i in range(len(groups)):
            for j in range(i, min(len(groups), i + PHONE_GROUPS)):
                count = sum(b - a for a, b in groups[i : j + 1])
                if not 7 <= count <= 15:
                    continue
                start = groups[i][0] - (lead if i == 0 else 1 if text[groups[i][0] - 1] in "(+" else 0)
                end = groups[j][1]
                last = j == len(groups) - 1
                if last:
                    end = run.end()
                digits = text[groups[i][0] : groups[i][1]]
                body = text[start : groups[j][1]].removeprefix("tel:")
                if _GLUED_LEFT.search(text, max(0, start - 2), start) or _GLUED_RIGHT.match(text, end):
                    continue
                left, word = _before(text, start)
                right, _ = _after(text, end)
                f = ["phone", f"phone:digits{count}", f"phone:left{_sort_of(left)}", f"phone:right{_sort_of(right)}", *_phone_shape(_signature(body))]
                if i == j and "+" not in body:
                    f.append("phone:bare")
                if digits[0] == "0":
                    f.append("phone:trunk00" if digits.startswith("00") else "phone:trunk0")
                if text[start : start + 4] == "tel:":
                    f.append("phone:tel")
                if last and ext:
                    f.append("phone:ext")
                if _CODED.search(text, max(0, start - 30), start):
                    f.append("phone:code-before")
                if i > 0:
                    f.append("phone:cut-left")
                if not last:
                    f.append("phone:cut-right")
                f.append("phone:cue" if word in lex.PHONE_CUES else "phone:id-cue" if word in lex.ID_CUES else "phone:number-cue" if word in lex.NUMBER_CUES else "phone:no-cue")
                yield start, end, 1, f


_ID_RUN = re.compile(
    r"(?<![A-Za-z0-9@_.-])(?:[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]|[A-Z]{4}[0-9]{6}[A-Z]{6}[0-9A-Z][0-9]|[A-Z]{1,3}(?:[ ./\-]?[0-9]+)+(?:[ \-]?[A-Z]\b)?|[0-9]+(?:[ ./\-][0-9]+)*(?:[ \-]?[A-Z]\b)?)(?!-?[A-Za-z0-9_])"
)
_LETTERED = re.compile(r"[A-Z]{4}[0-9]{6}[A-Z]|[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}")
_ID_SHAPES = {
    "3-2-4": "ssn", "3 2 4": "ssn", "AA 2 2 2 A": "nino", "AA6A": "nino", "2 3 3 3": "steuer", "8-A": "dni", "8A": "dni", "A7A": "nie", "A7-A": "nie", "A-7-A": "nie",
    "A7": "passport", "A8": "passport", "AA7": "passport", "AA8": "passport", "AA6": "passport", "AA-4-3": "licence", "6-4": "national", "8-4": "national", "9": "nine", "11": "eleven", "4 4 4": "four-four-four", "3.3.3-2": "cpf",
    "AAAAAA2A2A3A": "fiscale", "AAAA6AAAAAA2": "curp", "AAAA6AAAAAAA1": "curp", "1 2 2 2 3 3 2": "nir", "3-3-3": "three-threes", "3 3 3": "three-threes", "3 3 4": "nhs",
}
_CLAUSE = re.compile(r"[;,()\n\"|]|(?<!\bno)\. ")


def _ids(text: str) -> Iterator[tuple]:
    for m in _ID_RUN.finditer(text):
        start, end = m.span()
        prefix = re.match(r"[A-Z]{2,3}[ \-]", m.group())
        if prefix and prefix.group()[:-1].lower() in lex.ID_CUES:
            start += prefix.end()
        ends = [end, end - 2] if text[end - 1].isalpha() and text[end - 2] == " " else [end]
        left, word = _before(text, start)
        clause = _CLAUSE.split(text[max(0, start - 34) : start])[-1]
        label = "label" if any(_plain(w) in lex.ID_CUES for w in _WORD.findall(clause)[-4:]) else "no-label"
        for end in ends:
            body = text[start:end]
            if not 6 <= sum(c.isdigit() for c in body) <= 15:
                continue
            shape = _ID_SHAPES.get(re.sub(r"[A-Z]", "A", re.sub(r"[0-9]+", lambda d: str(len(d.group())), body)), "other")
            right, _ = _after(text, end)
            f = ["id", f"id:{shape}", f"id:left{_sort_of(left)}", f"id:right{_sort_of(right)}", f"id:{label}", f"id:{shape}:{label}"]
            if word in lex.NUMBER_CUES:
                f.append("id:number-cue")
            if word in lex.PHONE_CUES:
                f.append("id:phone-cue")
            yield start, end, 2, f


_TYPE = "|".join(sorted(lex.STREET_TYPES, key=len, reverse=True))
_UNIT = re.compile(r"(?:flat|apt|unit|suite) [0-9]{1,3}[a-z]?, $", re.IGNORECASE)
_HOUSE = re.compile(r"(?<![\w./:-])[0-9]{1,5}[a-zA-Z]?(?=,? |,? ?(?:bis|ter) )")
_NUMBER_FIRST = re.compile(
    rf"[0-9]{{1,5}}[a-z]?,? (?P<body>{_LOW}(?: {_LOW}){{0,2}}?) (?P<kind>{_TYPE})(?![\w/.-]*\w)(?:, (?:apt|flat|unit) [0-9]{{1,3}}[a-z]?)?", re.IGNORECASE
)
_FRENCH = re.compile(
    rf"[0-9]{{1,5}}(?: bis| ter)?,? (?P<kind>(?i:rue|avenue|place|boulevard|chemin|impasse|quai|allée))(?P<body> (?:(?:de|du|des|la|le|les|d'|l')\s?)*{_LOW}(?: {_CAP})*)"
)
# What streets end in (German, Dutch, Scandinavian) and begin with (Spanish, Portuguese, Italian, French, Polish, Russian, German).
_STREET_ENDS = "stra(?:ß|ss)e|str\\.|weg|allee|gasse|platz|ring|damm|ufer|steig|straat|laan|gracht|plein|kade|dijk|gatan|vägen|gata|veien|vej|gade|katu|tie"
_STREET_HEADS = "calle|avenida|avda\\.|av\\.|plaza|paseo|camino|ronda|c/|carrer|rua|praça|travessa|via|viale|piazza|corso|vicolo|largo|strada|rue|avenue|boulevard|chemin|quai|ul\\.|ulica|al\\.|aleja|os\\.|pl\\.|ул\\.|улица|пр\\.|проспект|пер\\.|jalan|jl\\."
_NAME_FIRST = re.compile(
    rf"(?<![\w/])(?P<kind>{_LOW}(?:{_STREET_ENDS})|{_LOW} (?:stra(?:ß|ss)e|weg|allee|platz)|(?:{_STREET_HEADS})(?: (?:de|del|della|delle|dei|di|da|do|dos|das|du|des|la|las|los|el|le))*(?: ?{_LOW}){{1,4}}|\b(?:am|im|zum|zur|an der|auf dem|unter den) {_LOW}(?: {_LOW})?)"
    r",? (?:n[ºo°.]\s?)?[0-9]{1,5}[a-z]?\b(?:/[0-9]{1,4}\b)?(?:, ?[0-9]{1,2}[ºª°]\s?[a-z]?)?",
    re.IGNORECASE,
)
_POSTCODE = r"(?:[0-9]{2}-[0-9]{3} |[0-9]{4,5}(?: [A-Z]{2})? )?"
_TOWN_AFTER = re.compile(rf", {_POSTCODE}{_CAP}"), re.compile(rf", {_POSTCODE}{_CAP} {_CAP}")


# One of these is in every match of the pattern, in lower case.
_NAMED_FIRST = (
    *(f"{end}{mark}" for end in ("straße", "strasse", "str.", "weg", "allee", "gasse", "platz", "ring", "damm", "ufer", "steig", "straat", "laan", "gracht", "plein", "kade", "dijk", "gatan", "vägen", "gata", "veien", "vej", "gade", "katu", "tie") for mark in (" ", ",")),
    *("calle ", "avenida ", "avda", "av.", "plaza ", "paseo ", "camino ", "ronda ", "c/", "carrer ", "rua ", "praça ", "travessa ", "via ", "viale ", "piazza ", "corso ", "vicolo ", "largo ", "strada ", "rue ", "avenue ", "boulevard ", "chemin ", "quai ", "ul.", "ulica ", "al.", "aleja ", "os.", "pl.", "ул", "пр", "пер.", "jalan ", "jl.", "am ", "im ", "zum ", "zur ", "an der ", "auf dem ", "unter den "),
)


def _places(text: str) -> Iterator[tuple[str, re.Match, int]]:
    """(family, match, start) of what looks like house number and street."""
    for house in _HOUSE.finditer(text):
        for family, pattern in (("number-first", _NUMBER_FIRST), ("french", _FRENCH)):
            if m := pattern.match(text, house.start()):
                unit = _UNIT.search(text, max(0, m.start() - 16), m.start())
                yield family, m, unit.start() if unit else m.start()
    low = text.lower()
    if any(x in low for x in _NAMED_FIRST):
        for m in _NAME_FIRST.finditer(text):
            yield "name-first", m, m.start()


def _addresses(text: str, vocabulary: lex.Vocabulary) -> Iterator[tuple]:
    for family, m, start in _places(text):
        kind = m.group("kind")
        body = _WORD.findall(m.groupdict().get("body") or kind)
        plain = [_plain(w) for w in body]
        ordinary = sum(map(vocabulary.ordinary, plain))
        left, word = _before(text, start)
        caps = all(w[0].isupper() for w in body if len(w) > 3) if body else False
        base = ["addr", f"addr:{family}", "addr:caps" if caps else "addr:lower", f"addr:ordinary{min(ordinary, 2)}of{min(len(plain), 3)}"]
        base.append("addr:cue" if word in lex.ADDRESS_CUES else "addr:number-cue" if word in lex.NUMBER_CUES else "addr:no-cue")
        base.append(f"addr:left{_sort_of(left)}")
        if family == "number-first":
            base.append("addr:kind-cap" if kind[0].isupper() else "addr:kind-lower")
        ends = [m.end()]
        ends += [town.end() for pattern in _TOWN_AFTER if (town := pattern.match(text, m.end()))]
        for n, end in enumerate(ends):
            right, _ = _after(text, end)
            f = [*base, f"addr:right{_sort_of(right)}"]
            f.append(f"addr:town{n}" if n else "addr:town-left-out" if len(ends) > 1 else "addr:no-town")
            yield start, end, 3, f


_NAME_TOKEN = rf"(?:(?:[{_UPPER}]\.){{2,3}}(?![^\W_])|{_CAP}\.?)"
#: Lower-case words inside a surname.
_PARTICLES = "(?:(?:van|von|vom|zu|zur|zum|den|der|de|del|della|di|da|das|dos|du|la|le|las|los|ten|ter|bin|ibn|al|af|av) ){1,3}"
_NAME_RUN = re.compile(rf"(?<![\w@\\/$#])(?<!\w\.){_NAME_TOKEN}(?:(?: |, )(?:{_PARTICLES})?{_NAME_TOKEN})+")
# The same for texts of ASCII only, where the class of capitals is small and quick.
_PLAIN_RUN, _PLAIN_PART = (re.compile(x.replace(f"[{_UPPER}]", "[A-Z]")) for x in (_NAME_RUN.pattern, _NAME_TOKEN))
_CAMEL = re.compile(r"(?<!\bMac)(?<=[a-z]{2})[A-Z]")
_NAME_PART = re.compile(_NAME_TOKEN)
DIGITS = "0123456789"
_LOWER_WORD = re.compile(r"[^\W\d_]+")
_LOWER_AFTER = re.compile(r"\.? (?:[^\W\d_]\. )?[^\W\d_]{2,}(?:-[^\W\d_]+)?(?![\w@/\\(]|[.-]\w)")
_LOWER_BEFORE = re.compile(r"(?<![\w@\\/$#.+-])[^\W\d_]{3,}(?:-[^\W\d_]+)?, $")


_EMAIL_NEAR = re.compile(r"[ \t]*[<(\[,;|]?[ \t]*(?:mailto:)?[\w.+-]+@")


def _loose_end(word: str) -> int:
    """How many characters at the end of a name's last word belong to the sentence: a full stop, a possessive."""
    if word.endswith(".") and len(word) > 2:
        return 1
    return 2 if re.search(r"['’]s$", word, re.IGNORECASE) else 0


def _name_features(text: str, parts: list[tuple[int, int]], first: bool, last: bool, vocabulary: lex.Vocabulary) -> list[str] | None:
    """The features of a run of parts as a person's name; None if it cannot be one."""
    start, end = parts[0][0], parts[-1][1]
    raw = [text[a:b] for a, b in parts]
    words = [_plain(w.rstrip(".")) for w in raw]
    title = words[0] in lex.TITLES
    rest, rest_raw = (words[1:], raw[1:]) if title else (words, raw)
    short = lambda w: len(w) == 1 or "." in w  # an initial, or several written together
    if not rest or all(map(short, rest)):
        return None
    full = [w for w in rest if not short(w)]
    initials = len(rest) - len(full)
    if len(full) < 2 and not (title or initials) or any(w in lex.TITLES for w in rest):
        return None
    if any(r.endswith(".") and not short(w) for r, w in zip(rest_raw[:-1], rest[:-1])) or any(len(r) == 1 or _CAMEL.search(r) for r in rest_raw):
        return None
    ordinary = sum(any(map(vocabulary.ordinary, w.split("-"))) for w in full)
    commas = [i for i in range(len(parts) - 1) if "," in text[parts[i][1] : parts[i + 1][0]]]
    if len(commas) > 1 or (commas and (title or commas[0] != 0 or len(rest) > 3)):
        return None
    end -= _loose_end(raw[-1])
    given, surname = (rest[1], rest[0]) if commas else (rest[0], rest[-1])
    pieces = surname.split("-")
    left, before = _before(text, start)
    right, after = _after(text, end)
    known = given.split("-")[0] in lex.GIVEN
    f = ["name", f"name:full{min(len(full), 3)}", f"name:left{_sort_of(left)}", f"name:right{_sort_of(right)}"]
    f.append("name:given" if known else "name:title" if title else "name:initial" if initials else "name:unknown-given")
    f.append("name:ordinary-all" if ordinary == len(full) else "name:ordinary-some" if ordinary else "name:ordinary-none")
    of_surname = vocabulary.sort_of(pieces[0])
    of_given = "title" if title and len(rest) == 1 else "initial" if short(given) else vocabulary.sort_of(given.split("-")[0])
    f.append(f"name:surname-{of_surname}")
    f.append(f"name:{of_given}+{of_surname}")
    f.append("name:surname-long" if len(pieces[0]) > 5 else "name:surname-short")
    f.append(f"name:comma-{of_given}+{of_surname}" if commas else "name:plain")
    f += [f"name:has-{x}" for x in {vocabulary.sort_of(w.split("-")[0]) for w in full}]
    if title:
        f.append("name:has-title")
    if initials:
        f.append("name:has-initial")
    if any(len(text[a[1] : b[0]]) > 2 for a, b in zip(parts, parts[1:])):
        f.append("name:particle")
    if "-" in surname:
        f.append("name:hyphen")
    shapes = {r.rstrip(".").isupper() for r, w in zip(rest_raw, rest) if not short(w)}
    lower = raw[-1][0].islower()
    f.append("name:lower" if lower else "name:all-caps" if shapes == {True} else "name:mixed-caps" if len(shapes) > 1 else "name:cased")
    if lower:
        f.append("name:lower-given" if known else "name:lower-unknown")
        f += [f"name:lower-left{_sort_of(left)}", f"name:lower-{of_given}+{of_surname}", f"name:lower-surname-{of_surname}", f"name:lower-{'cue' if before in lex.NAME_CUES else 'no-cue'}-{of_surname}"]
    f.append("name:cue" if before in lex.NAME_CUES else "name:no-cue")
    f.append("name:verb-follows" if after in lex.NAME_FOLLOWS else "name:no-verb")
    if before == "the" or before == "a" or before == "an":
        f.append("name:article")
    if re.match(r" [0-9]", text[end : end + 2]):
        f.append("name:number-follows")
    if _EMAIL_NEAR.match(text, end):
        f.append("name:email-follows")
    if not first:
        f.append("name:cut-left")
    if not last:
        f.append("name:cut-right")
    return f


@lru_cache(maxsize=1 << 16)
def _leads(vocabulary: lex.Vocabulary, word: str) -> int:
    """Whether a word in lower case may begin a name: 2 for given names and titles, 1 for other uncommon words, else 0."""
    plain = _plain(word)
    return 0 if len(word) < 2 or not word.islower() else 2 if plain in lex.LEADS else 0 if vocabulary.ordinary(plain) else 1


def _asked_for(text: str, start: int) -> bool:
    char, word = _before(text, start)
    return char in "=:(\"'[<;>|" or word in lex.NAME_CUES


def _names(text: str, vocabulary: lex.Vocabulary) -> Iterator[tuple]:
    runs, part = (_PLAIN_RUN, _PLAIN_PART) if text.isascii() else (_NAME_RUN, _NAME_PART)
    for run in runs.finditer(text):
        parts = [m.span() for m in part.finditer(text, run.start(), run.end())]
        n = len(parts)
        for i in range(n - 1):
            for j in range(i + 1, min(n, i + NAME_WORDS)):
                if f := _name_features(text, parts[i : j + 1], i == 0, j == n - 1, vocabulary):
                    end = parts[j][1]
                    yield parts[i][0], end - _loose_end(text[parts[j][0] : end]), 4, f
    leading = {x: known for x in set(_LOWER_WORD.findall(text)) if (known := _leads(vocabulary, x))}
    if not leading:
        return
    for m in _LOWER_WORD.finditer(text):
        lead = m.group()
        known = leading.get(lead)
        if not known or (m.start() and text[m.start() - 1] in "@\\/$#.+-_'’" + DIGITS):
            continue
        options = []
        # two lower-case words say little by themselves; where the first is no given name, something before them must ask for a name
        if (known == 2 or _asked_for(text, m.start())) and (after := _LOWER_AFTER.match(text, m.end())):
            parts = [m.span(), *(x.span() for x in re.finditer(r"[^\W\d_]+(?:-[^\W\d_]+)*\.?", text[: after.end()][m.end() :]))]
            options.append([(m.start(), m.end() + (text[m.end()] == ".")), *((a + m.end(), b + m.end()) for a, b in parts[1:])])
        if known == 2 and (before := _LOWER_BEFORE.search(text, max(0, m.start() - 40), m.start())):
            options.append([(before.start(), before.end() - 2), m.span()])
        for parts in options:
            words = [_plain(text[a:b].rstrip(".")) for a, b in parts]
            surname = words[0] if text[parts[0][1]] == "," else words[-1]
            if not text[parts[0][0] : parts[-1][1]].islower() or len(surname) < 4:
                continue
            if lead in lex.TITLES and text[m.end() : m.end() + 1] != "." or known == 1 and vocabulary.ordinary(surname):
                continue
            if f := _name_features(text, parts, True, True, vocabulary):
                end = parts[-1][1]
                yield parts[0][0], end - _loose_end(text[parts[-1][0] : end]), 4, f


_HAN = "\u3400-\u9fff々"
_HAN_NAME = re.compile(rf"(?=(?P<surname>{'|'.join(lex.JAPANESE_SURNAMES)}|[{lex.HAN_SURNAMES}])(?P<rest>[ 　·]?[{_HAN}\u3041-\u30ff]{{1,3}}))")
_HANGUL_NAME = re.compile(rf"(?<![\w])(?P<surname>[{lex.HANGUL_SURNAMES}])(?P<rest>[\uac00-\ud7a3]{{1,2}})")
_EAST = re.compile("[\u3400-\u9fff\uac00-\ud7a3]")


def _eastern_names(text: str) -> Iterator[tuple]:
    """Names written without blanks: a known surname and up to three more characters."""
    for pattern, script in ((_HAN_NAME, "han"), (_HANGUL_NAME, "hangul")):
        for m in pattern.finditer(text):
            surname, rest = m.group("surname"), m.group("rest")
            start = m.start("surname")
            left = text[start - 1] if start else "^"
            for n in range(1, len(rest.lstrip(" 　·")) + 1):
                end = m.end("surname") + len(rest) - len(rest.lstrip(" 　·")) + n
                right = text[end : end + 1] or "$"
                honoured = any(text.startswith(h, end) for h in lex.HONORIFICS)
                f = ["name", f"name:{script}", f"name:{script}{n}", f"name:{script}-surname{len(surname)}"]
                f.append(f"name:{script}-left-{'cue' if left in lex.HAN_CUES else 'han' if _EAST.match(left) else 'edge'}")
                f.append(f"name:{script}-right-{'honorific' if honoured else 'han' if _EAST.match(right) else 'edge'}")
                yield start, end, 4, f


def candidates(text: str, vocabulary: lex.Vocabulary | None = None) -> list[tuple]:
    """All candidate mentions of a text with their features, by their ends."""
    vocabulary = lex.vocabulary() if vocabulary is None else vocabulary
    found = [*_emails(text), *_names(text, vocabulary)]
    if not text.isascii() and _EAST.search(text):
        found += _eastern_names(text)
    if _DIGITS.search(text):
        found += _addresses(text, vocabulary)
        many = _MANY_DIGITS.search(text)
        if many:
            found += _phones(text)
        if many or _LETTERED.search(text):
            found += _ids(text)
    return sorted((c for c in found if c[1] - c[0] <= LONGEST), key=lambda c: (c[1], c[0], c[2]))


@cache
def weights() -> dict[str, float]:
    return json.loads(pkgutil.get_data(__package__, "pii_weights.json"))


def transition(last: int, kind: int) -> str:
    """The feature of a mention that follows one of type last, or is the first (last is the number of types)."""
    return f"after:{TYPES[last] if last < len(TYPES) else 'none'}>{TYPES[kind]}"


_STEPS: list[tuple] = []


def _steps(w: dict[str, float]) -> tuple[list[list[float]], float]:
    """The weights of transitions, and the least score at which transitions may still lift a candidate above nothing."""
    if not _STEPS or _STEPS[0][0] is not w:
        step = [[w.get(transition(a, b), 0.0) for b in range(len(TYPES))] for a in range(len(TYPES) + 1)]
        _STEPS[:] = [(w, step, -2 * max(0.0, *(max(row) for row in step)))]
    return _STEPS[0][1:]


def mentions(text: str, w: dict[str, float] | None = None, vocabulary: lex.Vocabulary | None = None) -> list[tuple[int, int, str]]:
    """The most likely segmentation's mentions: (start, end, type), in order and without overlaps."""
    w = weights() if w is None else w
    none, (step, least) = len(TYPES), _steps(w)
    scored = [(a, b, t, s) for a, b, t, f in candidates(text, vocabulary) if (s := sum(w.get(x, 0.0) for x in f)) > least]
    if not scored:
        return []
    # best[i][l]: the best score of segmentations whose mentions are among the first i, ordered by end, the last of type l
    ends, nothing = [c[1] for c in scored], float("-inf")
    best, took = [[nothing] * none + [0.0]], []
    for i, (start, _, kind, score) in enumerate(scored):
        j = i
        while j > 0 and ends[j - 1] > start:
            j -= 1
        last = max(range(none + 1), key=lambda k: best[j][k] + step[k][kind])
        with_it = best[j][last] + step[last][kind] + score
        row = list(best[i])
        if with_it > row[kind]:
            row[kind] = with_it
            took.append((kind, j, last))
        else:
            took.append(None)
        best.append(row)
    out, i, last = [], len(scored), max(range(none + 1), key=lambda k: best[-1][k])
    while i > 0 and last != none:
        if took[i - 1] and took[i - 1][0] == last and best[i][last] != best[i - 1][last]:
            out.append((scored[i - 1][0], scored[i - 1][1], TYPES[scored[i - 1][2]]))
            _, i, last = took[i - 1]
        else:
            i -= 1
    return out[::-1]


def redact_text(text: str, w: dict[str, float] | None = None, vocabulary: lex.Vocabulary | None = None) -> str:
    """The text with each mention replaced by its type in brackets, otherwise unchanged."""
    out, pos = [], 0
    for start, end, kind in mentions(text, w, vocabulary):
        out += [text[pos:start], f"[{kind.upper()}]"]
        pos = end
    return "".join([*out, text[pos:]])


# ---- operators


def find_mentions(df: DataFrame, key: str, text: str, vocabularies: tuple[str, ...] = lex.VOCABULARIES) -> DataFrame:
    """key, pii_type, start, length, in code points: one row for each mention in each text.

    Null and empty texts have none. Repeated rows count each. Only the two named columns are read.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, words = weights(), lex.vocabulary(vocabularies)
        for batch in batches:
            out = [(k, kind, a, b - a) for k, t in zip(batch["key"], batch["text"]) for a, b, kind in mentions(t, w, words)]
            yield pd.DataFrame(out, columns=["key", "pii_type", "start", "length"])

    kind = dict(df.dtypes)[key]
    return rows.mapInPandas(find, f"key {kind}, pii_type string, start int, length int").withColumnRenamed("key", key)


def redact(df: DataFrame, text: str, out: str | None = None, vocabularies: tuple[str, ...] = lex.VOCABULARIES) -> DataFrame:
    """df with the mentions in column text replaced by placeholders of their types, in column out (else in place).

    Nulls stay null, all other columns stay as they are.
    """

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        w, words = weights(), lex.vocabulary(vocabularies)
        return texts.map(lambda t: redact_text(t, w, words), na_action="ignore")

    return df.withColumn(out or text, replace(text))
