"""Mixed timestamp notations and time zones, brought to one instant in UTC.

Each text is reduced to its shape: digits, letters and marks by class. Every distinct shape is mapped
to a layout once; all texts of a shape have the same length, so their fields are sliced and converted as
arrays, and local times go through the zones' transition tables.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.functions.zones import US, data_version, zone_table

CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z\z"

# English month and weekday names.
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_MONTH = {n: i + 1 for i, m in enumerate(_MONTHS) for n in (m, m[:3])} | {"sept": 9}
_WEEKDAY = {n for d in _WEEKDAYS for n in (d, d[:3])} | {"tues", "thur", "thurs"}
_UNIVERSAL = {"UTC", "GMT", "UT"}


class _Classes(dict):
    """Translates a code point to its class: 9 for a digit, a for a letter, a mark to itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "9" if c in "0123456789" else "a" if c.isalpha() else c
        return kind


_CLASSES = _Classes()

# Layouts over shapes. Names are fields; a field's span in the shape is its span in the text.
_TIME = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>aa)(?!a))?"
_OFFSET = r"(?P<sg>[+-])(?P<oh>99?)(?::?(?P<om>99))?"
_ZONE = (
    rf"(?:(?P<z>a)| ?{_OFFSET}(?:\[(?:a+(?:[/_+-]?[a9]+)*)\])?| ?(?P<utc>aaa?)"
    + _OFFSET.replace("<", "<u")
    + r"| (?P<iana>a+(?:[/_-]a+)+)| (?P<ab>a{2,5}))?"
)
_DATES = (
    r"(?P<Y>9999)-(?P<M>99)-(?P<D>99)",
    r"(?P<s1>9{1,4})/(?P<s2>99?)/(?P<s3>9{1,4})",
    r"(?P<D>99?)\.(?P<M>99?)\.(?P<Y>9999)",
    r"(?:(?P<wd>a{3,9}),? )?(?P<D>99?) (?P<mon>a{3,9}),? (?P<Y>9999)",
    r"(?:(?P<wd>a{3,9}),? )?(?P<mon>a{3,9}) (?P<D>99?)(?P<th>aa)?,? (?P<Y>9999)",
)
_LAYOUTS = [
    *(re.compile(rf"{d}(?:(?:(?P<t>a)|,? ){_TIME}{_ZONE})?") for d in _DATES),
    re.compile(r"(?P<Y>9999)(?P<M>99)(?P<D>99)(?P<t>a)(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9+))?)?" + _ZONE),
    re.compile(rf"(?P<wd>a{{3}}) (?P<mon>a{{3}})  ?(?P<D>99?) {_TIME}{_ZONE} (?P<Y>9999)"),
    re.compile(r"(?P<epoch>9{1,17})"),
]


@lru_cache(maxsize=65536)
def layout_of(shape: str) -> dict[str, tuple[int, int]] | None:
    """The fields of a shape with their spans; None if no layout has it."""
    for layout in _LAYOUTS:
        if m := layout.fullmatch(shape):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def _convert(texts: list[str], layout: dict[str, tuple[int, int]], zones: np.ndarray, locales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds, validity) of texts of one shape."""
    n = len(texts)
    codes = np.array(texts, dtype=f"U{len(texts[0])}").view(np.uint32).reshape(n, -1).astype(np.int64)
    ok = np.ones(n, dtype=bool)

    def digits(field: str) -> np.ndarray:
        a, b = layout[field]
        return (codes[:, a:b] - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))

    def number(field: str, default: int = 0) -> np.ndarray:
        return digits(field) if field in layout else np.full(n, default, dtype=np.int64)

    def words(field: str) -> tuple[np.ndarray, np.ndarray]:
        a, b = layout[field]
        return pd.factorize(np.array([t[a:b] for t in texts], dtype=object))

    def one_of(field: str, allowed) -> np.ndarray:
        each, distinct = words(field)
        return np.array([allowed(w) for w in distinct], dtype=bool)[each]

    if "epoch" in layout:
        count = digits("epoch")
        return count * np.where(count < 10**11, US, np.where(count < 10**14, 1000, 1)), ok

    if "s1" in layout:
        first, second, third = digits("s1"), digits("s2"), digits("s3")
        lengths = [layout[f][1] - layout[f][0] for f in ("s1", "s3")]
        if lengths[0] == 4 and lengths[1] <= 2:
            year, month, day = first, second, third
        elif lengths[0] <= 2 and lengths[1] == 4:
            us = locales == "en_US"
            year, month, day = third, np.where(us, first, second), np.where(us, second, first)
            ok &= locales != "ja_JP"
        else:
            return np.zeros(n, np.int64), np.zeros(n, bool)
    else:
        year, day = digits("Y"), digits("D")
        if "mon" in layout:
            each, distinct = words("mon")
            month = np.array([_MONTH.get(w.lower(), 0) for w in distinct], dtype=np.int64)[each]
        else:
            month = digits("M")
    if "wd" in layout:
        ok &= one_of("wd", lambda w: w.lower() in _WEEKDAY)
    if "th" in layout:
        ok &= one_of("th", lambda w: w.lower() in ("st", "nd", "rd", "th"))
    if "t" in layout:
        ok &= one_of("t", lambda w: w in "Tt")

    hour, minute, second = number("h"), number("mi"), number("s")
    if "ap" in layout:
        each, distinct = words("ap")
        half = np.array([{"AM": 0, "PM": 12}.get(w.upper(), -1) for w in distinct], dtype=np.int64)[each]
        ok &= (half >= 0) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + half
    micros = np.zeros(n, dtype=np.int64)
    if "f" in layout:
        a, b = layout["f"]
        b = min(b, a + 6)
        micros = ((codes[:, a:b] - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))) * 10 ** (6 - (b - a))

    ok &= (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1)
    ok &= (minute < 60) & (second < 60) & ((hour < 24) | ((hour == 24) & (minute + second + micros == 0)))
    months = (np.where(ok, year, 1970) - 1970) * 12 + np.where(ok, month, 1) - 1
    start = months.astype("M8[M]").astype("M8[D]").astype(np.int64)
    ok &= day <= (months + 1).astype("M8[M]").astype("M8[D]").astype(np.int64) - start
    wall = (start + day - 1) * 86400 * US + ((hour * 60 + minute) * 60 + second) * US + micros

    if "z" in layout:
        return wall, ok & one_of("z", lambda w: w in "Zz")
    prefix = "" if "oh" in layout else "u" if "uoh" in layout else None
    if prefix is not None:
        if prefix:
            ok &= one_of("utc", lambda w: w.upper() in _UNIVERSAL)
        hours, minutes = digits(prefix + "oh"), number(prefix + "om")
        sign = np.where(codes[:, layout[prefix + "sg"][0]] == ord("-"), -1, 1)
        return wall - sign * (hours * 60 + minutes) * 60 * US, ok & (hours < 24) & (minutes < 60)

    if "iana" in layout:
        a, b = layout["iana"]
        zones = np.array([t[a:b] for t in texts], dtype=object)
    utc, known = wall.copy(), np.zeros(n, dtype=bool)
    if "ab" in layout:
        a, b = layout["ab"]
        names = np.array([t[a:b].upper() for t in texts], dtype=object)
        known = np.isin(names, list(_UNIVERSAL))
        pairs = pd.DataFrame({"name": np.where(known, None, names), "zone": zones})
        for (name, zone), rows in pairs.groupby(["name", "zone"]).indices.items():
            table = zone_table(zone)
            at = None if table is None else table.abbreviated(wall[rows], name)
            if at is not None:
                utc[rows], known[rows] = at, True
        return utc, ok & known
    for zone, rows in pd.Series(zones).groupby(zones).indices.items():
        if (table := zone_table(zone)) is not None:
            utc[rows], known[rows] = table.to_utc(wall[rows]), True
    return utc, ok & known


def parse_instants(texts: pd.Series, zones: pd.Series, locales: pd.Series) -> pd.Series:
    """Microseconds since 1970-01-01 UTC of each text, null where it names no instant."""
    out = pd.array(np.zeros(len(texts), dtype=np.int64), dtype="Int64")
    out[:] = pd.NA
    present = texts[texts.notna()].str.strip()
    at, stripped = np.flatnonzero(texts.notna()), present.to_numpy(dtype=object)
    shapes = np.array([t.translate(_CLASSES) for t in stripped], dtype=object)
    zones = zones.to_numpy(dtype=object)[at]
    locales = locales.astype(object).where(locales.notna(), "").str.replace("-", "_").to_numpy(dtype=object)[at]
    for shape, rows in pd.Series(shapes).groupby(shapes).indices.items():
        if (layout := layout_of(shape)) is None:
            continue
        micros, ok = _convert([stripped[r] for r in rows], layout, zones[rows], locales[rows])
        out[at[rows[ok]]] = micros[ok]
    return pd.Series(out)


def instant_us(text: Column, zone: Column, locale: Column) -> Column:
    """The instant a text names, in microseconds since 1970-01-01 UTC.

    zone is the IANA zone of texts without one and of zone abbreviations, locale says how dates with
    slashes are read: month first for en_US, year first for ja_JP, else day first. The result is null for a null,
    empty or unknown text, for a date or time that does not exist, and for a local time without a zone.
    In a repeated hour the first pass is meant, in a skipped one the offset before it. Digits past the
    microsecond are cut off. Executors must hold the same zone data as the driver; others raise.
    """
    version = data_version()

    @F.pandas_udf("long")
    def convert(texts: pd.Series, zones: pd.Series, locales: pd.Series) -> pd.Series:
        if data_version() != version:
            raise RuntimeError(f"zone data {data_version()} here, {version} on the driver")
        return parse_instants(texts, zones, locales)

    # Called non-deterministic so that a filter on the result does not make the optimizer run it twice.
    return convert.asNondeterministic()(text, zone, locale)


def normalise(df: DataFrame, text: str, projects: DataFrame, project: str = "project_id", out: str = "instant_us") -> DataFrame:
    """df with column out: the instant that column text names, in the zone and locale of the row's project.

    projects has project_id, time_zone and locale, one row per project. A column of df already called
    out is replaced; the others keep their names and values.
    """
    places = projects.select(F.col("project_id").alias("_project"), F.col("time_zone").alias("_zone"), F.col("locale").alias("_locale"))
    joined = df.join(places, F.col(project) == F.col("_project"), "left")
    return joined.withColumn(out, instant_us(F.col(text), F.col("_zone"), F.col("_locale"))).drop("_project", "_zone", "_locale")


def unnormalised_instants(sources: list[tuple[str, DataFrame, str, str]], projects: DataFrame) -> DataFrame:
    """rec_table, rec_id, instant_us of every row whose text names an instant and is not in canonical form.

    sources lists (rec_table, table, id column, text column); each table has a project_id.
    """
    parts = []
    for name, df, key, text in sources:
        rows = df.select(F.col(key).alias("rec_id"), F.col(text).alias("_text"), "project_id").where(
            F.col("_text").isNotNull() & ~F.col("_text").rlike(CANONICAL)
        )
        parts.append(normalise(rows, "_text", projects).where("instant_us IS NOT NULL").select(F.lit(name).alias("rec_table"), "rec_id", "instant_us"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
