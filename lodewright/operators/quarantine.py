"""Rows that fail to parse: a strict load, and what it did not load with the reason.

The load keeps the offset of every record and emits only conforming rows. The unreadable rows are not
found by a second set of rules: they are the raw offsets minus the loaded ones. Only that remainder is
diagnosed, so a rule missing from the diagnosis can cost a precise reason, never a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.functions import strict_json
from lodewright.functions.iso8601 import names_instant

_BLANK = r"^[\s\x1c-\x1f\x85\p{Z}]*$"


class Unreadable(ValueError):
    """Says why a line is unreadable."""


@dataclass(frozen=True)
class Feed:
    """How one feed is read: the columns of a conforming row and the parser that yields them."""

    schema: str
    parse: Callable[[str], tuple]


def _storable(text: str) -> str:
    """The text with lone surrogates, which JSON may escape but no UTF-8 column can hold, as the escapes they came from."""
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode()


# ---- session_log: one JSON object per line


def parse_session_log(line: str) -> tuple:
    """(external_id, record_type, occurred_at, calls, failed_calls) of a conforming line."""
    try:
        record = strict_json.loads(line)
    except ValueError as e:
        raise Unreadable(f"not one JSON text: {e}"[:120]) from None
    if not isinstance(record, dict):
        raise Unreadable("not a JSON object")
    kind, session, stamp = record.get("type"), record.get("sessionId"), record.get("timestamp")
    if not isinstance(kind, str):
        raise Unreadable("type is not a string")
    if not isinstance(session, str) or not session:
        raise Unreadable("sessionId is not a non-empty string")
    if "timestamp" in record and not (isinstance(stamp, str) and names_instant(stamp)):
        raise Unreadable("timestamp names no instant")
    calls = failed = 0
    if "message" in record:
        message = record["message"]
        if not isinstance(message, dict):
            raise Unreadable("message is not an object")
        content = message.get("content")
        if not isinstance(content, str | list):
            raise Unreadable("message.content is neither a string nor an array")
        for part in content if isinstance(content, list) else ():
            if not isinstance(part, dict):
                continue
            calls += part.get("type") == "tool_use"
            if "is_error" in part:
                if not isinstance(part["is_error"], bool):
                    raise Unreadable("is_error is not a boolean")
                failed += part["is_error"]
    return _storable(session), _storable(kind), stamp, calls, failed


# ---- touch_export: one RFC 4180 record per line

_FIELD = re.compile(r'"((?:[^"]|"")*+)"|([^",\r\n]*+)')
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_DIGITS = re.compile(r"[0-9]+")
_DECIMAL = re.compile(r"[0-9]+(?:\.[0-9]+)?")
_KINDS = {"read", "write", "create", "delete"}


def _at_most_one(decimal: str) -> bool:
    """Whether a plain decimal is at most 1, by its digits, however many there are."""
    whole, _, part = decimal.partition(".")
    whole = whole.lstrip("0")
    return not whole or (whole == "1" and not part.strip("0"))


def split_record(line: str) -> list[str]:
    """The fields of one RFC 4180 record, with or without its line end."""
    end = len(line) - (2 if line.endswith("\r\n") else 1 if line.endswith("\n") else 0)
    fields, pos = [], 0
    while True:
        m = _FIELD.match(line, pos, end)
        quoted, plain = m.groups()
        fields.append(quoted.replace('""', '"') if quoted is not None else plain)
        pos = m.end()
        if pos >= end:
            return fields
        if line[pos] != ",":
            raise Unreadable("broken quoting" if '"' in line else "a line break inside the record")
        pos += 1


def parse_touch_export(line: str) -> tuple:
    """The nine typed fields of a conforming line."""
    fields = split_record(line)
    if len(fields) != 9:
        raise Unreadable(f"{len(fields)} fields instead of 9")
    session, seq, call, path, kind, confidence, stamp, error, note = fields
    if not _UUID.fullmatch(session):
        raise Unreadable("external_id is no UUID in lower case")
    if not _DIGITS.fullmatch(seq) or not seq.strip("0"):
        raise Unreadable("seq is no positive integer")
    if not call or not path:
        raise Unreadable("call_id is empty" if not call else "file_path is empty")
    if kind not in _KINDS:
        raise Unreadable("touch_kind is unknown")
    if not _DECIMAL.fullmatch(confidence) or not _at_most_one(confidence):
        raise Unreadable("confidence is no decimal from 0 to 1")
    if stamp and not names_instant(stamp):
        raise Unreadable("occurred_at names no instant")
    if error not in ("true", "false"):
        raise Unreadable("is_error is neither true nor false")
    return session, seq, call, path, kind, float(confidence), stamp or None, error == "true", note


FEEDS = {
    "session_log": Feed("external_id string, record_type string, occurred_at string, calls int, failed_calls int", parse_session_log),
    "touch_export": Feed(
        "external_id string, seq string, call_id string, file_path string, touch_kind string, confidence double, "
        "occurred_at string, is_error boolean, note string",
        parse_touch_export,
    ),
}


# ---- the operator


def with_offset(raw: DataFrame) -> DataFrame:
    """Adds _sum, which with line_id is a record's offset even where line_id is null or repeated."""
    return raw.withColumn("_sum", F.xxhash64("feed", "line"))


def _records(raw: DataFrame) -> DataFrame:
    """The rows of raw that are records: lines that are neither null nor white space."""
    return with_offset(raw).where(F.col("line").isNotNull() & ~F.col("line").rlike(_BLANK))


def _parsed(feed: Feed, line: bytes) -> tuple:
    """The fields of a conforming line. The line comes as bytes, because a damaged one need not be UTF-8."""
    try:
        text = line.decode("utf-8")
    except UnicodeDecodeError:
        raise Unreadable("not UTF-8") from None
    return feed.parse(text)


def strict_load(raw: DataFrame, feed: str, feeds: dict[str, Feed] = FEEDS) -> DataFrame:
    """The conforming rows of one feed with their fields; line_id, _sum, file_name and line_no are kept.

    A null line, like a line of white space, is no record. Columns of raw other than line_id, feed,
    file_name, line_no and line are not carried along, so their names cannot clash with the fields. Escaped lone
    surrogates stay escaped in the fields.
    """
    spec, names = feeds[feed], ["line_id", "_sum", "file_name", "line_no"]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = [c.split()[0] for c in spec.schema.split(", ")]
        for batch in batches:
            keep, rows = [], []
            for i, line in enumerate(batch["line"]):
                try:
                    rows.append(_parsed(spec, line))
                    keep.append(i)
                except Unreadable:
                    pass
            yield pd.concat([batch[names].iloc[keep].reset_index(drop=True), pd.DataFrame(rows, columns=fields)], axis=1)

    records = _records(raw).where(F.col("feed") == feed)
    return records.select(*names, F.col("line").cast("binary").alias("line")).mapInPandas(load, f"line_id long, _sum long, file_name string, line_no int, {spec.schema}")


def loaded_offsets(raw: DataFrame, feeds: dict[str, Feed] = FEEDS) -> DataFrame:
    """line_id, _sum of the rows that the strict loads of all feeds accept, in one pass over raw."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for i, (feed, line) in enumerate(zip(batch["feed"], batch["line"])):
                try:
                    _parsed(feeds[feed], line)
                    keep.append(i)
                except Unreadable:
                    pass
            yield batch[["line_id", "_sum"]].iloc[keep]

    records = _records(raw).where(F.col("feed").isin([*feeds]))
    return records.select("line_id", "_sum", "feed", F.col("line").cast("binary").alias("line")).mapInPandas(load, "line_id long, _sum long")


def unreadable_offsets(raw: DataFrame, feeds: dict[str, Feed] = FEEDS) -> DataFrame:
    """line_id, _sum of every record that no strict load accepts: the raw offsets minus the loaded ones.

    Only offsets are moved, no lines. Repeated rows stay repeated.
    """
    loaded = loaded_offsets(raw, feeds).select(F.col("line_id").alias("_id"), F.col("_sum").alias("_s"))
    return _records(raw).select("line_id", "_sum").join(loaded, F.col("line_id").eqNullSafe(F.col("_id")) & (F.col("_sum") == F.col("_s")), "left_anti")


def unreadable(raw: DataFrame, feeds: dict[str, Feed] = FEEDS) -> DataFrame:
    """Every record that no strict load accepts: line_id, feed, file_name, line_no, line, reason.

    Null and blank lines are no records. A record of an unknown or null feed is unreadable. Repeated
    rows stay repeated. An empty table gives an empty one. The lines are fetched for the remainder alone.
    """
    lost = unreadable_offsets(raw, feeds).select(F.col("line_id").alias("_id"), F.col("_sum").alias("_s"))
    records = _records(raw).select("line_id", "feed", "file_name", "line_no", "line", "_sum")
    remainder = records.join(lost, F.col("line_id").eqNullSafe(F.col("_id")) & (F.col("_sum") == F.col("_s")), "left_semi")

    @F.pandas_udf("string")
    def reason(feed: pd.Series, line: pd.Series) -> pd.Series:
        def why(f, x):
            if f not in feeds:
                return "unknown feed"
            try:
                _parsed(feeds[f], x)
            except Unreadable as e:
                return _storable(str(e))
            return "not loaded"

        return pd.Series([why(f, x) for f, x in zip(feed, line)], dtype=object)

    return remainder.withColumn("reason", reason("feed", F.col("line").cast("binary"))).drop("_sum")


def session_counts(raw: DataFrame) -> DataFrame:
    """Per session: external_id, unreadable_lines, failed_calls.

    A session log is named after its session, so an unreadable line of it counts for that session. An
    export holds many sessions; its unreadable lines are counted under the file's name.
    """
    log, export = strict_load(raw, "session_log"), strict_load(raw, "touch_export")
    failed = log.select("external_id", F.col("failed_calls").cast("long").alias("failed")).unionByName(
        export.select("external_id", F.col("is_error").cast("long").alias("failed"))
    )
    lost = unreadable(raw).select(F.regexp_replace("file_name", r"\.jsonl$", "").alias("external_id"), F.lit(1).cast("long").alias("lost"))
    both = failed.withColumn("lost", F.lit(0).cast("long")).unionByName(lost.withColumn("failed", F.lit(0).cast("long")))
    return both.groupBy("external_id").agg(F.sum("lost").alias("unreadable_lines"), F.sum("failed").alias("failed_calls"))
