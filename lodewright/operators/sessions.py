"""Session logs: records, turns, tool calls, incremental ingest.

Records are the rows of a log: file_name, line_no and the parsed fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodewright.functions.paths import resolve_path

# The record types that are turns.
TURN_TYPES = ("user", "assistant")
# What each file tool does to a file.
TOOL_KINDS = {"Write": "write", "Edit": "write", "Read": "read"}
# Confidence of a call by its outcome.
CONFIRMED, UNCONFIRMED = 0.9, 0.5
CONTENT = "array<struct<type:string,id:string,name:string,text:string,tool_use_id:string,is_error:boolean,input:struct<file_path:string>>>"
RECORD = f"struct<type:string,sessionId:string,cwd:string,timestamp:string,message:struct<role:string,content:{CONTENT}>>"
RECORD_TEXT = "struct<message:struct<content:string>>"


def parse_records(lines: DataFrame) -> DataFrame:
    """file_name, line_no, type, session, cwd, at, parts (array), text, payload (the message's content as JSON) of lines that were found readable.

    A message whose content is one string has no parts but that text; one with parts has the texts of its text parts, joined.
    """
    strict = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
    parsed = lines.select("file_name", "line_no", F.from_json("line", RECORD, strict).alias("r"), F.from_json("line", RECORD_TEXT, strict).alias("t"), F.get_json_object("line", "$.message.content").alias("payload"))
    parts = F.coalesce("r.message.content", F.array().cast(CONTENT))
    texts = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    plain = F.when(F.col("r.message.content").isNull() & ~F.col("t.message.content").rlike(r"^\s*\["), F.col("t.message.content"))
    return parsed.select(
        "file_name", "line_no", F.col("r.type").alias("type"), F.col("r.sessionId").alias("session"), F.col("r.cwd").alias("cwd"), F.col("r.timestamp").alias("at"),
        parts.alias("parts"), F.coalesce(plain, texts).alias("text"), "payload",
    )


def turns(records: DataFrame) -> DataFrame:
    """The user and assistant records of each file's own session with seq, their number in the file from 1, and a hash of their payload.

    The payload has the calls and their inputs, so a rewritten call changes the hash even where no text does; it is empty without one.

    A file belongs to the session of its first record; records of another session are foreign and left out.
    """
    own = records.groupBy("file_name").agg(F.min_by("session", "line_no").alias("_own"))
    kept = records.join(own, "file_name").where((F.col("session") == F.col("_own")) & F.col("type").isin(*TURN_TYPES))
    order = Window.partitionBy("file_name").orderBy("line_no")
    return kept.select("file_name", "line_no", "session", F.col("type").alias("role"), "at", "text", F.row_number().over(order).alias("seq"), F.coalesce(F.sha2("payload", 256), F.lit("")).alias("content_hash"))


def file_counts(records: DataFrame) -> DataFrame:
    """file_name, session, records, turns, foreign, workspace (the first that is named)."""
    own = records.groupBy("file_name").agg(F.min_by("session", "line_no").alias("session"), F.min_by("cwd", F.when(F.col("cwd") != "", F.col("line_no"))).alias("workspace"))
    joined = records.select("file_name", "type", F.col("session").alias("_s")).join(own, "file_name")
    return joined.groupBy("file_name", "session", "workspace").agg(
        F.count("*").alias("records"), F.count_if((F.col("_s") == F.col("session")) & F.col("type").isin(*TURN_TYPES)).alias("turns"), F.count_if(F.col("_s") != F.col("session")).alias("foreign")
    )


def tool_touches(records: DataFrame) -> DataFrame:
    """file_name, line_no, call_id, touch_kind, file_path, confidence, outcome of every file tool call of a user or assistant record.

    A call is answered by the next result with its id in the file; within a record results come before calls. Outcome is ok
    (confirmed), failed (its result is an error; such calls touched nothing), reused (the id was used again before any
    result), or open (never answered). Calls without an id are open.
    """
    part = records.select("file_name", "line_no", "type", F.posexplode("parts").alias("part_no", "p"))
    kinds = F.create_map(*[F.lit(x) for kv in TOOL_KINDS.items() for x in kv])
    calls = part.where((F.col("p.type") == "tool_use") & F.col("type").isin(*TURN_TYPES) & F.col("p.name").isin(*TOOL_KINDS) & F.col("p.input.file_path").isNotNull()).select(
        "file_name", "line_no", "part_no", F.col("p.id").alias("call_id"), F.element_at(kinds, F.col("p.name")).alias("touch_kind"), F.col("p.input.file_path").alias("file_path"), F.lit("call").alias("event")
    )
    results = part.where(F.col("p.type") == "tool_result").select(
        "file_name", "line_no", "part_no", F.col("p.tool_use_id").alias("call_id"), F.lit(None).cast("string").alias("touch_kind"), F.lit(None).cast("string").alias("file_path"),
        F.when(F.col("p.is_error"), "error").otherwise("result").alias("event"),
    )
    order = Window.partitionBy("file_name", "call_id").orderBy("line_no", F.when(F.col("event") == "call", 1).otherwise(0), "part_no")
    nxt = calls.unionByName(results).where("call_id IS NOT NULL").withColumn("_next", F.lead("event").over(order)).where("event = 'call'")
    both = nxt.unionByName(calls.where("call_id IS NULL").withColumn("_next", F.lit(None).cast("string")))
    outcome = F.when(F.col("_next") == "result", "ok").when(F.col("_next") == "error", "failed").when(F.col("_next") == "call", "reused").otherwise("open")
    out = both.withColumn("outcome", outcome)
    confidence = F.when(F.col("outcome") == "ok", CONFIRMED).when(F.col("outcome") != "failed", UNCONFIRMED)
    return out.select("file_name", "line_no", "call_id", "touch_kind", "file_path", confidence.alias("confidence"), "outcome")


def touches_within(calls: DataFrame, records: DataFrame) -> DataFrame:
    """The calls that touched a file of their log's workspace, with the path relative to it.

    The workspace is the first working directory the log names; without one paths stay as they are. Failed calls touched nothing,
    and files elsewhere are none of the project's.
    """
    root = records.groupBy("file_name").agg(F.min_by("cwd", F.when(F.col("cwd") != "", F.col("line_no"))).alias("_root"))
    placed = calls.where("outcome <> 'failed'").join(root, "file_name", "left").withColumn("_path", resolve_path(F.col("file_path"), F.col("_root")))
    inside = F.col("_root").isNull() | F.col("_path").startswith(F.concat("_root", F.lit("/")))
    relative = F.when(F.col("_root").isNull(), F.col("file_path")).otherwise(F.expr("substring(_path, length(_root) + 2)"))
    return placed.where(inside).withColumn("file_path", relative).drop("_root", "_path")


def bounds(events: DataFrame, session: list[str], time: str) -> DataFrame:
    """Per session: turns, the last seq (0 without any), and the first and last time."""
    return events.groupBy(*session).agg(F.count("*").alias("turns"), F.coalesce(F.max("seq"), F.lit(0)).alias("watermark"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))


def ingest(stored: DataFrame, arriving: DataFrame, session: list[str]) -> DataFrame:
    """What a batch of logs adds: the columns of arriving and action, for each of its turns that must be written.

    stored and arriving have the session columns, seq and content_hash. A session is rewritten if the turn at its stored
    watermark now has another hash, or is gone: then all its turns are written again (action rewritten). Else only turns
    past the watermark are (action new).
    """
    mark = stored.groupBy(*session).agg(F.max("seq").alias("_mark"), F.max_by("content_hash", "seq").alias("_hash"))
    at_mark = arriving.join(mark, session).where("seq = _mark").groupBy(*session).agg(F.max("content_hash").alias("_now"))
    state = mark.join(at_mark, session, "left").withColumn("_rewritten", ~F.col("_hash").eqNullSafe(F.col("_now")))
    joined = arriving.join(state.drop("_hash", "_now"), session, "left")
    kept = joined.where(F.col("_mark").isNull() | F.col("_rewritten") | (F.col("seq") > F.col("_mark")))
    return kept.withColumn("action", F.when(F.coalesce("_rewritten", F.lit(False)), "rewritten").otherwise("new")).drop("_mark", "_rewritten")


def logs_of_workspace(records: DataFrame, root: str) -> DataFrame:
    """The records of the log files whose first named working directory is root or lies below it."""
    first = records.groupBy("file_name").agg(F.min_by("cwd", F.when(F.col("cwd") != "", F.col("line_no"))).alias("_cwd"))
    plain = root.rstrip("/")
    mine = first.where((F.col("_cwd") == plain) | F.col("_cwd").startswith(plain + "/")).select("file_name")
    return records.join(mine, "file_name", "left_semi")


def touch_turns(touches: DataFrame, turns: DataFrame, session: list[str], turn_id: str) -> DataFrame:
    """touches with the id of the turn of the same session and seq, null where that turn is not stored."""
    ids = turns.groupBy(*session, "seq").agg(F.min(turn_id).alias(turn_id))
    return touches.drop(turn_id).join(ids, [*session, "seq"], "left")
