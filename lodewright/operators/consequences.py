"""What a metric did after a decision: baseline, observation, confounders, and how sure one may be.

Anchors have anchor_id, project_id, starts_at and summary (decisions: ends_at is starts_at plus the window); samples have
project_id, metric, value and measured_at. Where a metric was not measured on both sides there is no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodewright.functions.scores import rounded
from lodewright.operators.asof import DAY_US, asof_join, numbered, running_total

# The window, the highest confidence, the move that counts as noise, and how many confounders are listed.
WINDOW_DAYS, MAX_CONFIDENCE, NOISE, LISTED = 30, 0.6, 1.0, 50
# The note on a session that changed the same file.
SAME_FILE = ("the file was also modified in agent session '", "' during the window")


def baselines(anchors: DataFrame, samples: DataFrame) -> DataFrame:
    """Each anchor and metric with the last value at or before the anchor (base_value, base_measured_at)."""
    finite = samples.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    metrics = finite.select("project_id", "metric").distinct()
    asked = anchors.select("anchor_id", "project_id", "starts_at").join(metrics, "project_id")
    return asof_join(asked, finite, by=["project_id", "metric"], left_time="starts_at", right_time="measured_at", take=["value"], prefix="base_")


def observations(anchors: DataFrame, samples: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Each anchor and metric with the last value after the anchor and at most days later (seen_value, seen_measured_at)."""
    finite = samples.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    metrics = finite.select("project_id", "metric").distinct()
    ends = (F.col("starts_at") + F.make_dt_interval(F.lit(days))).alias("ends_at")
    asked = anchors.select("anchor_id", "project_id", "starts_at", ends).join(metrics, "project_id")
    out = asof_join(asked, finite, by=["project_id", "metric"], left_time="ends_at", right_time="measured_at", take=["value"], prefix="seen_")
    late = F.col("seen_measured_at") > F.col("starts_at")
    return out.withColumns({c: F.when(late, F.col(c)) for c in ("seen_value", "seen_measured_at")})


def same_file_sessions(anchors: DataFrame, touches: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """anchor_id, sessions: how many agent sessions changed the anchor's file (file_path) from the anchor on to days later.

    A touch counts for the anchors of the days before it. These stretches are merged for each session and file, so each session
    covers an anchor at most once, and the number that cover it is a running total: no pairs are formed. Anchors without a
    file have no row.
    """
    by, span = ["project_id", "file_path"], days * DAY_US
    changes = touches.where(F.col("touch_kind").isin("write", "create", "delete") & F.col("occurred_at").isNotNull() & F.col("session_id").isNotNull())
    # Within a day all touches merge, so a busy session is folded by day first.
    daily = changes.groupBy(*by, "session_id", F.expr(f"unix_micros(occurred_at) div {DAY_US}L").alias("_day")).agg(
        F.min(F.unix_micros("occurred_at")).alias("_first"), F.max(F.unix_micros("occurred_at")).alias("_last")
    )
    order = Window.partitionBy(*by, "session_id").orderBy("_day")
    islands = daily.withColumn("_fresh", F.coalesce((F.col("_first") - F.lag("_last").over(order) > span).cast("int"), F.lit(1))).withColumn("_island", F.sum("_fresh").over(order))
    covered = islands.groupBy(*by, "session_id", "_island").agg(F.timestamp_micros(F.min("_first") - span).alias("opens"), F.timestamp_micros(F.max("_last")).alias("closes"))
    asked = anchors.where("file_path IS NOT NULL AND starts_at IS NOT NULL").select("anchor_id", *by, F.unix_micros("starts_at").alias("us"))
    # At one time stretches open before anchors are counted, and close after.
    none = F.lit(None).cast(dict(anchors.dtypes)["anchor_id"]).alias("anchor_id")
    steps = asked.select(*by, "us", F.lit(1).alias("order"), F.lit(0).alias("n"), "anchor_id")
    for at, order, n in (("opens", 0, 1), ("closes", 2, -1)):
        steps = steps.unionByName(covered.select(*by, F.unix_micros(at).alias("us"), F.lit(order).alias("order"), F.lit(n).alias("n"), none))
    return running_total(steps, by, "us", "order", "n").where("anchor_id IS NOT NULL").select("anchor_id", F.col("_total").alias("sessions"))


def _windows(anchors: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """anchor_id, project_id, own, lo, hi: each anchor's number by time in its project and those of the first and last anchor of its window; the numbered anchors."""
    ranked = numbered(anchors.select("anchor_id", "project_id", "starts_at", "summary"), "project_id", "starts_at", "anchor_id")
    spans = ranked.select("anchor_id", "project_id", "starts_at", F.col("_rank").alias("own"), (F.col("starts_at") + F.make_dt_interval(F.lit(days))).alias("ends_at"))
    ranks = ranked.groupBy("project_id", "starts_at").agg(F.min("_rank").alias("lo"), F.max("_rank").alias("hi"))
    with_lo = spans.join(ranks.select("project_id", "starts_at", "lo"), ["project_id", "starts_at"])
    with_hi = asof_join(with_lo, ranks.select("project_id", F.col("starts_at").alias("at"), "hi"), by=["project_id"], left_time="ends_at", right_time="at", take=["hi"], prefix="end_")
    return with_hi.select("anchor_id", "project_id", "own", "lo", F.col("end_hi").alias("hi")), ranked


def confounder_counts(anchors: DataFrame, days: int = WINDOW_DAYS, touches: DataFrame | None = None) -> DataFrame:
    """anchor_id, confounders: how many other anchors of the project, and sessions that changed the anchor's file, lie in the window from an anchor on to days later.

    How many anchors lie in a window follows from two running totals over the project's time, so busy projects cost no pairs. Those at the same time count. Sessions count where touches are given and anchors have file_path.
    """
    start, end = F.unix_micros("starts_at"), F.unix_micros(F.col("starts_at") + F.make_dt_interval(F.lit(days)))
    # Each anchor counts at its time, asks before that how many there were, and asks again at the end of its window.
    steps = F.inline(F.array(*[F.struct(us.alias("us"), F.lit(o).alias("order"), F.lit(n).alias("n"), F.lit(sign).alias("sign")) for us, o, n, sign in ((start, 0, 0, -1), (start, 1, 1, 0), (end, 2, 0, 1))]))
    totals = running_total(anchors.where("starts_at IS NOT NULL").select("anchor_id", "project_id", steps), ["project_id"], "us", "order", "n")
    counted = totals.groupBy("anchor_id").agg((F.sum(F.col("_total") * F.col("sign")) - 1).alias("confounders"))
    if touches is None:
        return counted
    sessions = same_file_sessions(anchors, touches, days)
    return counted.join(sessions, "anchor_id", "left").select("anchor_id", (F.col("confounders") + F.coalesce("sessions", F.lit(0))).alias("confounders"))


def confounders(anchors: DataFrame, days: int = WINDOW_DAYS, listed: int = LISTED, touches: DataFrame | None = None) -> DataFrame:
    """anchor_id, confounders (their true number), sample: confounder_counts() with the names of at most listed of them.

    Only the first few anchors of each window are looked up; the sessions come after them, those first whose touches
    come first. What is not listed is counted in the last line.
    """
    windows, ranked = _windows(anchors, days)
    counted = windows.join(confounder_counts(anchors, days, touches), "anchor_id")
    # the first few of the window, without the anchor itself
    wanted = windows.withColumn("_rank", F.explode(F.sequence(F.col("lo"), F.least("hi", F.col("lo") + listed)))).where(F.col("_rank") != F.col("own"))
    first = wanted.join(ranked.select("project_id", "_rank", "summary"), ["project_id", "_rank"]).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("_rank", "summary"))).alias("_s"))
    some = counted.join(first, "anchor_id", "left").withColumn("_names", F.coalesce(F.transform(F.slice("_s", 1, listed), lambda x: x["summary"]), F.array().cast("array<string>")))
    if touches is not None:
        some = some.join(_session_names(anchors, touches, days, listed), "anchor_id", "left")
        some = some.withColumn("_names", F.slice(F.concat("_names", F.coalesce("_sessions", F.array().cast("array<string>"))), 1, listed))
    hidden = F.col("confounders") - F.size("_names")
    more = F.when(hidden > 0, F.array(F.concat(F.lit("... and "), hidden.cast("string"), F.lit(" more decision(s) in this window")))).otherwise(F.array().cast("array<string>"))
    return some.select("anchor_id", "confounders", F.concat("_names", more).alias("sample"))


def _session_names(anchors: DataFrame, touches: DataFrame, days: int, listed: int) -> DataFrame:
    """anchor_id, _sessions: notes on the sessions behind the first few changes of the anchor's file in its window."""
    by = ["project_id", "file_path"]
    changes = touches.where(F.col("touch_kind").isin("write", "create", "delete") & F.col("occurred_at").isNotNull()).select(*by, "session_id", "occurred_at", "touch_id")
    ranked = numbered(changes, by, "occurred_at", "touch_id")
    last = ranked.groupBy(*by, "occurred_at").agg(F.max("_rank").alias("rank"))
    asked = anchors.where("file_path IS NOT NULL AND starts_at IS NOT NULL").select("anchor_id", *by, "starts_at", (F.col("starts_at") + F.make_dt_interval(F.lit(days))).alias("ends_at"))
    upto = asof_join(asked, last, by=by, left_time="ends_at", right_time="occurred_at", take=["rank"], prefix="hi_")
    both = asof_join(upto, last, by=by, left_time="starts_at", right_time="occurred_at", take=["rank"], inclusive=False, prefix="lo_")
    first = F.coalesce("lo_rank", F.lit(0)) + 1
    inside = both.where(F.col("hi_rank") >= first).select("anchor_id", *by, F.explode(F.sequence(first, F.least("hi_rank", first + listed - 1))).alias("_rank"))
    named = inside.join(ranked.select(*by, "_rank", "session_id"), [*by, "_rank"]).select("anchor_id", F.col("session_id").cast("string").alias("_id")).distinct()
    note = F.concat(F.lit(SAME_FILE[0]), F.col("_id"), F.lit(SAME_FILE[1]))
    return named.groupBy("anchor_id").agg(F.sort_array(F.collect_list(note)).alias("_sessions"))


def consequences(anchors: DataFrame, samples: DataFrame, days: int = WINDOW_DAYS, touches: DataFrame | None = None) -> DataFrame:
    """anchor_id, project_id, metric, baseline, observed, delta, claim, confounders, confidence.

    A move below the noise threshold claims nothing, any other at most correlation. With touches (and file_path in anchors)
    sessions that changed the anchor's file in the window lower the confidence too.
    """
    before = baselines(anchors, samples).where("base_value IS NOT NULL").select("anchor_id", "project_id", "metric", "base_value")
    after = observations(anchors, samples, days).where("seen_value IS NOT NULL").select("anchor_id", "metric", "seen_value")
    joined = before.join(after, ["anchor_id", "metric"]).join(confounder_counts(anchors, days, touches), "anchor_id")
    delta = F.col("seen_value") - F.col("base_value")
    quiet = F.abs(delta) < NOISE
    return joined.select(
        "anchor_id", "project_id", "metric", rounded(F.col("base_value"), 3).alias("baseline"), rounded(F.col("seen_value"), 3).alias("observed"),
        rounded(delta, 3).alias("delta"), F.when(quiet, "none").otherwise("correlation").alias("claim"), "confounders",
        F.when(quiet, 0.0).otherwise(rounded(F.lit(MAX_CONFIDENCE) / (1 + F.col("confounders")), 3)).alias("confidence"),
    )


def counted_in(windows: DataFrame, events: DataFrame, by: str = "project_id") -> DataFrame:
    """windows (by, window_id, starts_at, ends_at) with n: how many events (by, event_id, at) lie in each, both ends included.

    The events of an entity are numbered by time, and a window's count is the difference of two numbers.
    """
    ranks = numbered(events.select(by, "event_id", "at"), by, "at", "event_id").groupBy(by, "at").agg(F.max("_rank").alias("rank"))
    upto = asof_join(windows, ranks, by=[by], left_time="ends_at", right_time="at", take=["rank"], prefix="hi_")
    both = asof_join(upto, ranks, by=[by], left_time="starts_at", right_time="at", take=["rank"], inclusive=False, prefix="lo_")
    n = F.coalesce("hi_rank", F.lit(0)) - F.coalesce("lo_rank", F.lit(0))
    return both.select(*windows.columns, F.when(F.col("ends_at") >= F.col("starts_at"), n).otherwise(F.lit(0)).alias("n"))


def session_consequences(sessions: DataFrame, decisions: DataFrame, samples: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """session_id, project_id, metric, baseline, observed, delta, claim, confounders, confidence.

    sessions has session_id, project_id, started_at and ended_at. The window runs from the start to so many days after the end (the
    start where there is none); the observation is the last value in it after the start, confounders are the decisions (project_id,
    decision_id, decided_at) in it.
    """
    end = F.coalesce("ended_at", "started_at") + F.make_dt_interval(F.lit(days))
    spans = sessions.where("started_at IS NOT NULL").select("session_id", "project_id", F.col("started_at").alias("starts_at"), end.alias("ends_at"))
    finite = samples.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    asked = spans.join(finite.select("project_id", "metric").distinct(), "project_id")
    keys = {"by": ["project_id", "metric"], "right_time": "measured_at", "take": ["value"]}
    seen = asof_join(asof_join(asked, finite, left_time="starts_at", prefix="base_", **keys), finite, left_time="ends_at", prefix="seen_", **keys)
    kept = seen.where("base_value IS NOT NULL AND seen_measured_at > starts_at")
    events = decisions.where("decided_at IS NOT NULL").select("project_id", F.col("decision_id").alias("event_id"), F.col("decided_at").alias("at"))
    n = counted_in(spans, events).select("session_id", F.col("n").alias("confounders"))
    delta = F.col("seen_value") - F.col("base_value")
    quiet = F.abs(delta) < NOISE
    return kept.join(n, "session_id").select(
        "session_id", "project_id", "metric", rounded(F.col("base_value"), 3).alias("baseline"), rounded(F.col("seen_value"), 3).alias("observed"), rounded(delta, 3).alias("delta"),
        F.when(quiet, "none").otherwise("correlation").alias("claim"), "confounders", F.when(quiet, 0.0).otherwise(rounded(F.lit(MAX_CONFIDENCE) / (1 + F.col("confounders")), 3)).alias("confidence"),
    )
