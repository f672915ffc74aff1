"""Findings, composite scores, explanations, differences, guards and exports.

Findings have project_id, analyzer, category, title, severity, path and score; scores have project_id, analyzer and score (null: not measured).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodewright.functions.scores import ANALYZER_WEIGHTS, band, rounded, signed_general
from lodewright.functions.text import clean_text

TOP_FINDINGS = 200
SEVERITIES = ("critical", "high", "medium", "low", "info")
# What the export formats call each severity.
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
CODE_QUALITY = {"critical": "blocker", "high": "critical", "medium": "major", "low": "minor", "info": "info"}
NOISE = 1.0
#: The most decisions named and moves listed in one explanation.
NAMED, MOVES = 3, 100
# The wording of explanations.
TRACED, TOUCHED, SINCE, AUTHORED = "Traced to ", " decision(s) touch it: ", "Since then: ", "% of its current lines are AI-authored ("
NO_EVIDENCE = "no fusion evidence — not touched by a recorded agent session."
NO_HUMAN = "no human share claimed"
NO_SHARE = "); a line-share has not been computed."
UNDER_AGENTS = " of that risk sits under agent-modified code — correlation, not blame."
NO_CHANGE = "no discernible change"
NOT_CAUSE = " — correlation, not causation."


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


# ---- scores and findings


def composite(scores: DataFrame) -> DataFrame:
    """project_id, overall, band, measured, ledger: the weighted mean of the measured scores; 50 where nothing was measured."""
    weight = F.coalesce(_lookup(ANALYZER_WEIGHTS, F.col("analyzer")), F.lit(1.0))
    line = F.format_string("%s: %.1f x %.1f", "analyzer", "score", weight)
    out = scores.groupBy("project_id").agg(
        F.sum(F.col("score") * weight).alias("_sum"), F.sum(F.when(F.col("score").isNotNull(), weight)).alias("_weight"), F.count("score").alias("measured"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), line))), "; ").alias("ledger"),
    )
    overall = rounded(F.coalesce(F.col("_sum") / F.col("_weight"), F.lit(50.0)), 1)
    return out.withColumn("overall", overall).select("project_id", "overall", band(F.col("overall")).alias("band"), "measured", "ledger")


def finding(rows: DataFrame, analyzer: str, category: str, title: Column, severity: Column, path: Column, score: Column) -> DataFrame:
    bounded = F.least(F.greatest(score.cast("double"), F.lit(0.0)), F.lit(100.0))
    return rows.select(
        "project_id", F.lit(analyzer).alias("analyzer"), F.lit(category).alias("category"), title.alias("title"), severity.alias("severity"), path.alias("path"), F.when(score.isNotNull(), rounded(bounded, 4)).alias("score")
    )


def counts(findings: DataFrame) -> DataFrame:
    """project_id and the number of findings of each severity."""
    return findings.groupBy("project_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def top_findings(findings: DataFrame, top: int = TOP_FINDINGS) -> DataFrame:
    """The findings of each project by score, those without one last, at most top, with place."""
    order = Window.partitionBy("project_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "analyzer", "category", "title")
    return findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


# ---- differences between two states


def stats(inv: DataFrame, commits: DataFrame) -> DataFrame:
    """project_id, files, loc, commits of a state."""
    size = inv.groupBy("project_id").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    return size.join(commits.groupBy("project_id").agg(F.count("*").alias("commits")), "project_id", "left").withColumn("commits", F.coalesce("commits", F.lit(0)))


def stats_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """project_id and by how much files, loc and commits grew from one state to another; what a state has not counts as 0."""
    names = ["files", "loc", "commits"]
    old = before.select("project_id", *[F.col(c).alias(f"_{c}") for c in names])
    both = old.join(after.select("project_id", *names), "project_id", "full_outer")
    return both.select("project_id", *[(F.coalesce(c, F.lit(0)) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names])


def fingerprint() -> Column:
    return F.concat_ws(":", "analyzer", "category", "title")


def findings_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """project_id, finding, change (added, removed, severity) and both severities, of findings that are not the same in both."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("project_id", fingerprint().alias("finding")).agg(F.max("severity").alias(name))

    both = keyed(before, "old").join(keyed(after, "new"), ["project_id", "finding"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "severity")
    return both.withColumn("change", change).where("change IS NOT NULL").select("project_id", "finding", "change", "old", "new")


def scores_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """project_id, analyzer, old, new, delta over all scores of either state; a score that one state has not counts as 0."""
    b, a = before.select("project_id", "analyzer", F.col("score").alias("old")), after.select("project_id", "analyzer", F.col("score").alias("new"))
    both = b.join(a, ["project_id", "analyzer"], "full_outer").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("old", "new")})
    return both.withColumn("delta", rounded(F.col("new") - F.col("old"), 2))


# ---- exports


def sarif_results(findings: DataFrame, shares: DataFrame) -> DataFrame:
    """One row for each finding with its level, and where known the share of its file's lines that agents wrote; result is its JSON."""
    joined = findings.join(shares.select("project_id", "path", "ai"), ["project_id", "path"], "left")
    level, rule = F.coalesce(_lookup(SARIF_LEVELS, F.col("severity")), F.lit("note")), F.concat_ws("/", "analyzer", "category")
    place = F.when(F.col("path").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))))
    result = F.to_json(F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), place.alias("locations"), F.struct("score", F.col("ai").alias("aiShare")).alias("properties")))
    return joined.select("project_id", rule.alias("rule_id"), level.alias("level"), "title", "path", "ai", result.alias("result"))


def sarif_runs(results: DataFrame, tool: str = "lodewright", most: int = TOP_FINDINGS) -> DataFrame:
    """project_id, sarif: one SARIF 2.1.0 log for each project, with its first results by rule and title (top_findings() has no more)."""
    order = Window.partitionBy("project_id").orderBy("rule_id", "title", "result")
    first = results.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    runs = first.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "result"))), lambda x: x["result"]), ",").alias("_r"))
    head = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}"}}}},"results":['
    return runs.select("project_id", F.concat(F.lit(head), "_r", F.lit("]}]}")).alias("sarif"))


def json_report(overall: DataFrame, scores: DataFrame, findings: DataFrame) -> DataFrame:
    """project_id, report: the whole report of a project as JSON without null fields: overall, band, scores, findings in their order."""
    scored = scores.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("analyzer", "score"))).alias("scores"))
    found = findings.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("place", "analyzer", "category", "title", "severity", "path", "score"))).alias("findings"))
    whole = overall.join(scored, "project_id", "left").join(found, "project_id", "left")
    return whole.select("project_id", F.to_json(F.struct("project_id", "overall", "band", "scores", "findings"), {"ignoreNullFields": "true"}).alias("report"))


def run_records(runs: DataFrame) -> DataFrame:
    """runs (analyzer, status, started_at, finished_at, score) with duration_ms, the score to one digit, band, is_measured and passed."""
    took = F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    known = runs.withColumns({"duration_ms": took, "score": rounded(F.col("score"), 1)})
    return known.withColumns({"band": band(F.col("score")), "is_measured": F.col("score").isNotNull(), "passed": F.coalesce(F.col("status") == "completed", F.lit(False))})


def detection(truth: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """expected, found, both, recall, false_positive_rate (the share of what was found that is not expected); null where there is nothing to divide by."""
    t, f = truth.select(*key).distinct().withColumn("_t", F.lit(1)), found.select(*key).distinct().withColumn("_f", F.lit(1))
    both = t.join(f, key, "full_outer").agg(F.count("_t").alias("expected"), F.count("_f").alias("found"), F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("both"))
    return both.withColumns({"recall": rounded(F.try_divide("both", "expected"), 4), "false_positive_rate": rounded(F.try_divide(F.col("found") - F.col("both"), F.col("found")), 4)})


def with_evidence(explained: DataFrame) -> DataFrame:
    """The explanations that say more than the risk, by weighted risk and then base risk, the largest first, with their place in the project."""
    order = Window.partitionBy("project_id").orderBy(F.desc(F.coalesce("weighted_risk", F.lit(0.0))), F.desc(F.coalesce("base_risk", F.lit(0.0))), "file_path")
    told = explained.where(F.exists("factors", lambda f: f["name"] != "risk"))
    return told.withColumn("place", F.row_number().over(order))


def code_quality(findings: DataFrame) -> DataFrame:
    """The findings as a code-quality report has them: description, check_name, fingerprint, severity, path."""
    return findings.select(
        "project_id", F.col("title").alias("description"), F.col("category").alias("check_name"), fingerprint().alias("fingerprint"),
        F.coalesce(_lookup(CODE_QUALITY, F.col("severity")), F.lit("major")).alias("severity"), F.coalesce("path", F.lit(".")).alias("path"),
    )


def histogram(rows: DataFrame, labels: list[str], value: str, buckets: list[float]) -> DataFrame:
    """Per label: count, sum, and for each bound how many values are at most that, as metric servers count them."""
    return rows.groupBy(*labels).agg(F.count(value).alias("n"), rounded(F.sum(value), 4).alias("total"), *[F.count_if(F.col(value) <= b).alias(f"le_{b:g}".replace(".", "_")) for b in buckets])


# ---- guards: claims that the evidence does not carry


def violations(shares: DataFrame, touches: DataFrame, consequences: DataFrame, decisions: DataFrame) -> DataFrame:
    """rule, ref: every stored claim that breaks a rule. Empty means clean.

    shares (path, ai, human, unattributed, method, confidence), touches (touch_id, confidence), consequences (anchor_id, metric, claim,
    delta, confidence), decisions (decision_id, confidence). Null values break no rule.
    """
    def broken(df: DataFrame, rule: str, when: Column, ref: Column) -> DataFrame:
        return df.where(when).select(F.lit(rule).alias("rule"), ref.alias("ref"))

    share, cons = F.concat(F.lit("authorship "), F.col("path")), F.concat(F.lit("consequence "), F.col("anchor_id").cast("string"), F.lit(" "), "metric")
    parts = [broken(shares, "shares_sum_to_100", F.abs(F.col("ai") + F.col("human") + F.col("unattributed") - 100) >= 0.01, share)]
    parts += [broken(shares, "share_in_range", ~F.col(c).between(0, 100), F.concat(share, F.lit(f" {c}"))) for c in ("ai", "human", "unattributed")]
    parts += [
        broken(shares, "confidence_below_1", F.col("confidence") >= 1, share),
        broken(shares, "no_human_from_blame", (F.col("method") == "blame_session_commit") & (F.col("human") > 0), share),
        broken(touches, "touch_confidence_below_1", F.col("confidence") >= 1, F.concat(F.lit("touch "), F.col("touch_id").cast("string"))),
        broken(consequences, "never_causation", F.col("claim") == "causation", cons),
        broken(consequences, "confidence_below_1", F.col("confidence") >= 1, cons),
        broken(consequences, "inconclusive_claims_nothing", (F.abs("delta") < NOISE) & (F.col("claim") == "correlation"), cons),
        broken(decisions, "confidence_below_1", F.col("confidence") >= 1, F.concat(F.lit("decision "), F.col("decision_id").cast("string"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def calibration(expected: DataFrame, computed: DataFrame, key: list[str]) -> DataFrame:
    """items, worst, mean: by how much computed values miss the expected ones of the same key; items without a computed value miss it wholly."""
    joined = expected.join(computed, key, "left")
    error = F.abs(F.col("expected") - F.coalesce("computed", F.lit(0.0)))
    return joined.agg(F.count("*").alias("items"), rounded(F.max(error), 4).alias("worst"), rounded(F.avg(error), 6).alias("mean"))


# ---- explanations


def _whole(x: Column) -> Column:
    return F.round(x.cast("decimal(38,12)"), 0).cast("bigint").cast("string")


def explain(files: DataFrame, decisions: DataFrame, moves: DataFrame) -> DataFrame:
    """project_id, file_path, base_risk, weighted_risk, factors, prose: what is known of each file, in the order risk, authorship, weighted risk, sessions, decisions, consequences.

    files has project_id, file_path and, where known, base_risk, ai, unattributed, human, share_confidence, writes, reads, sessions, strength and
    weighted_risk; decisions has project_id, file_path, decision_id and summary; moves has decision_id, metric, delta and claim. A file's
    factors leave out what is not known. The prose is made of the factors alone; of a file's moves the first hundred are
    listed and the rest counted.
    """
    key = ["project_id", "file_path"]
    once = decisions.groupBy(*key, "decision_id", F.col("summary").alias("s")).agg(F.lit(1).alias("_one"))

    def first_few(rows: DataFrame, order: list[str], most: int) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= most)

    # Counted in one pass and listed in another, which stops at the first few where rows are read: no list grows with its file.
    named = once.groupBy(*key).agg(F.count("*").alias("_dn"))
    named = named.join(first_few(once, ["decision_id", "s"], NAMED).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("decision_id", "s"))).alias("_d")), key)
    moved = decisions.select(*key, "decision_id").distinct().join(moves.where("delta IS NOT NULL"), "decision_id")
    phrase = F.when(F.col("claim") == "none", NO_CHANGE).otherwise(F.concat("metric", F.lit(" "), signed_general(F.col("delta")), F.lit(" ("), "claim", F.lit(")")))
    then = moved.groupBy(*key).agg(F.count("*").alias("_mn"), F.max(F.col("claim") != "none").alias("_any"))
    listed = first_few(moved, ["decision_id", "metric", "delta"], MOVES).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("decision_id", "metric", "delta", phrase.alias("p")))).alias("_m"))
    then = then.join(listed, key)
    all_ = files.join(named, key, "left").join(then, key, "left")
    wrote = F.coalesce(F.col("strength"), F.lit(0.0)) > 0
    human = F.when(F.col("human") > 0, F.concat(_whole(F.col("human")), F.lit("% human"))).otherwise(F.lit(NO_HUMAN))
    share = F.concat(
        _whole(F.col("ai")), F.lit(AUTHORED), _whole(F.col("unattributed")), F.lit("% unattributed, "), human, F.lit("), at confidence "), F.format_string("%.2f", "share_confidence"), F.lit(".")
    )
    n = F.col("_dn")
    names = F.array_join(F.transform("_d", lambda x: F.concat(F.lit("“"), clean_text(x["s"]), F.lit("”"))), "; ")
    factor = lambda name, when, text: F.when(when, F.struct(F.lit(name).alias("name"), text.alias("statement")))
    factors = F.array_compact(
        F.array(
            factor("risk", F.col("base_risk").isNotNull(), F.concat(F.lit("risk "), _whole(F.col("base_risk")), F.lit("/100."))),
            factor("ai_authorship", F.col("ai").isNotNull(), share),
            factor("ai_evidence", F.col("ai").isNull() & wrote, F.concat(F.lit("an agent has write evidence on it (strength "), F.format_string("%.2f", "strength"), F.lit(NO_SHARE))),
            factor("weighted_risk", F.col("base_risk").isNotNull() & wrote & (F.round(F.col("weighted_risk").cast("decimal(38,12)"), 0) > 0), F.concat(F.lit("about "), _whole(F.col("weighted_risk")), F.lit(UNDER_AGENTS))),
            factor("sessions", F.coalesce("sessions", F.lit(0)) > 0, F.concat(F.lit(TRACED), F.col("sessions").cast("string"), F.when(F.col("sessions") == 1, " agent session (").otherwise(" agent sessions ("), F.col("writes").cast("string"), F.lit(" write, "), F.col("reads").cast("string"), F.lit(" read)."))),
            factor("decisions", n > 0, F.concat(n.cast("string"), F.lit(TOUCHED), names, F.when(n > NAMED, F.concat(F.lit(", and "), (n - NAMED).cast("string"), F.lit(" more"))).otherwise(""), F.lit("."))),
            factor("consequences", F.col("_mn") > 0, F.concat(F.lit(SINCE), F.array_join(F.transform("_m", lambda x: x["p"]), ", "), F.when(F.col("_mn") > MOVES, F.concat(F.lit(", and "), (F.col("_mn") - MOVES).cast("string"), F.lit(" more"))).otherwise(""), F.when(F.col("_any"), NOT_CAUSE).otherwise("."))),
        )
    )
    out = all_.withColumn("factors", factors)
    prose = F.when(F.size("factors") > 0, F.array_join(F.transform("factors", lambda f: f["statement"]), " ")).otherwise(NO_EVIDENCE)
    return out.select("project_id", "file_path", "base_risk", "weighted_risk", "factors", F.concat(clean_text(F.col("file_path")), F.lit(": "), prose).alias("prose"))
