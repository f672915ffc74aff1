from datetime import date, datetime

from pyspark.sql import functions as F

from lodewright.functions.text import adr_fields, body, clean_text, log_safe, metric_path, repository_of, subject
from lodewright.operators import decisions as d

T0 = datetime(2024, 1, 1)


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*columns).first())


def test_text(spark):
    t = F.col("t")
    assert one(spark, "a\x1b[31mred\x1b[0m\x07‮b\tc\n\x1b]0;title\x07d", clean_text(t)) == ("aredb\tc\nd",)
    assert one(spark, "x\ny" * 3, log_safe(t, 4)) == ("xyxy...[truncated]",) and one(spark, "ab", log_safe(t, 4)) == ("ab",)
    assert one(spark, " fix: a \n\n because \n", subject(t), body(t)) == ("fix: a", "because")
    assert one(spark, "fix", subject(t), body(t)) == ("fix", None) and one(spark, None, subject(t), body(t)) == (None, None)
    assert one(spark, "/api/scans/8b1f3c1e-0000-4000-8000-000000000000/files/12", metric_path(t)) == ("/api/scans/{id}/files/{id}",)


def test_repository_addresses(spark):
    cases = {
        "https://Git.Example/o/r.git": ("https", "git.example", "o", "r"), "git@h.example:a/b/c.git": ("ssh", "h.example", "a/b", "c"), "ssh://git@h.example:22/o/r": ("ssh", "h.example", "o", "r"),
        "git://h/o/r/": ("git", "h", "o", "r"), "ftp://h/o/r": (None,) * 4, "not a url": (None,) * 4, "": (None,) * 4,
    }
    for url, expected in cases.items():
        assert one(spark, url, *[c.alias(k) for k, c in repository_of(F.col("t")).items()]) == expected, url


def test_records(spark):
    text = "intro\n# ADR-007: Use it  \n\n- **Status:** Accepted\n- Date: 2024-03-05\n\n## Context\nstatus: wrong 2020-01-01\n"
    rows = [(1, "adr/ADR-007.md", text, "x"), (1, "adr/README.md", text, "x"), (1, "a.md", "no title", "x"), (1, "b.md", "# Only a title", "x"), (1, "c.md", None, "x"), (1, "d.md", "# T\n## S\nStatus: Late 2024-13-45", "x")]
    got = {r.source_ref: r for r in d.record_decisions(spark.createDataFrame(rows, "project_id long, path string, text string, status string")).collect()}
    assert sorted(got) == ["adr/ADR-007.md", "b.md", "d.md"]
    r = got["adr/ADR-007.md"]
    assert (r.summary, r.status, r.decided_on) == ("ADR-007: Use it", "Accepted", date(2024, 3, 5)) and r.rationale.startswith("- **Status:**")
    assert (got["b.md"].rationale, got["b.md"].status, got["d.md"].status, got["d.md"].decided_on) == (None, None, None, None)
    assert one(spark, "# t\n\nx", adr_fields(F.col("t"))["rationale"].alias("r")) == ("x",)


DECISION = "decision_id long, project_id long, source string, source_ref string, summary string, rationale string, commit_sha string"


def test_links(spark):
    rows = [
        (1, 1, "adr", "ADR-005-x.md", "t", None, None), (2, 1, "commit", "abc", "see adr 5", None, "abcdef1234"), (3, 1, "commit", "abd", "x", "ADR-0005 and ADR-9", None), (4, 2, "commit", "q", "ADR-5", None, None),
        (5, None, "adr", "", "ADR-5 null project", None, None), (6, None, "issue", "", "ADR-5", None, None), (7, 1, "issue", None, None, None, None), (8, 1, "adr", "ADR-005-x.md", "t", None, None),
    ]
    df = spark.createDataFrame(rows, DECISION)
    named = d.names_record(df.where("source <> 'adr'"), df)
    assert {tuple(r) for r in named.collect()} == {(2, 8), (3, 8), (6, 5)}
    assert {tuple(r) for r in d.neighbours(named).collect()} == {(2, 8), (8, 2), (3, 8), (8, 3), (6, 5), (5, 6)}
    assert {r.decision_id for r in d.one_per_reference(df).collect()} == {1, 2, 3, 4, 5, 6, 7}
    commits = spark.createDataFrame([(10, 1, "abcdef1234aa"), (11, 2, "abcdef1234bb"), (12, 1, "abcdef12")], "commit_id long, project_id long, sha string")
    turns = spark.createDataFrame([(1, 1, "see ABCDEF1 and abcdef1"), (2, 1, "abcdef1234aacc"), (3, 1, "abcdef"), (4, None, "abcdef1"), (5, 1, None)], "id long, project_id long, t string")
    assert {tuple(r) for r in d.names_commit(turns, F.col("t"), commits, "id").collect()} == {(1, 10), (1, 12), (2, 10), (2, 12)}
    files = d.decision_files(df, spark.createDataFrame([("abcdef1234", "f"), ("abcdef1234", "f"), ("zz", "g")], "sha string, path string"))
    assert [tuple(r) for r in files.collect()] == [(2, 1, "f")]
    assert [r.decision_id for r in d.affecting_file(df, files, "f").collect()] == [2]
    assert {r.decision_id for r in d.without_files(df, files).collect()} == {1, 3, 4, 5, 6, 7, 8}


def test_commit_decisions(spark):
    df = spark.createDataFrame([(1, 1, "a" * 40, "s\n\nwhy", T0), (2, 1, "b" * 40, "", T0)], "commit_id long, project_id long, sha string, message string, authored_at timestamp")
    got = {r.decision_id: (r.summary, r.rationale, r.confidence, r.source_ref) for r in d.commit_decisions(df).collect()}
    assert got == {1: ("s", "why", 0.6, "a" * 12), 2: ("(no subject)", None, 0.3, "b" * 12)}
