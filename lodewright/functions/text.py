"""Text expressions, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terminal escapes (of the second kind only terminated ones), control characters but tab, newline and carriage
# return, and bidirectional overrides.
UNSAFE = r"\x1B\[[0-9;?]*[ -/]*[@-~]|\x1B\][^\x07\x1B]*(?:\x07|\x1B\\)|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|[\u202A-\u202E\u2066-\u2069]"
# How records and commits are cited.
ADR_REFERENCE = r"(?i)\bADR[-\s]?0*(\d{1,4})\b"
ADR_NUMBER = r"(?i)ADR[-\s]?0*(\d{1,4})"
SHA_CITED = r"\b([0-9a-f]{7,40})\b"


def clean_text(text: Column) -> Column:
    """text without what could steer a terminal or turn its reading direction."""
    return F.regexp_replace(text, UNSAFE, "")


def log_safe(text: Column, length: int = 200) -> Column:
    """text without control characters, cut to a length with a mark."""
    plain = F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")
    return F.when(F.length(plain) > length, F.concat(F.left(plain, F.lit(length)), F.lit("...[truncated]"))).otherwise(plain)


def subject(message: Column) -> Column:
    """The first line of a commit message, cleaned; null without one."""
    line = F.trim(clean_text(F.substring_index(message, "\n", 1)))
    return F.when(line != "", line)


def body(message: Column) -> Column:
    """What follows the first line, cleaned; null if nothing does."""
    rest = F.when(message.contains("\n"), F.regexp_replace(message, r"(?s)\A[^\n]*\n", ""))
    text = F.regexp_replace(clean_text(rest), r"\A\s+|\s+\z", "")
    return F.when(text != "", text)


def repository_of(url: Column) -> dict[str, Column]:
    """scheme, host, owner (with sub-groups) and name of a repository address in https, http, ssh, git or scp form; null if it is none."""
    scp = r"^(?:[\w.+-]+@)([\w.-]+):(?!//)((?:[\w.~-]+/)*)([\w.-]+?)(?:\.git)?/?$"
    full = r"^(https?|ssh|git)://(?:[^@/\s]+@)?([\w.-]+)(?::\d+)?/((?:[\w.~-]+/)*)([\w.-]+?)(?:\.git)?/?$"
    is_full, is_scp = url.rlike(full), url.rlike(scp)
    part = lambda a, b: F.when(is_full, F.regexp_extract(url, full, a)).when(is_scp, F.regexp_extract(url, scp, b))
    return {
        "scheme": F.when(is_full, F.regexp_extract(url, full, 1)).when(is_scp, F.lit("ssh")), "host": F.lower(part(2, 1)),
        "owner": F.regexp_replace(part(3, 2), "/$", ""), "name": part(4, 3),
    }


def metric_path(path: Column) -> Column:
    """A request path with its UUIDs and numbers as {id}, so that metrics have few labels."""
    uuids = F.regexp_replace(path, r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{id}")
    return F.regexp_replace(uuids, r"(?<=[/-])\d+(?=[/.]|$)", "{id}")


def adr_fields(text: Column) -> dict[str, Column]:
    """summary, rationale, status and decided_on of a decision record in Markdown.

    The summary is the first heading of the first level, the rationale what follows it; status and date count only
    where they stand before the first heading of the second level. All are null for a text without a title.
    """
    title = r"(?md)^#[ \t]+(\S.*?)[ \t]*$"
    summary = F.regexp_extract(text, title, 1)
    has = text.rlike(title)
    rest = F.regexp_replace(F.regexp_replace(text, r"(?sd)\A.*?(?:(?<=\n)|\A)#[ \t]+\S[^\n]*(?:\n|\z)", ""), r"\A\s+|\s+\z", "")
    header = F.regexp_replace(text, r"(?sd)(?:\A|(?<=\n))##\s.*", "")
    # the words after the label, whatever marks stand between, to the end of its line; the first date of the header
    label = F.regexp_extract(header, r"(?is)\bstatus\b\W*(.*)", 1)
    status = F.trim(F.regexp_extract(label, r"^\pL[\pL ]*\pL", 0))
    date = F.try_to_date(F.regexp_extract(header, r"(?<!\d)\d{4}-\d\d-\d\d(?!\d)", 0), "yyyy-MM-dd")
    filled = lambda c: F.when(has & (c != ""), c)
    return {"summary": filled(clean_text(summary)), "rationale": filled(clean_text(rest)), "status": filled(status), "decided_on": F.when(has, date)}
