"""Path expressions, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve_path(path: Column, root: Column) -> Column:
    """The absolute path that path leads to from root, resolved lexically.

    A backslash separates like a slash; empty and "." segments vanish, ".." takes one segment back and
    stays at the top. Null if path or root is null.
    """
    slashed = F.translate(path, "\\", "/")
    whole = F.when(slashed.startswith("/"), slashed).otherwise(F.concat(root, F.lit("/"), slashed))
    steps = F.aggregate(
        F.split(whole, "/"),
        F.array().cast("array<string>"),
        lambda done, step: F.when(step.isin("", "."), done)
        .when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(step))),
    )
    plain = ~whole.rlike(r"//|/\.{1,2}(/|$)|/$")
    return F.when(plain, whole).otherwise(F.concat(F.lit("/"), F.array_join(steps, "/")))


def top_segment(path: Column) -> Column:
    """The first directory of a relative path; (root) for a file at the top."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("(root)"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The extension with its dot, lower-cased; empty for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=[^.])(\.[^.]+)$", 1))


def depth(path: Column) -> Column:
    return (F.size(F.split(path, "/")) - 1).cast("bigint")


def module_of(path: Column) -> Column:
    """A path without leading ./ and without its last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), r"(?<=[^/.])\.[^./]+$", "")
