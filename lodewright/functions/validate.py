"""Predicates on names and paths that come from outside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
SLUG = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}\z"
BRANCH = r"^(?![-/.])(?!.*(?:\.\.|//|@\{|[\x00-\x20~^:?*\[\\\x7f]))[^\n]{1,200}(?<![/.])(?<!\.lock)\z"
LONGEST_PATH = 4096


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def is_slug(text: Column) -> Column:
    return F.coalesce(text.rlike(SLUG), F.lit(False))


def is_branch(text: Column) -> Column:
    """Whether git would take text for a branch name, and not for an option or a range."""
    return F.coalesce(text.rlike(BRANCH), F.lit(False))


def is_inside(path: Column, *roots: str) -> Column:
    """Whether a resolved absolute path is one of the roots or lies below one."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | (path == root.rstrip("/")) | path.startswith(root.rstrip("/") + "/")
    return F.coalesce(inside & ~path.contains("\x00") & (F.length(path) <= LONGEST_PATH), F.lit(False))
