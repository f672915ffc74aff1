"""Numbers, bands and clamps shared by the scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the bands, and the weight of each severity.
BANDS = ((85, "excellent"), (70, "good"), (50, "fair"), (30, "poor"))
SEVERITY_WEIGHTS = {"info": 0.1, "low": 0.3, "medium": 0.55, "high": 0.8, "critical": 1.0}
# The weight of each analyzer in the overall score.
ANALYZER_WEIGHTS = {"git_history": 1.0, "architecture": 1.2, "dependencies": 1.0, "complexity": 1.0, "tech_debt": 1.0, "coupling": 0.9}


def rounded(x: Column, digits: int) -> Column:
    """Rounded half up on the decimal value, the same on every engine; null stays null."""
    return F.round(x.cast("decimal(38,12)"), digits).cast("double")


def python_rounded(x: Column, digits: int) -> Column:
    """Rounded half to even on the binary value, where that exact rule is wanted."""

    @F.pandas_udf("double")
    def to_even(values: pd.Series) -> pd.Series:
        return values.map(lambda v: round(v, digits), na_action="ignore")

    return to_even(x.cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds. Null, which means not measured, stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def signed_general(x: Column) -> Column:
    """x with its sign and at most six significant digits, without trailing zeros, as C's %+g prints it."""
    digits = F.format_string("%+.5e", x)
    power = F.regexp_extract(digits, r"e([+-]\d+)$", 1).cast("int")
    # six significant digits in plain notation, then without trailing zeros
    plain = F.regexp_replace(digits.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1")
    plain = F.concat(F.when(x >= 0, "+").otherwise(""), F.regexp_replace(plain, r"\.$", ""))
    short = F.regexp_replace(F.regexp_replace(digits, r"0+e", "e"), r"\.e", "e")
    return F.when(x == 0, "+0").when(power.between(-4, 5), plain).otherwise(short)


def guarded_ratio(x: Column, y: Column) -> Column:
    """x over y, where a y below one counts as one."""
    return x / F.greatest(y, F.lit(1))


def band(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, name in BANDS:
        out = out.when(score >= least, F.lit(name))
    return out.otherwise(F.lit("critical"))


def severity_weight(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHTS.items() for x in kv]), severity)
