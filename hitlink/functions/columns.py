"""Casts, derived columns and simple predicates (P1-P19) as Column expressions.

ANSI mode is on by default in Spark 4, so a plain ``cast`` of bad text raises;
every coercion here is a ``try_`` form that yields NULL instead, like pandas
``errors="coerce"``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def standardise_names(df: DataFrame) -> DataFrame:
    """Strip, lower, spaces to underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def to_long(c) -> Column:
    """Numeric coercion through double ("12.0" -> 12, "x" -> NULL)."""
    return _c(c).cast("string").try_cast("double").try_cast("bigint")


def to_int(c) -> Column:
    return _c(c).cast("string").try_cast("double").try_cast("int")


def year_of(c) -> Column:
    """Year of a date text; bad text -> NULL."""
    return F.year(F.try_to_timestamp(_c(c).cast("string")))


def year_prefix(c) -> Column:
    """Year from the first four characters."""
    return F.substring(_c(c).cast("string"), 1, 4).try_cast("int")


def decade(c) -> Column:
    """P5: year // 10 * 10 (NULL stays NULL)."""
    return (F.floor(_c(c) / 10) * 10).cast("int")


def is_explicit(c) -> Column:
    """Bool -> 0/1, NULL -> 0."""
    return F.coalesce(_c(c).cast("int"), F.lit(0))


def label_name(c, names: dict | None = None) -> Column:
    """Label to display text; unmapped -> NULL."""
    names = names or {1: "Billboard Hit", 0: "Non-hit"}
    out = None
    for k, v in names.items():
        out = (F.when(_c(c) == k, F.lit(v)) if out is None else out.when(_c(c) == k, F.lit(v)))
    return out


def minutes(c) -> Column:
    """Milliseconds to minutes."""
    return _c(c) / 60000.0


def present(c) -> Column:
    """Null-state flag."""
    return _c(c).isNotNull()


def select_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """P10: ordered selection keeping only the columns that exist."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P11 (``drop`` ignores missing names)."""
    return df.drop(*cols)


def with_if_absent(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Derive a column only if it is absent."""
    return df if name in df.columns else df.withColumn(name, expr)


def non_empty(c) -> Column:
    """Cleaned key neither NULL nor empty after stripping."""
    from .text import strip
    return _c(c).isNotNull() & (F.length(strip(c)) > 0)


def in_trailing_window(year_col, target_col, width: int = 3) -> Column:
    """Year in {Y, Y-1, ..., Y-width+1}."""
    return _c(year_col).between(_c(target_col) - (width - 1), _c(target_col))


def not_equal_keep_null(c, value) -> Column:
    """``x != v`` with pandas semantics (a NULL x is kept)."""
    return ~_c(c).eqNullSafe(F.lit(value))


def rank_bucket(c) -> Column:
    """Right-closed bins (0,10], (10,50], (50,100]; outside -> NULL."""
    x = _c(c)
    return (F.when((x > 0) & (x <= 10), F.lit("Top 10"))
             .when((x > 10) & (x <= 50), F.lit("11-50"))
             .when((x > 50) & (x <= 100), F.lit("51-100")))


RANK_BUCKETS = ["Top 10", "11-50", "51-100"]


def round_half_even(c, places: int = 3) -> Column:
    """Numpy-style rounding for display."""
    return F.bround(_c(c), places)


def optional_range(c, start=None, end=None) -> Column:
    """Optional inclusive range; None or 0 means that end is open."""
    cond = F.lit(True)
    if start:
        cond = cond & (_c(c) >= F.lit(start))
    if end:
        cond = cond & (_c(c) <= F.lit(end))
    return cond
