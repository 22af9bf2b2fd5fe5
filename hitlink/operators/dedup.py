"""Deduplication: keep the best row per key.

``keep_best`` is one aggregate per key, the row with the least sort key. It is
partial: each task keeps the first row of each of its keys, so a key holding a
third of all rows moves as one row per task.

Orders are total: callers pass a final tie-breaker so results do not depend on
partitioning (the reference's single-key sorts are unstable).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Order:
    """One sort key: column, direction, null placement (nulls last by default,
    which is what pandas does in both directions)."""

    def __init__(self, col: str | Column, desc: bool = False, nulls_last: bool = True):
        self._col = col
        self.desc = desc
        self.nulls_last = nulls_last

    @property
    def col(self) -> Column:
        return F.col(self._col) if isinstance(self._col, str) else self._col

    def sort_col(self) -> Column:
        c = self.col
        if self.desc:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()


def asc(c, nulls_last=True) -> Order:
    return Order(c, False, nulls_last)


def desc(c, nulls_last=True) -> Order:
    return Order(c, True, nulls_last)


def ascending_key(order: Sequence[Order], df: DataFrame) -> Column:
    """A struct whose least value belongs to the first row in ``order``, exact for all types: a descending key is replaced
    by one in opposite order (integers and dates by their bitwise complement, so 64-bit keys lose nothing; text by its
    complemented hexadecimal digits with an end sign above all of them)."""
    fields = []
    for i, o in enumerate(order):
        c, dtype = o.col, df.select(o.col).schema.fields[0].dataType
        values = [c]
        if o.desc:
            if isinstance(dtype, T.BooleanType):
                values = [~c]
            elif isinstance(dtype, T.IntegralType):
                values = [F.bitwise_not(c)]
            elif isinstance(dtype, T.DecimalType):
                values = [-c]
            elif isinstance(dtype, (T.FloatType, T.DoubleType)):
                values = [~F.isnan(c), -c]  # NaN is the largest value, negated too
            elif isinstance(dtype, T.DateType):
                values = [F.bitwise_not(F.unix_date(c))]
            elif isinstance(dtype, T.TimestampType):
                values = [F.bitwise_not(F.unix_micros(c))]
            elif isinstance(dtype, (T.StringType, T.BinaryType)):
                values = [F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))]
            else:
                raise TypeError(f"no descending order for {dtype.simpleString()}")
        empty = c.isNull() if o.nulls_last else c.isNotNull()
        fields += [empty.alias(f"n{i}"), *[v.alias(f"v{i}_{j}") for j, v in enumerate(values)]]
    return F.struct(*fields)


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Order],
              isolate_empty: bool = False) -> DataFrame:
    """One row per ``keys``, the first in ``order``.

    ``isolate_empty`` keeps every row whose key has a NULL or empty-string part
    instead of collapsing them into one group (the reference merges all songs
    whose key normalises to "" into one).
    """
    cols = df.columns
    group = list(keys)
    if isolate_empty:
        # Rows with an empty key part form a group of their own: a per-row id joins
        # the grouping key, so they are neither merged nor sent to one task.
        empty = F.lit(False)
        for k in keys:
            empty = empty | F.col(k).isNull() | (F.col(k).cast("string") == "")
        df = df.withColumn("_iso", F.when(empty, F.monotonically_increasing_id()))
        group.append("_iso")
    best = df.groupBy(*group).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), ascending_key(order, df)).alias("_best"))
    return best.select("_best.*")


def first_seen(df: DataFrame, id_col: str, order: Sequence[Order]) -> DataFrame:
    """An id is kept only at its first occurrence in ``order`` (across groups),
    even when that occurrence is later filtered out by the caller."""
    return keep_best(df, [id_col], order)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Order], name: str = "rn") -> DataFrame:
    """Row number per key; for bounded groups only (e.g. per-song candidate lists)."""
    w = Window.partitionBy(*keys).orderBy(*[o.sort_col() for o in order])
    return df.withColumn(name, F.row_number().over(w))
