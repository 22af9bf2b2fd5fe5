"""Positions and running sums over a global order, with one exchange of the rows, and exact order statistics built on them.

Rows are range-partitioned on the sort key and sorted inside each range. A range's running sums are made as its rows pass by
(no window, so no second exchange), and the sums of the ranges before it are added in place from a table with one row
for each range. The sorted rows are written once, so the sums and the rows cannot come from two different divisions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FractionalType, LongType, StructField, StructType

from ..session import materialize
from .dedup import Order


def _sorted_ranges(df: DataFrame, order: Sequence[Order], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [o.sort_col() for o in order]
    return df.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("_pid", F.spark_partition_id())


def with_positions(df: DataFrame, order: Sequence[Order], name: str, partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (ties of the whole key in any order)."""
    # The id counts the rows of a partition one by one: the position inside the range, without a window.
    r = materialize(_sorted_ranges(df, order, partitions).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offs = r.groupBy("_pid").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offs = offs.select("_pid", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return r.join(F.broadcast(offs), "_pid").withColumn(name, F.col("_at") + F.col("_shift")).drop("_pid", "_at", "_shift")


def _running(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    """Adds inclusive running sums of ``cols`` over each partition as it lies; NULL counts as 0."""
    kinds = {f.name: f.dataType for f in df.schema}
    added = [StructField(prefix + c, DoubleType() if isinstance(kinds[c], FractionalType) else LongType()) for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = dict.fromkeys(cols, 0)
        for batch in batches:
            out = list(batch.columns)
            for c, f in zip(cols, added):
                whole = isinstance(f.dataType, LongType)
                x = batch[c].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64 if whole else np.float64)
                sums = np.cumsum(x) + before[c]
                if len(sums):
                    before[c] = sums[-1]
                out.append(pa.array(sums, pa.int64() if whole else pa.float64()))
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *[f.name for f in added]])

    return df.mapInArrow(run, StructType([*df.schema.fields, *added]))


def with_running_sums(df: DataFrame, order: Sequence[Order], cols: Sequence[str], partitions: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``cols`` in ``order``."""
    r = materialize(_running(_sorted_ranges(df, order, partitions), cols, prefix), "ranges")
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = r.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in cols])
    offs = offs.select("_pid", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_off_{c}") for c in cols])
    out = r.join(F.broadcast(offs), "_pid").withColumns({prefix + c: F.col(prefix + c) + F.col(f"_off_{c}") for c in cols})
    return out.drop("_pid", *[f"_off_{c}" for c in cols])


# ---- order statistics ------------------------------------------------------------------------------------------------

def value_counts_long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), nulls: bool = False) -> DataFrame:
    """(by..., feature, value, n): how often each value of each column occurs, NULLs left out unless ``nulls``. Counted where
    the rows lie before anything is shuffled."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    long = df.select(*by, F.explode(arr).alias("_p")).select(*by, "_p.*")
    if not nulls:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def held_out_counts(counts: DataFrame, helds: Sequence[int], fold_col: str = "fold") -> DataFrame:
    """(held, feature, value, n) from counts by fold: for each fold that is held out, those of the other folds together. Written."""
    held = counts.sparkSession.createDataFrame([(h,) for h in helds], "held int")
    each = materialize(counts, "fold_counts").crossJoin(F.broadcast(held)).where(F.col(fold_col) != F.col("held"))
    return materialize(each.groupBy("held", "feature", "value").agg(F.sum("n").alias("n")), "fold_counts")


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, total, q): exact quantiles of ``value_counts_long`` rows, interpolated linearly between the two
    neighbouring order statistics; ``q`` is an array in the order of ``probs``. NaN counts as the largest value.

    No group is gathered anywhere: counts are sorted over ranges, running counts tell which range holds a wanted rank, and
    only the rows with a wanted rank are fetched, for all groups, columns and probabilities at once."""
    keys = [*by, "feature"]
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    rows = materialize(_running(_sorted_ranges(counts, [Order(k, nulls_last=False) for k in keys] + [Order("value")], None), ["n"], "cum_"), "value_counts")
    # The running count of a range goes over all its groups; a group's own begins at its first row there.
    parts = rows.groupBy(*keys, "_pid").agg(F.sum("n").alias("rows"), F.min(F.col("cum_n") - F.col("n")).alias("base"))
    in_group = Window.partitionBy(*keys)  # one row for each range that a group reaches
    before = F.coalesce(F.sum("rows").over(in_group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*keys, "_pid", "rows", "base", before.alias("before"), F.sum("rows").over(in_group).alias("total"))
    # Wanted ranks (0-based), each in the one range that holds it.
    w = parts.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("at", "p")).withColumn("place", F.col("p") * (F.col("total") - 1))
    w = w.select("*", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank"))
    w = w.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("rows"))).distinct()
    w = w.select(*keys, "_pid", "at", "place", "rank", "total", (F.col("rank") - F.col("before") + F.col("base")).alias("local"))
    r, x = rows.alias("r"), w.alias("x")
    hit = [F.col(f"r.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys] + [F.col("r._pid") == F.col("x._pid")]
    found = r.join(x, hit).where((F.col("x.local") >= F.col("r.cum_n") - F.col("r.n")) & (F.col("x.local") < F.col("r.cum_n")))
    found = found.select(*[F.col(f"x.{k}").alias(k) for k in keys], "at", "place", "rank", "total", "value")
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    between = F.when(low == high, low).otherwise(low + (high - low) * (F.col("place") - F.floor("place")))
    one = found.groupBy(*keys, "total", "at", "place").agg(between.alias("q"))
    return one.groupBy(*keys, "total").agg(F.sort_array(F.collect_list(F.struct("at", "q"))).alias("q")).select(*keys, "total", F.col("q.q").alias("q"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, total, q): exact quantiles of each column and group; columns and groups without a value have no row."""
    return quantiles_of_counts(value_counts_long(df, cols, by), probs, by)
