"""Aggregations and statistics (A1-A23) as single-pass DataFrame aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import quantiles_of_counts, value_counts_long


def per_group_report(stages: dict[str, DataFrame], by: str) -> DataFrame:
    """Row count per group for each stage, plus a total row (``by`` NULL)."""
    parts = [df.rollup(by).agg(F.count(F.lit(1)).alias(name)) for name, df in stages.items()]

    def join(a, b):
        return a.join(b, a[by].eqNullSafe(b[by]), "left").drop(b[by])

    out = reduce(join, parts)
    return out.fillna(0, subset=list(stages)[1:])


def _stack(row_struct_cols: list, alias: str = "s") -> "F.Column":
    """One struct per feature in an array, to be exploded into long form."""
    return F.explode(F.array(*row_struct_cols)).alias(alias)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A1."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """A2: share of positives."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("positive_share"), F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, cols) -> DataFrame:
    """A3: count, mean, std (n-1), min, exact quartiles (linear), max per column, one row per column.

    Everything comes from the counts of distinct values, which are made where the rows lie: the moments are one small
    aggregate over them, the quartiles are selected by ``ordered.quantiles_of_counts``. Squares are taken about each column's
    mean."""
    return summary_of_counts(materialize(value_counts_long(df, cols), "value_counts_long"), cols)


def summary_of_counts(counts: DataFrame, cols) -> DataFrame:
    """A3 from (feature, value, n)."""
    cols = list(cols)
    n, v = F.col("n"), F.col("value")
    first = counts.groupBy("feature").agg(F.sum("n").alias("count"), (F.sum(v * n) / F.sum("n")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    # One row per column on the right.
    squares = counts.join(F.broadcast(first.select("feature", "mean")), "feature").groupBy("feature").agg(
        F.sum((v - F.col("mean")) * (v - F.col("mean")) * n).alias("_ss"))
    q = quantiles_of_counts(counts, [0.25, 0.5, 0.75]).select("feature", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"))
    names = counts.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return (names.join(first, "feature", "left").join(squares, "feature", "left").join(q, "feature", "left")
            .select("feature", F.coalesce("count", F.lit(0)).alias("count"), "mean",
                    F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / (F.col("count") - 1))).alias("std"), "min", "p25", "p50", "p75", "max"))


def missing_audit(df: DataFrame, cols) -> DataFrame:
    """A4: NULL count per column, only columns that have any."""
    one = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols]
    return one.select(_stack(rows)).select("s.*").filter(F.col("missing") > 0)


def pivot_counts(df: DataFrame, row: str, col: str, values) -> DataFrame:
    """A5: counts per (row, col value) as columns, absent = 0."""
    p = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return p.fillna(0, subset=[str(v) for v in values])


def welch_moments(df: DataFrame, label: str, cols) -> DataFrame:
    """A10 without the p-value: per feature the two class means, their
    difference, Welch's t and its degrees of freedom. One pass: rows are
    unpivoted to (feature, label, value) and aggregated per feature."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(F.col(label).alias("_y"), F.explode(arr).alias("p")).select("_y", "p.*")
    aggs = []
    for k in (1, 0):
        x = F.when(F.col("_y") == k, F.col("v"))
        aggs += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"m{k}"), F.var_samp(x).alias(f"v{k}")]
    g = long.groupBy("feature").agg(*aggs)
    n1, n0, m1, m0 = F.col("n1"), F.col("n0"), F.col("m1"), F.col("m0")
    a, b = F.col("v1") / n1, F.col("v0") / n0
    return g.select("feature", m1.alias("mean_hits"), m0.alias("mean_non_hits"), (m1 - m0).alias("difference"),
                    ((m1 - m0) / F.sqrt(a + b)).alias("t"),
                    ((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1))).alias("dof"))


def student_t_two_sided_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t: I_{dof/(dof+t^2)}(dof/2, 1/2), the
    regularised incomplete beta by its continued fraction (no scipy needed)."""
    import math
    if t is None or dof is None or math.isnan(t) or math.isnan(dof) or dof <= 0:
        return float("nan")
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))

    def cf(a, b, x):
        tiny, eps = 1e-300, 1e-15
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 10000):
            m2 = 2 * m
            aa = m * (b - m) * x / ((a + m2 - 1) * (a + m2))
            d = 1.0 + aa * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + aa / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
            aa = -(a + m) * (a + b + m) * x / ((a + m2) * (a + m2 + 1))
            d = 1.0 + aa * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + aa / c
            c = c if abs(c) > tiny else tiny
            delta = d * c
            h *= delta
            if abs(delta - 1.0) < eps:
                break
        return h

    if x < (a + 1.0) / (a + b + 2.0):
        return front * cf(a, b, x) / a
    return 1.0 - front * cf(b, a, 1.0 - x) / b


def with_p_values(moments: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds the two-sided p-value of (t, dof) and whether it is below ``alpha``, by an Arrow-batched pandas function over
    the per-feature rows (one row per feature, after the aggregate)."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([student_t_two_sided_p(a, b) for a, b in zip(t, dof)], dtype="float64")

    return moments.withColumn("p_value", p_value("t", "dof")).withColumn("significant", F.col("p_value") < alpha)


def welch_test(df: DataFrame, label: str, cols, alpha: float = 0.05) -> DataFrame:
    """A10: Welch's t-test per feature with its two-sided p-value."""
    return with_p_values(welch_moments(df, label, cols), alpha)


def split_significant(tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The features whose class means differ significantly, and the others (those without a p-value too)."""
    yes = F.coalesce(F.col("significant") & ~F.isnan("p_value"), F.lit(False))
    return tested.filter(yes), tested.filter(~yes)


def outliers_iqr(df: DataFrame, cols, k: float = 3.0) -> DataFrame:
    """Q1, Q3, IQR, count outside [Q1 - k*IQR, Q3 + k*IQR] and its share of
    all rows (NULLs count in the denominator). Quartiles and counts both come from the counts of distinct values."""
    return outliers_of_counts(materialize(value_counts_long(df, cols), "value_counts_long"), cols, df.count(), k)


def outliers_of_counts(counts: DataFrame, cols, total: int, k: float = 3.0) -> DataFrame:
    """A12 from (feature, value, n) of ``total`` rows."""
    cols = list(cols)
    q = quantiles_of_counts(counts, [0.25, 0.75]).select("feature", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    outside = (F.col("value") < F.col("q1") - k * iqr) | (F.col("value") > F.col("q3") + k * iqr)
    out = counts.join(q, "feature").groupBy("feature").agg(F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outliers"))
    names = counts.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return (names.join(q, "feature", "left").join(out, "feature", "left").withColumn("outliers", F.coalesce("outliers", F.lit(0)))
            .select("feature", "q1", "q3", iqr.alias("iqr"), "outliers", (F.col("outliers") * 100.0 / F.lit(total)).alias("pct_rows")))


def _pair_moments(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per pair of columns: rows where both are present, their means, and the sums of squares and products about
    the means. Sums are taken about the means of the task's first rows, so large offsets cost no digits."""
    k = len(names)
    count, x_sum, xx, xy = (np.zeros((k, k)) for _ in range(4))
    shift = None
    for batch in batches:
        values = np.column_stack([batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in names]) if batch.num_rows else np.zeros((0, k))
        there = ~np.column_stack([np.asarray(batch[c].is_null()) for c in names]) if batch.num_rows else np.zeros((0, k), bool)
        if shift is None and len(values):
            shift = np.where(there, values, 0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
            shift = np.where(np.isfinite(shift), shift, 0)
        if len(values):
            x, m = np.where(there, values - shift, 0), there.astype(np.float64)
            count, x_sum, xx, xy = count + m.T @ m, x_sum + x.T @ m, xx + (x * x).T @ m, xy + x.T @ x
    i, j = np.triu_indices(k, 1)
    n = count[i, j]
    safe = np.maximum(n, 1)
    a, b = x_sum[i, j] / safe, x_sum[j, i] / safe
    zero = np.zeros(k) if shift is None else shift
    columns = {"n": n, "ma": zero[i] + a, "mb": zero[j] + b, "va": xx[i, j] - safe * a * a, "vb": xx[j, i] - safe * b * b, "c": xy[i, j] - safe * a * b}
    yield pa.RecordBatch.from_arrays([pa.array([names[p] for p in i]), pa.array([names[p] for p in j]), *[pa.array(v) for v in columns.values()]],
                                     names=["f1", "f2", *columns])


def _merge_moments(parts: pd.DataFrame) -> pd.DataFrame:
    """Pearson r of one pair from the moments of all tasks."""
    out = parts[["f1", "f2"]].head(1).copy()
    parts = parts[parts["n"] > 0]
    n = parts["n"].sum()
    r = None
    if n > 1:
        a, b = ((parts["n"] * parts[m]).sum() / n for m in ("ma", "mb"))
        da, db = parts["ma"] - a, parts["mb"] - b
        va, vb = ((parts[v] + parts["n"] * d * d).sum() for v, d in (("va", da), ("vb", db)))
        if va > 0 and vb > 0:
            r = (parts["c"] + parts["n"] * da * db).sum() / math.sqrt(va) / math.sqrt(vb)
    out["r"] = pd.Series([r], index=out.index, dtype="float64")
    return out


def correlations(df: DataFrame, cols) -> DataFrame:
    """Pearson r for every pair (upper triangle), pairwise complete, in one
    pass. Each task keeps one co-moment matrix of its rows (matrix products over
    Arrow batches) and sends a row per pair; these are merged about the overall
    means. NULL where fewer than two rows are complete or a side is constant."""
    names = list(cols)
    moments = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(
        lambda batches: _pair_moments(batches, names), "f1 string, f2 string, n double, ma double, mb double, va double, vb double, c double")
    return moments.groupBy("f1", "f2").applyInPandas(lambda parts: _merge_moments(parts), "f1 string, f2 string, r double")


def strong_pairs(corr: DataFrame, threshold: float = 0.7) -> DataFrame:
    """A14."""
    return corr.filter(F.abs(F.col("r")) > threshold)


def histogram(df: DataFrame, col: str, bins: int, by=(), density: bool = True) -> DataFrame:
    """Equal-width bins over each group's own [min, max], last bin closed
    (numpy rules, including a constant column: range widened by 0.5 each side).
    Returns group, bin, count and density = count / (n * width)."""
    by = list(by)
    x = F.col(col)
    d = df.filter(x.isNotNull())
    grouped = bool(by)
    if not grouped:  # one overall range: join it on a constant key
        d, by = d.withColumn("_all", F.lit(0)), ["_all"]
    rng = d.groupBy(*by).agg(F.min(x).cast("double").alias("_mn"), F.max(x).cast("double").alias("_mx"),
                              F.count(F.lit(1)).alias("_n"))
    rng = (rng.withColumn("_lo", F.when(F.col("_mx") == F.col("_mn"), F.col("_mn") - 0.5).otherwise(F.col("_mn")))
              .withColumn("_hi", F.when(F.col("_mx") == F.col("_mn"), F.col("_mx") + 0.5).otherwise(F.col("_mx"))))
    j = d.join(rng, by)  # one row per group; broadcast only where its size is measured as small
    b = F.least(F.floor((x.cast("double") - F.col("_lo")) * F.lit(float(bins)) / (F.col("_hi") - F.col("_lo"))),
                F.lit(bins - 1)).cast("int")
    counts = j.groupBy(*by, b.alias("bin"), "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    out = counts.withColumn("bin_start", F.col("_lo") + F.col("bin") * width)
    if density:
        out = out.withColumn("density", F.col("count") / (F.col("_n") * width))
    out = out.drop("_lo", "_hi", "_n")
    return out if grouped else out.drop("_all")


def box_stats(df: DataFrame, col: str, by: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles per group and whiskers at the last point inside 1.5 IQR."""
    counts = materialize(value_counts_long(df, [col], [by]), "value_counts_long")
    q = quantiles_of_counts(counts, [0.25, 0.5, 0.75], [by])
    q = q.select(F.col(by).alias("_by"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr, x = F.col("q3") - F.col("q1"), F.col("value")
    inside_lo, inside_hi = F.when(x >= F.col("q1") - whisker * iqr, x), F.when(x <= F.col("q3") + whisker * iqr, x)
    return (counts.join(q, F.col(by).eqNullSafe(F.col("_by"))).groupBy(by, "q1", "median", "q3")
            .agg(F.min(inside_lo).alias("whisker_low"), F.max(inside_hi).alias("whisker_high")))


def bucket_counts(df: DataFrame, bucket: str, buckets) -> DataFrame:
    """Count per bucket in bucket order, empty buckets shown as 0."""
    spark = df.sparkSession
    order = spark.createDataFrame([(b, i) for i, b in enumerate(buckets)], f"{bucket} string, bucket_order int")
    n = df.filter(F.col(bucket).isNotNull()).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(order).join(n, bucket, "left").select(bucket, "bucket_order", F.coalesce("n", F.lit(0)).alias("n"))
