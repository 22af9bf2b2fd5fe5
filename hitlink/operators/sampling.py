"""Exact-size, repeatable samples, shuffles, splits and folds.

A row's draw is ``md5(key || '|' || seed)``: repeatable, independent of
partitioning, and the same in DuckDB, so samples can be checked by SQL.

``exact_sample`` keeps the n rows with the smallest draw without a global sort
and without a window over a whole group. It counts rows per 16-bit draw prefix
(at most 65,536 buckets per group), finds per group the bucket where the running
count passes n, keeps every row below that bucket and ranks only inside it. The
ranking window is partitioned by (group, bucket), so even a group holding a
third of all rows is spread over 65,536 small windows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "_smp_bucket"
_H = "_smp_draw"


def draw(key: str | Column, seed: int = 42, ties: Sequence[str] = ()) -> Column:
    """A missing key draws by the tie-break columns, so such rows are spread too."""
    k = F.col(key) if isinstance(key, str) else key
    missing = F.concat_ws("|", F.lit("missing"), *[F.col(t).cast("string") for t in ties])
    return F.md5(F.concat(F.coalesce(k.cast("string"), missing), F.lit(f"|{seed}")))


def same_group(left: DataFrame, right: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Join on group columns where NULL is a group like any other; the left side's columns stay."""
    r = right.select(*[F.col(c).alias(f"_g{j}") for j, c in enumerate(by)], *[c for c in right.columns if c not in by])
    on = F.lit(True)
    for j, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{j}"))
    return left.join(r, on, how).drop(*[f"_g{j}" for j in range(len(by))])


def exact_sample(df: DataFrame, n, key: str, seed: int = 42,
                 by: Sequence[str] = (), tiebreak: Sequence[str] = (), few_groups: bool = False) -> DataFrame:
    """Per group of ``by`` (or overall), the ``n`` rows with the smallest draw;
    all rows of a group that has fewer (pandas ``sample(min(n, len))``).

    ``few_groups`` (years, labels): the groups' cut-offs are sent to the rows, which are then not dealt by group.

    ``n`` is an int, or a Column holding a scalar (e.g. ``other.select(count).scalar()``).
    NULL keys and NULL groups are keys and groups like any other.
    """
    by = list(by)
    ties = [key] + [t for t in tiebreak if t != key]
    nval = F.lit(n) if isinstance(n, int) else n
    d = df.withColumn(_H, draw(key, seed, tiebreak)).withColumn(_B, F.substring(_H, 1, 4))
    hist = d.groupBy(*by, _B).agg(F.count(F.lit(1)).alias("_cnt"))
    w = (Window.partitionBy(*by) if by else Window).orderBy(_B) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_cum", F.sum("_cnt").over(w))
    # Per group: the first bucket whose running count reaches n, and how many rows
    # of it are still needed. Groups that never reach n keep everything.
    cut = (hist.filter(F.col("_cum") >= nval)
               .groupBy(*by)
               .agg(F.min_by(F.struct(F.col(_B).alias("_cut"),
                                      (nval - (F.col("_cum") - F.col("_cnt"))).alias("_need")),
                             F.col(_B)).alias("_c"))
               .select(*by, "_c._cut", "_c._need"))
    if by:
        j = same_group(d, F.broadcast(cut) if few_groups else cut, by, "left")
    else:
        c = cut.select(F.struct("_cut", "_need")).scalar()
        j = d.withColumn("_cut", c.getField("_cut")).withColumn("_need", c.getField("_need"))
    # Rows below the cut bucket pass straight through; only that bucket is shuffled and ranked.
    below = j.filter(F.col("_cut").isNull() | (F.col(_B) < F.col("_cut")))
    rw = Window.partitionBy(*by, _B).orderBy(F.col(_H), *[F.col(t) for t in ties])
    at_cut = j.filter(F.col(_B) == F.col("_cut")).withColumn("_rk", F.row_number().over(rw)).filter(F.col("_rk") <= F.col("_need"))
    return below.select(*df.columns).unionByName(at_cut.select(*df.columns))


def exact_sample_strict(df: DataFrame, n: int, key: str, seed: int = 42,
                        tiebreak: Sequence[str] = ()) -> DataFrame:
    """As ``exact_sample``, but fails like pandas when fewer than n rows exist."""
    have = df.count()
    if have < n:
        raise ValueError(f"Cannot take a sample of {n} rows from {have}")
    return exact_sample(df, n, key, seed, tiebreak=tiebreak)


def shuffle_order(key: str, seed: int = 42) -> Column:
    """A seeded permutation as a sort key."""
    return draw(key, seed)


def shuffle_positions(df: DataFrame, key: str, seed: int = 42, name: str = "pos") -> DataFrame:
    """The 1-based position of every row in a seeded full shuffle."""
    return _rank_per_group(df, [], key, seed).withColumnRenamed("_r", name)


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2,
                     seed: int = 42, name: str = "is_test") -> DataFrame:
    """M2: exact stratified split. Within each label the ``round(f * n_label)``
    rows with the smallest draw are test rows (labels are a bounded group set)."""
    d = df.withColumn(_H, draw(key, seed, [label])).withColumn(_B, F.substring(_H, 1, 4))
    hist = d.groupBy(label, _B).agg(F.count(F.lit(1)).alias("_cnt"))
    of_label = Window.partitionBy(label)  # at most 65,536 bucket counts per label
    running = of_label.orderBy(_B).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.select("*", F.sum("_cnt").over(running).alias("_cum"), F.round(F.sum("_cnt").over(of_label) * test_fraction).cast("long").alias("_k"))
    # Per label: the bucket in which the last test row lies, and how many rows of it are test rows.
    cut = hist.filter(F.col("_cum") >= F.col("_k")).groupBy(label).agg(
        F.min_by(F.struct(F.col(_B).alias("_cut"), (F.col("_k") - F.col("_cum") + F.col("_cnt")).alias("_need")), F.col(_B)).alias("_c"))
    j = same_group(d, F.broadcast(cut.select(label, "_c._cut", "_c._need")), [label], "left")
    # Only the rows of that bucket are shuffled and ranked.
    other = j.filter(~F.col(_B).eqNullSafe(F.col("_cut"))).withColumn(name, F.col(_B) < F.col("_cut"))
    rw = Window.partitionBy(label, _B).orderBy(F.col(_H), F.col(key))
    at_cut = j.filter(F.col(_B) == F.col("_cut")).withColumn(name, F.row_number().over(rw) <= F.col("_need"))
    columns = [*[c for c in df.columns if c != name], name]
    return other.select(*columns).unionByName(at_cut.select(*columns))


def fold_column(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                name: str = "fold") -> DataFrame:
    """M8: stratified folds 0..k-1 (rank of the draw within the label, modulo k)."""
    ranked = _rank_per_group(df, [label], key, seed)
    return ranked.withColumn(name, ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def _rank_per_group(df: DataFrame, by: Sequence[str], key: str, seed: int) -> DataFrame:
    """Exact 1-based rank of the draw within each group, without a window over the
    whole group: rows are counted per 16-bit prefix bucket, bucket offsets come
    from a running sum over at most 65,536 counts per group, and only the rows of
    one bucket share a window."""
    by = list(by)
    d = df.withColumn(_H, draw(key, seed, by)).withColumn(_B, F.substring(_H, 1, 4))
    hist = d.groupBy(*by, _B).agg(F.count(F.lit(1)).alias("_cnt"))
    # At most 65,536 bucket counts per group feed this running sum.
    w = (Window.partitionBy(*by) if by else Window).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offs = hist.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0))).drop("_cnt")
    j = same_group(d, F.broadcast(offs), by + [_B], "inner")  # sent, so that the rows are shuffled once, for the window
    rw = Window.partitionBy(*by, _B).orderBy(F.col(_H), F.col(key))
    return j.withColumn("_r", F.col("_off") + F.row_number().over(rw)).drop(_H, _B, "_off")
