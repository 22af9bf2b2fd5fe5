"""Record linkage (J1-J14): ordered lookup passes, anti-joins, scored candidates.

Joins are plain equi-joins: Catalyst picks sort-merge or, when AQE measures a
side under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` at run time, a
broadcast join. That is the size-checked broadcast with a shuffle fallback. A
hot key on the big side is split by AQE's skew-join handling. Every lookup side
is made unique per key first, so a link never multiplies rows
(``count(link(x)) == count(x)``).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .dedup import Order, keep_best


@dataclass
class Pass:
    """One lookup pass: left key columns matched to right key columns.

    ``right`` must be unique on ``right_keys`` (use ``unique_lookup``)."""
    name: str
    right: DataFrame
    left_keys: Sequence[str | Column]
    right_keys: Sequence[str]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joinable(c: Column) -> Column:
    """Key part usable for matching: NULL and "" never match anything."""
    return F.when(c.cast("string") != "", c)


def unique_lookup(right: DataFrame, keys: Sequence[str], order: Sequence[Order]) -> DataFrame:
    """The lookup side reduced to its best row per key."""
    return keep_best(right, keys, order)


def link(left: DataFrame, passes: Sequence[Pass], payload: Sequence[str],
         pass_col: str = "match_pass", unmatched: str = "none", prefix: str = "") -> DataFrame:
    """Try the passes in order; the first that finds a row wins.

    Adds the ``payload`` columns of the matched right row (NULL when unmatched),
    named ``prefix + column``, and ``pass_col`` naming the winning pass.
    """
    out = left
    found = []
    for i, p in enumerate(passes):
        rk = [f"_lk{i}_{j}" for j in range(len(p.right_keys))]
        r = p.right.select(*[F.col(k).alias(a) for k, a in zip(p.right_keys, rk)],
                           F.struct(*[F.col(c) for c in payload]).alias(f"_m{i}"))
        lk = [f"_lkl{i}_{j}" for j in range(len(p.left_keys))]
        out = out.withColumns({a: joinable(_col(k)) for k, a in zip(p.left_keys, lk)})
        cond = [out[a] == r[b] for a, b in zip(lk, rk)]
        out = out.join(r, cond, "left").drop(*lk, *rk)
        found.append((p.name, F.col(f"_m{i}")))
    chosen = F.coalesce(*[m for _, m in found])
    which = F.lit(unmatched)
    for name, m in reversed(found):
        which = F.when(m.isNotNull(), F.lit(name)).otherwise(which)
    out = out.withColumn("_match", chosen).withColumn(pass_col, which)
    out = out.select(*[c for c in left.columns], *[F.col(f"_match.{c}").alias(prefix + c) for c in payload],
                     pass_col)
    return out


def anti_join(left: DataFrame, keys_df: DataFrame, left_keys: Sequence[str | Column],
              right_keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``keys_df``. NULL/empty keys on
    the right never exclude anything (unlike SQL ``NOT IN`` with NULLs)."""
    r = keys_df.select(*[joinable(F.col(k)).alias(f"_ak{j}") for j, k in enumerate(right_keys)]).distinct()
    la = [f"_akl{j}" for j in range(len(left_keys))]
    l2 = left.withColumns({a: _col(k) for k, a in zip(left_keys, la)})
    cond = [l2[a] == r[f"_ak{j}"] for j, a in enumerate(la)]
    return l2.join(r, cond, "left_anti").drop(*la)


def key_union(*pairs: tuple[DataFrame, Sequence[str]], names: Sequence[str]) -> DataFrame:
    """Distinct union of key tuples taken from several frames."""
    out = None
    for df, cols in pairs:
        part = df.select(*[F.col(c).alias(n) for c, n in zip(cols, names)])
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def best_candidate(cands: DataFrame, song_id: str, score: str, threshold: float,
                   popularity: str, cand_pos: str) -> DataFrame:
    """Candidates with score >= threshold; best by score, then popularity
    (missing = 0), then candidate position. One row per song."""
    q = cands.filter(F.col(score) >= F.lit(threshold))
    pop = F.coalesce(F.col(popularity).cast("double"), F.lit(0.0))
    order = F.struct((-F.col(score)).alias("s"), (-pop).alias("p"), F.col(cand_pos).alias("pos"))
    return (q.groupBy(song_id)
             .agg(F.min_by(F.struct(*[F.col(c) for c in q.columns if c != song_id]), order).alias("_b"))
             .select(song_id, "_b.*"))


def most_popular_candidate(cands: DataFrame, song_id: str, popularity: str, cand_pos: str,
                           min_popularity: float = 10) -> DataFrame:
    """Candidates with popularity >= ``min_popularity``; the most popular, first on ties."""
    pop = F.coalesce(F.col(popularity).cast("double"), F.lit(0.0))
    q = cands.filter(pop >= F.lit(min_popularity))
    order = F.struct((-pop).alias("p"), F.col(cand_pos).alias("pos"))
    return (q.groupBy(song_id)
             .agg(F.min_by(F.struct(*[F.col(c) for c in q.columns if c != song_id]), order).alias("_b"))
             .select(song_id, "_b.*"))


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Order], k: int,
                  name: str = "cand_pos", salt_buckets: int = 64, salt_col: str | None = None) -> DataFrame:
    """The first ``k`` rows per key (a search result list of size k).

    Two levels so a hot key is not ranked in one task: rank within
    (key, hash-salt) and keep k, then rank the at most k * salt_buckets
    survivors per key. The result equals a single ranking per key.
    """
    keys = list(keys)
    sort = [o.sort_col() for o in order]
    salt = F.abs(F.xxhash64(F.col(salt_col) if salt_col else F.struct(*[F.col(c) for c in df.columns]))) % salt_buckets
    d = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*sort)
    d = d.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*sort)
    return d.withColumn(name, F.row_number().over(w2)).filter(F.col(name) <= k)


def matched_split_counts(linked: DataFrame, source: DataFrame, match_col: str) -> DataFrame:
    """Matched / unmatched counts; fails if any input row was lost or duplicated. ``linked`` is evaluated once."""
    status = F.when(F.col(match_col).isNull(), F.lit("unmatched")).otherwise(F.lit("matched"))
    counts = materialize(linked.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n")), "split_counts")
    got = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    want = source.count()
    if got != want:
        raise AssertionError(f"linkage changed the row count: {want} in, {got} out")
    return counts
