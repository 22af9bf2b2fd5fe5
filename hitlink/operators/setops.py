"""Set operations (O1-O5) over DataFrames; word-set operations are array
functions in ``functions.text``."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linkage import key_union  # noqa: F401  (O4 lives with the joins)


def union_aligned(*frames: DataFrame) -> DataFrame:
    """O1: union by column name; a column missing on one side is NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_all(*frames: DataFrame) -> DataFrame:
    """O2: union of frames with the same columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def append_new(existing: DataFrame, batch: DataFrame, keys: Sequence[str], distinct: bool = False) -> DataFrame:
    """O3: append only the batch rows whose key is not already present, so a
    replayed batch changes nothing (the reference appends old matches again, D9).
    Keys are identities: a missing part equals a missing part. With ``distinct``
    a key that a batch holds more than once is appended once (any of its rows)."""
    new = not_present(batch, existing, keys)
    return existing.unionByName(new.dropDuplicates(list(keys)) if distinct else new)


def not_present(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key ``done`` does not hold; NULL equals NULL."""
    seen = done.select(*[F.col(k).alias(f"_seen{j}") for j, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for j, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_seen{j}"))
    return rows.join(seen, same, "left_anti")
