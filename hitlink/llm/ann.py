"""Operator 8: nearest neighbours by inner product, by collision-counting hashing.

The index holds one sorted array of projections on each of ``projections`` random directions. A query's window on each
array is centred on its own projection; a vector collides on a direction when it lies in the window. Virtual rehashing
widens all windows by the same factor, round by round, and only the parts that are new are counted. A vector whose
collisions exceed the threshold is verified: its inner product is computed in double precision on the original vectors.
A query stops when its k-th best verified vector is so near that, at the present width, a vector at that distance would have
passed the threshold with the wanted ``confidence``; a window that holds everything ends the search as well.

Inner products become distances by one further component, sqrt(M^2 - |x|^2) for stored vectors and 0 for queries with M
the largest norm: then |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>. Every row is indexed; no sample is taken.

At scale: vectors are dealt into blocks of about ``block_rows`` by hash and queries into blocks of ``query_rows``; each task
builds the arrays of one block and answers one block of queries, so its memory is fixed by the two parameters. The best k of
each block are merged by query.

Vectors that are null, zero, of another length than the most frequent one, or hold null or non-finite components take no
part, nor do rows without an id. Ties go to the smaller id. Repeated rows of an id are candidates each; none is a
candidate of a query with its id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROJECTIONS = 24
THRESHOLD = 0.5
GROWTH = 1.2
FIRST_ROWS = 256  # of a block, whose distances say where the widths begin


def _normal(x: float) -> float:
    return 2 * 0.5 * (1 + math.erf(x / math.sqrt(2))) - 1


def safe_distance(width: float, projections: int, threshold: float, confidence: float) -> float:
    """The largest distance at which a vector passes the threshold with this confidence, if windows reach ``width`` to each
    side: a projection of a difference of length s is normal with deviation s."""
    low, high = 0.0, 1e6
    z = {0.9: 1.2816, 0.95: 1.6449, 0.99: 2.3263}[confidence]
    for _ in range(60):
        x = (low + high) / 2  # width / distance
        p = _normal(x)
        if p - z * math.sqrt(p * (1 - p) / projections) >= threshold:
            high = x
        else:
            low = x
    return width / high


def first_width(data: np.ndarray, queries: np.ndarray, norms: np.ndarray) -> float:
    """A distance at which few queries are done: of those to the nearest of the first rows, a low quantile."""
    near = norms - 2 * (queries @ data[:FIRST_ROWS].T).max(axis=1)
    return max(0.85 * float(np.sqrt(max(np.quantile(near, 0.1), 0))), 1e-3 * float(np.sqrt(norms.max())))


def search_block(ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: float, k: int,
                 projections: int = PROJECTIONS, threshold: float = THRESHOLD, confidence: float = 0.9, seed: int = 11,
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, id, score) of the best k found of each query, and the number of vectors verified. ``top`` is the largest
    norm of all vectors, not of the block's alone."""
    n, dims = data.shape
    directions = np.random.default_rng(seed).standard_normal((dims + 1, projections))
    extra = np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", data, data), 0))
    stored = data @ directions[:dims] + extra[:, None] * directions[dims]
    order = np.argsort(stored, axis=0, kind="stable")
    arrays = np.take_along_axis(stored, order, axis=0)
    columns = [np.ascontiguousarray(order[:, j]) for j in range(projections)]
    values = [np.ascontiguousarray(arrays[:, j]) for j in range(projections)]
    centres = queries @ directions[:dims]
    norms = np.einsum("ij,ij->i", queries, queries) + top * top
    least = math.floor(threshold * projections) + 1
    reach = safe_distance(1.0, projections, threshold, confidence)

    m = len(queries)
    low = np.stack([np.searchsorted(values[j], centres[:, j]) for j in range(projections)], axis=1)
    high = low.copy()
    counts = np.zeros((m, n), np.uint8)  # collisions, at most one a projection
    verified = np.zeros((m, n), bool)
    verified |= ids[None, :] == query_ids[:, None]  # a query is not its own neighbour
    scores = np.full((m, n), -np.inf)
    active, width, checked = np.arange(m), first_width(data, queries, norms) / reach, 0
    while len(active):
        below, above = low[active], high[active]
        for j in range(projections):
            low[active, j] = np.searchsorted(values[j], centres[active, j] - width)
            high[active, j] = np.searchsorted(values[j], centres[active, j] + width, "right")
        low, high = np.minimum(low, high), np.maximum(low, high)
        for row, q in enumerate(active):
            spans = zip(columns, low[q].tolist(), below[row].tolist(), above[row].tolist(), high[q].tolist())
            parts = [part for c, a, b, x, y in spans for part in (c[a:b], c[x:y])]
            counts[q] += np.bincount(np.concatenate(parts), minlength=n).astype(counts.dtype)
        new = (counts[active] >= least) & ~verified[active]
        everything = (low[active] == 0).all(axis=1) & (high[active] == n).all(axis=1)
        if everything.any():
            new |= everything[:, None] & ~verified[active]
        # Many candidates of many queries are cheaper to verify as one product of matrices.
        if new.mean() > 0.02:
            product = queries[active] @ data.T
            at = np.nonzero(new)
            scores[active[at[0]], at[1]] = product[at]
        else:
            at = np.nonzero(new)
            scores[active[at[0]], at[1]] = np.einsum("ij,ij->i", queries[active[at[0]]], data[at[1]])
        checked += len(at[0])
        verified[active] |= new
        kth = np.partition(scores[active], n - k, axis=1)[:, n - k] if n >= k else np.full(len(active), -np.inf)
        distance = np.sqrt(np.maximum(norms[active] - 2 * kth, 0))
        done = everything | (distance <= width * reach)
        active, width = active[~done], width * GROWTH
    rows, found, best = [], [], []
    for q in range(m):
        own = scores[q]
        good = np.flatnonzero(own >= max(np.partition(own, n - k)[n - k], -1e300) if n >= k else own > -np.inf)
        best_k = good[np.lexsort((ids[good], -own[good]))][:k]
        rows.append(np.full(len(best_k), q))
        found.append(ids[best_k])
        best.append((queries[q] * data[best_k]).sum(axis=1))  # one summation order whatever the block
    return np.concatenate(rows), np.concatenate(found), np.concatenate(best), checked


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector of doubles) of the rows that take part."""
    v = F.col("vector")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (lengths.n if lengths else 0))


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            block_rows: int = 8192, query_rows: int = 1024, confidence: float = 0.9) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found with the largest inner product for each row where ``is_query``
    holds (an expression on ``vec_id``)."""
    data = usable(df, id_col, vector_col)
    queries = data.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).dropDuplicates(["query_id"])
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    n, top, n_queries = data.agg(F.count("*"), F.max(norm), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(n_queries / query_rows))
    deal = lambda c, m: F.pmod(F.xxhash64(F.lit("block"), c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    stored = data.select("vec_id", "vector", deal("vec_id", blocks).alias("block"), every(query_blocks).alias("query_block"))
    asked = queries.select("query_id", "query", deal("query_id", query_blocks).alias("query_block"), every(blocks).alias("block"))
    if n == 0:
        top = 0.0

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = left["vec_id"].to_numpy()
        vectors, asked_ids = np.stack(left["vector"].to_list()), right["query_id"].to_numpy()
        q, found, score, _ = search_block(ids, vectors, asked_ids, np.stack(right["query"].to_list()), top, k, confidence=confidence)
        return pd.DataFrame({"query_id": asked_ids[q], "vec_id": found, "score": score})

    found = (stored.groupBy("block", "query_block").cogroup(asked.groupBy("block", "query_block"))
             .applyInPandas(search, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
