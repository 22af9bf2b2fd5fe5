"""Operator 11: near-duplicate embeddings by NN-descent, within equal labels.

Equal vectors of a label are one node with its number of copies. A node has a signature, the signs of ``BITS`` random
projections, whose Hamming distance estimates the angle; a neighbour list holds the ``k`` nodes of least distance.

Refining. Lists start from neighbours in sorted orders of the signatures, each order by other bits. In a round every node
compares its neighbours, and the nodes it is a neighbour of, with each other (neighbours of neighbours; only pairs with an entry
that is new), and a pair enters a list when it is nearer than that list's last. Rounds end when they hardly bring entries
within reach of the threshold. A distance is in reach when a linked pair might have it (``z`` deviations of the estimate).

Enlarging. A list whose k entries are all in reach is saturated: its node may have more links. Saturated nodes are gathered
into cells (nodes adopt the least leader in reach that a neighbour has, until nothing changes), and their lists are enlarged to
whole cells: their own and those of their neighbours. Entries of such a list are not written out. With angles a(x), a(y) to
a cell's mean, a(x) + a(y) <= the threshold's angle proves a link and |a(x) - a(y)| beyond it rules one out, so a node's
certain links are a lookup in the cell's cumulated counts of angles; what is neither is compared in blocks, of which each node
gets a count and one node it is connected with. A large group of near copies so takes work in proportion to its size unless its
angles leave its links in doubt; then it is the exact comparisons of those in doubt.

Audit. ``AUDIT_NODES`` nodes, the least by hash, are compared with every node; if on average less than ``recall`` of a
node's links were found, k is doubled, further sorted orders are added and the rounds go on.

Links are pairs with a cosine, in double precision on the original vectors, of ``threshold`` or more. Rows with null label or
id, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing and are a component each
(null id: component null, kept). Vectors of different lengths never link. Repeated rows of an id are vectors each, so they link
with one another. Scaled vectors have cosine 1. Zeros of different sign make different nodes (of cosine 1).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitlink.llm.common import lists
from hitlink.llm.components import components
from hitlink.session import materialize

BITS = 128                       # of a signature: two longs
K, TABLES, FOLLOWING = 10, 8, 3  # entries of a list, sorted orders to begin with, neighbours taken to each side
SETTLED = 0.002                 # a round that adds fewer entries in reach, by share, is the last
AUDIT_NODES, RECALL = 1024, 0.99
BINS = 64                        # of angles in a cell
BLOCK = 2048                     # nodes of a block of comparisons
MARGIN = 1e-6                    # radians


def reach(threshold: float, z: float = 3.5) -> int:
    """The greatest Hamming distance that a pair at the threshold has, up to ``z`` deviations."""
    p = math.acos(threshold) / math.pi
    return min(BITS, math.ceil(BITS * p + z * math.sqrt(BITS * p * (1 - p))))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles, times a power of two, which changes no cosine."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -exponent[:, None]) if np.abs(exponent).max(initial=0) > 300 else x


def vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each length of vectors in a list column."""
    sizes = np.asarray(column.value_lengths())
    flat, first = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out.append((rows, scaled(flat[first[rows][:, None] + np.arange(n)].astype(np.float64))))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sign_bits(matrix: np.ndarray, seed: int) -> np.ndarray:
    directions = np.random.default_rng([seed, matrix.shape[1]]).standard_normal((matrix.shape[1], BITS))
    return np.ascontiguousarray(np.packbits(matrix @ directions > 0, axis=1)).view(np.int64)


def hamming(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Distance of the signatures (a, b) and (c, d)."""
    return F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))


def best_of(u: np.ndarray, v: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least (distance, node) of each u, each v once."""
    order = np.lexsort((v, d, u))
    u, v = u[order], v[order]
    fresh = np.ones(len(u), bool)
    fresh[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    order, u = order[fresh], u[fresh]
    starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, int)
    rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(u)]])))
    return order[rank < k]


def pairs_batch(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.int32())], names=["u", "v", "d"])


# ---- nodes -----------------------------------------------------------------------------------------------------------

def rows_and_nodes(df: DataFrame, id_col: str, vector_col: str, label_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) of all rows, node null where the row takes no part, and (node, part, s0, s1, copies, vector)."""
    v, label = F.col(vector_col), F.col(label_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    takes_part = F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    salt = 0
    while True:
        node = F.when(F.coalesce(takes_part, F.lit(False)), F.xxhash64(F.lit(salt), label, v))
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), node.alias("node"), F.xxhash64(label, F.size(v)).alias("part"),
                         F.xxhash64(F.lit("other"), v, label).alias("other"), v.alias("vector"))
        nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
            F.first("part").alias("part"), F.first("vector").alias("vector"), F.count("*").alias("copies"), (F.min("other") != F.max("other")).alias("mixed"))

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.zeros((batch.num_rows, 2), np.int64)
                for at, matrix in vectors(batch["vector"]):
                    out[at] = sign_bits(matrix, seed)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(out[:, 0]), pa.array(out[:, 1])], names=[*batch.schema.names, "s0", "s1"])

        kind = nodes.schema["vector"].dataType.simpleString()
        nodes = materialize(nodes.select("node", "part", "vector", "copies", "mixed").mapInArrow(
            sign, f"node long, part long, vector {kind}, copies long, mixed boolean, s0 long, s1 long"), "nodes")
        if not nodes.where("mixed").limit(1).count():  # two different vectors with one hash: take another hash
            return materialize(rows.select("vec_id", "node"), "rows"), nodes.drop("mixed")
        salt += 1


# ---- the graph -------------------------------------------------------------------------------------------------------

def sorted_pairs(nodes: DataFrame, tables: range, following: int, seed: int) -> DataFrame:
    """(u, v, d), both ways: each node and the next ``following`` in some sorted orders of the signatures, within its label."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.stack([batch["s0"].to_numpy(), batch["s1"].to_numpy()], axis=1)
            bits = np.unpackbits(sig.view(np.uint8), axis=1)
            for t in tables:
                chosen = np.random.default_rng([seed, t]).permutation(BITS)[:63]
                code = np.packbits(np.concatenate([np.zeros((len(bits), 1), np.uint8), bits[:, chosen]], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), t, np.int32)), batch["part"], pa.array(np.ascontiguousarray(code).view(">i8")[:, 0].astype(np.int64)),
                                                  batch["node"], batch["s0"], batch["s1"]], names=["t", "part", "code", "node", "s0", "s1"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)
        for batch in batches:
            new = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("t", "part", "node", "s0", "s1")])
            rows, fresh = np.concatenate([held, new], axis=1), held.shape[1]
            found = []
            for step in range(1, following + 1):
                a = np.arange(max(0, fresh - step), rows.shape[1] - step)
                b = a + step
                same = (rows[0, a] == rows[0, b]) & (rows[1, a] == rows[1, b])
                a, b = a[same], b[same]
                d = np.bitwise_count((rows[3, a] ^ rows[3, b]).view(np.uint64)).astype(np.int32) + np.bitwise_count((rows[4, a] ^ rows[4, b]).view(np.uint64))
                found += [(rows[2, a], rows[2, b], d), (rows[2, b], rows[2, a], d)]
            held = rows[:, -following:]
            u, v, d = (np.concatenate(x) for x in zip(*found))
            yield pairs_batch(u, v, d)

    order = ["t", "part", "code"]
    return (nodes.select("part", "node", "s0", "s1").mapInArrow(codes, "t int, part long, code long, node long, s0 long, s1 long")
            .repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(near, "u long, v long, d int"))


def nearest_k(found: DataFrame, k: int) -> DataFrame:
    """(u, v, d, fresh): the k least of each node; ``found`` has (u, v, d, fresh), a pair that was known before being not fresh.
    Ranks are dense, so a pair that comes again takes one place, and each task drops what is beyond k before the one exchange."""
    order = Window.partitionBy("u").orderBy("d", "v")
    ranked = found.select("u", "v", "d", "fresh", F.dense_rank().over(order).alias("at")).where(F.col("at") <= k)
    return ranked.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))


def local_join(graph: DataFrame, nodes: DataFrame, k: int, in_reach: int) -> DataFrame:
    """(u, v, d) of neighbours of neighbours that are nearer to u than its last entry. A saturated list stays as it is: it will
    be enlarged, and nearer entries in place of others in reach would tell nothing new."""
    both = graph.select("u", "v", "d", "fresh").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", "fresh"))
    around = nearest_k(both, 2 * k)  # neighbours and nodes whose neighbour u is
    last = graph.groupBy("u").agg(F.max("d").alias("last"), F.count("*").alias("n"))
    last = last.select(F.col("u").alias("v"), F.when(F.col("n") < k, F.lit(BITS + 1)).when(F.col("last") <= in_reach, F.lit(-1))
                       .otherwise(F.col("last")).cast("int").alias("last"))
    known = nodes.select(F.col("node").alias("v"), "s0", "s1").join(last, "v")
    entry = F.struct("v", "s0", "s1", "last", "fresh")
    grouped = around.select("u", "v", "fresh").join(known, "v").groupBy("u").agg(F.collect_list(entry).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["of"]
            sizes, flat = np.asarray(column.value_lengths()), column.flatten()
            fields = {f: flat.field(f).to_numpy(zero_copy_only=False) for f in ("v", "s0", "s1", "last", "fresh")}
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at = first[:, None] + np.arange(sizes.max(initial=0))
            real = np.arange(at.shape[1])[None, :] < sizes[:, None]
            at = np.where(real, at, 0)
            v, s0, s1, last_of, fresh = (fields[f][at] for f in ("v", "s0", "s1", "last", "fresh"))
            found = []
            for i in range(at.shape[1]):  # the i-th of each list against all others of it
                d = (np.bitwise_count((s0[:, [i]] ^ s0).view(np.uint64)).astype(np.int32) + np.bitwise_count((s1[:, [i]] ^ s1).view(np.uint64)))
                want = real & real[:, [i]] & ((fresh[:, [i]] > 0) | (fresh > 0)) & (d < last_of[:, [i]]) & (v != v[:, [i]])
                r, j = np.nonzero(want)
                found.append((v[r, i], v[r, j], d[r, j]))
            if not found:
                continue
            u, w, d = (np.concatenate(x) for x in zip(*found))
            keep = best_of(u, w, d, k)
            yield pairs_batch(u[keep], w[keep], d[keep])

    return grouped.select("of").mapInArrow(run, "u long, v long, d int")


def descend(start: DataFrame, nodes: DataFrame, k: int, in_reach: int) -> DataFrame:
    """The neighbour graph (u, v, d, fresh), refined until a round brings hardly anything in reach."""
    graph = materialize(nearest_k(start, k), "graph")
    while True:
        found = local_join(graph, nodes, k, in_reach).withColumn("fresh", F.lit(1))
        graph = materialize(nearest_k(graph.withColumn("fresh", F.lit(0)).unionByName(found), k), "graph")
        near = F.col("d") <= in_reach
        new, all_near = graph.agg(F.count_if(near & (F.col("fresh") == 1)), F.count_if(near)).first()
        if new <= SETTLED * all_near:
            return graph


# ---- links -----------------------------------------------------------------------------------------------------------

def exact(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, copies_a, copies_b) of the pairs that link."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("vector").alias(f"v{x}"), F.col("copies").alias(f"copies_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.zeros(batch.num_rows)
            for (at, x), (_, y) in zip(vectors(batch["va"]), vectors(batch["vb"])):
                cosine[at] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield batch.filter(pa.array(cosine >= threshold)).select(["a", "b", "copies_a", "copies_b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, copies_a long, copies_b long")


def cells_of(dense: DataFrame, nodes: DataFrame, edges: DataFrame, in_reach: int) -> tuple[DataFrame, DataFrame]:
    """(node, cell) of the saturated nodes and the (cell, other) that touch, each cell with itself too."""
    state = dense.join(nodes.select("node", "s0", "s1"), "node").select("node", "s0", "s1", F.struct(F.col("node").alias("cell"), F.col("s0").alias("l0"), F.col("s1").alias("l1")).alias("leader"))
    state = materialize(state, "leaders")
    while True:
        # A node hears of its neighbours' leaders and of its own leader's.
        heard = edges.unionByName(state.select(F.col("node").alias("u"), "leader.cell").where("u <> cell").withColumnRenamed("cell", "v"))
        offers = heard.join(state.select(F.col("node").alias("v"), "leader"), "v").groupBy(F.col("u").alias("node"), "leader").agg(F.lit(1).alias("one"))
        near = hamming(F.col("s0"), F.col("s1"), F.col("offered.l0"), F.col("offered.l1")) <= in_reach
        joined = state.join(offers.select("node", F.col("leader").alias("offered")), "node", "left")
        new = joined.groupBy("node", "s0", "s1", "leader").agg(F.min(F.when(near, F.col("offered"))).alias("offer"))
        new = materialize(new.select("node", "s0", "s1", F.least("leader", "offer").alias("leader"), (F.col("offer") < F.col("leader")).alias("changed")), "leaders")
        state = new.drop("changed")
        if not new.where("changed").limit(1).count():
            break
    cells = state.select("node", F.col("leader.cell").alias("cell"))
    of = lambda x: cells.select(F.col("node").alias(x), F.col("cell").alias(f"c{x}"))
    touch = edges.join(of("u"), "u").join(of("v"), "v").select(F.col("cu").alias("cell"), F.col("cv").alias("other"))
    return cells, touch.unionByName(cells.select("cell", F.col("cell").alias("other"))).distinct()


def with_angle(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the angle of ``vector`` to ``centre``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = np.zeros(batch.num_rows)
            for (at, x), (_, c) in zip(vectors(batch["vector"]), vectors(batch["centre"])):
                angle[at] = np.arccos(np.clip(np.einsum("ij,ij->i", unit(x), c), -1, 1))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], batch["vector"], pa.array(angle)], names=[*columns, "vector", "angle"])

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*columns, "vector", "centre").mapInArrow(run, ", ".join(f"{c} {fields[c]}" for c in [*columns, "vector"]) + ", angle double")


def centres(members: DataFrame) -> DataFrame:
    """(cell, centre): the direction of the mean; each batch sends one sum for a cell."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch["cell"].to_numpy()
            for at, x in vectors(batch["vector"]):
                codes, found = pd.factorize(cell[at])
                sums = np.zeros((len(found), x.shape[1]))
                np.add.at(sums, codes, unit(x))
                yield pa.RecordBatch.from_arrays([pa.array(found), lists(sums.ravel(), [x.shape[1]] * len(found), pa.float64())], names=["cell", "total"])

    def mean(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(rows["total"].to_list()), axis=0)
        norm = np.linalg.norm(total)
        return pd.DataFrame({"cell": [key[0]], "centre": [total / norm if norm > 0 else np.eye(1, len(total))[0]]})

    return members.select("cell", "vector").mapInArrow(add, "cell long, total array<double>").groupBy("cell").applyInPandas(mean, "cell long, centre array<double>")


def connected(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the rows and columns of a bipartite graph: equal if connected, the number of a row (-1: no link)."""
    rows, big = np.arange(len(mask)), len(mask)
    while True:
        columns = np.where(mask, rows[:, None], big).min(axis=0, initial=big)
        new = np.minimum(rows, np.where(mask, columns[None, :], big).min(axis=1, initial=big))
        if (new == rows).all():
            return rows, np.where(columns == big, -1, columns)
        rows = new


def dense_links(cells: DataFrame, touch: DataFrame, nodes: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, links) of saturated nodes among themselves, copies and the node itself counted in, and (a, b), pairs of nodes in one component."""
    full = math.acos(threshold)
    members = materialize(nodes.select("node", "vector", "copies").join(cells, "node"), "members")
    middle = materialize(centres(members), "centres")
    own = with_angle(members.join(middle, "cell"), ["node", "cell", "copies"])
    own = materialize(own.withColumn("bin", F.least(F.lit(BINS), F.floor(F.col("angle") / full * BINS)).cast("int")), "angles")
    bins = own.groupBy("cell", "bin").agg(F.sum("copies").alias("n"), F.max("angle").alias("most"), F.min(F.struct("angle", "node")).alias("first"))
    cell = bins.groupBy("cell").agg(F.collect_list(F.struct("bin", "n")).alias("bins"), F.max("most").alias("most"), F.max("bin").alias("last_bin"), F.min("first").alias("first"))
    cell = cell.select(F.col("cell").alias("other"), "bins", "most", "last_bin", F.col("first.angle").alias("first_angle"), F.col("first.node").alias("first_node"))

    rows = own.select("node", "cell", "copies", "vector").join(touch, "cell").join(middle.select(F.col("cell").alias("other"), "centre"), "other")
    rows = with_angle(rows, ["node", "other"]).join(cell, "other").where(F.col("angle") - F.lit(full + MARGIN) <= F.col("most"))
    # Members in bins up to ``sure`` are linked: the upper edge of the bin and the angle add to less than the threshold's.
    sure = F.floor((F.lit(full - MARGIN) - F.greatest("angle", "first_angle")) / full * BINS).cast("int") - 1
    rows = rows.withColumn("sure", sure).withColumn("certain", F.aggregate(
        "bins", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bin"] <= F.col("sure"), x["n"]).otherwise(F.lit(0))))
    rows = materialize(rows.select("node", "other", "angle", "sure", "certain", "first_node", (F.col("sure") < F.col("last_bin")).alias("open"), "vector"), "cell_rows")
    counts = rows.select("node", F.col("certain").alias("links"))
    pairs = rows.where("certain > 0").select(F.col("node").alias("a"), F.col("first_node").alias("b"))

    asked = rows.where("open")
    sizes = asked.groupBy("other").agg(F.count("*").alias("asked"), F.min("sure").alias("sure"), F.max("angle").alias("widest"))
    held = own.select(F.col("cell").alias("other"), "node", "copies", "vector", "bin", "angle").join(sizes, "other").where(
        (F.col("bin") > F.col("sure")) & (F.col("angle") <= F.col("widest") + full + MARGIN))
    sizes = sizes.join(held.groupBy("other").agg(F.count("*").alias("held")), "other")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    deal = lambda n: F.pmod(F.xxhash64(F.lit("block"), "node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sizes = sizes.select("other", blocks("asked").alias("nx"), blocks("held").alias("ny"))
    left = asked.select("other", "node", "sure", "vector").join(sizes, "other").select("other", "node", "sure", "vector", deal(F.col("nx")).alias("x"), every(F.col("ny")).alias("y"))
    right = held.select("other", "node", "copies", "bin", "vector").join(sizes, "other").select("other", "node", "copies", "bin", "vector", deal(F.col("ny")).alias("y"), every(F.col("nx")).alias("x"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        x, y = (np.stack(t["vector"].to_list()).astype(np.float64) for t in (a, b))
        cosine = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
        ids, others = a["node"].to_numpy(), b["node"].to_numpy()
        mask = ((cosine >= threshold) | (ids[:, None] == others[None, :])) & (b["bin"].to_numpy()[None, :] > a["sure"].to_numpy()[:, None])
        one, two = connected(mask)
        linked = two >= 0
        return pd.DataFrame({"node": np.concatenate([ids, others[linked]]), "links": np.concatenate([mask @ b["copies"].to_numpy(), np.zeros(linked.sum(), np.int64)]),
                             "root": np.concatenate([ids[one], ids[two[linked]]])})

    key = ["other", "x", "y"]
    compared = materialize(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "node long, links long, root long"), "compared")
    counts = counts.unionByName(compared.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    pairs = pairs.unionByName(compared.select(F.col("node").alias("a"), F.col("root").alias("b"))).where("a <> b").distinct()
    return counts, pairs


def true_links(nodes: DataFrame, sample: list, threshold: float) -> DataFrame:
    """(node, links): of the sampled nodes, against all nodes, copies counted, own ones not."""
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r.vector), []).append((r.node, r.part, np.array(r.vector, np.float64)))
    sent = {n: (np.array([r[0] for r in x]), np.array([r[1] for r in x]), unit(scaled(np.stack([r[2] for r in x])))) for n, x in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, part, copies = (batch[c].to_numpy() for c in ("node", "part", "copies"))
            for at, x in vectors(batch["vector"]):
                if x.shape[1] not in sent:
                    continue
                ids, parts, matrix = sent[x.shape[1]]
                hit = (unit(x) @ matrix.T >= threshold) & (part[at][:, None] == parts[None, :]) & (node[at][:, None] != ids[None, :])
                n = copies[at] @ hit
                yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0], pa.int64())], names=["node", "links"])

    return nodes.select("node", "part", "copies", "vector").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    k: int = K, tables: int = TABLES, following: int = FOLLOWING, recall: float = RECALL, block: int = BLOCK, seed: int = 7,
                    ) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``df``."""
    rows, nodes = rows_and_nodes(df, id_col, vector_col, label_col, seed)
    in_reach = reach(threshold)
    sample = nodes.orderBy(F.xxhash64(F.lit("audit"), "node"), "node").limit(AUDIT_NODES).select("node", "part", "vector").collect()
    truth = materialize(true_links(nodes, sample, threshold), "audit")
    start = sorted_pairs(nodes, range(tables), following, seed).withColumn("fresh", F.lit(1))
    used = tables
    while True:
        graph = descend(start, nodes, k, in_reach)
        near = graph.where(F.col("d") <= in_reach)
        dense = materialize(near.groupBy(F.col("u").alias("node")).count().where(F.col("count") == k).select("node"), "saturated")
        is_dense = lambda x: dense.select(F.col("node").alias(x), F.lit(True).alias(f"dense_{x}"))
        pairs = near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct().join(is_dense("a"), "a", "left").join(is_dense("b"), "b", "left")
        both = F.col("dense_a").isNotNull() & F.col("dense_b").isNotNull()
        pairs = materialize(pairs.select("a", "b", both.alias("dense")), "pairs")
        links = materialize(exact(pairs.where("NOT dense").select("a", "b"), nodes, threshold), "links")
        counts = links.select(F.col("a").alias("node"), F.col("copies_b").alias("links")).unionByName(links.select(F.col("b").alias("node"), F.col("copies_a").alias("links")))
        edges = links.select("a", "b")
        if dense.limit(1).count():
            inner = pairs.where("dense")
            inner = materialize(inner.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(inner.select(F.col("b").alias("u"), F.col("a").alias("v"))), "dense_edges")
            cells, touch = cells_of(dense, nodes, inner, in_reach)
            inside, joined = dense_links(cells, touch, nodes, threshold, block)
            own = nodes.join(dense, "node").select("node", (-F.col("copies")).alias("links"))  # a node is in its own cell
            counts = counts.unionByName(inside).unionByName(own)
            edges = edges.unionByName(joined)
        counts = materialize(counts.groupBy("node").agg(F.sum("links").alias("links")), "link_counts")
        found = truth.join(counts.withColumnRenamed("links", "found"), "node", "left").agg(F.avg(F.coalesce("found", F.lit(0)) / F.col("links"))).first()[0]
        if found is None or found >= recall:
            break
        more = sorted_pairs(nodes, range(used, used + tables), following, seed).withColumn("fresh", F.lit(1))
        start = graph.withColumn("fresh", F.lit(1)).unionByName(more)
        k, used = 2 * k, used + tables

    component = components(edges, "a", "b").select(F.col("id").alias("node"), "component")
    of_node = nodes.select("node", "copies").join(counts, "node", "left").join(component, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    taking = materialize(rows.where("node IS NOT NULL").join(of_node, "node").select("vec_id", "n_links", "component"), "taking_part")
    least = taking.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = taking.join(least, "component").select("vec_id", "n_links", "component_id")
    alone = rows.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
