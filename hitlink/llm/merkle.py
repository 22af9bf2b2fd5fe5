"""Operator 12: Merkle manifest of a data set, as a postorder append log.

Each row is a leaf digest; leaves of a source ascend by id, and every 16 consecutive nodes (the last run fewer) become
the node above until one is left, the subroot. Subroots, ordered by source, are the leaves of the tree of the root.

The log. Aligned builders own ``SPAN`` = 16^2 consecutive nodes of a tree and write the nodes above them in the order in which
they are complete (postorder), each builder's nodes being one stretch of the log. The position of a node follows from the
sizes of the subtrees before it: leaf j comes after floor(j / 16^m) complete nodes of each level m, so it lies at the sum of
floor(j / 16^m), and a node at level k lies k places behind its last leaf. Siblings are so addressed by arithmetic, without a
search or an index: a proof reads the places of its runs in its builder's stretch, then goes on in the stretch of the builder above.

At scale: numbering is a range partition by (source, id, digest) with running counts of the partitions, so a source of a third
of all rows spreads over many tasks. A builder holds at most SPAN digests. The stretches of each tier are written to the shared
folder; a tier has 1/256 of the nodes of the one below. Proofs go down the tiers: a stretch is sent with the one path above
it, not with one for each leaf. Texts are hashed by SQL functions and never shuffled.

Null fields are '-', so null and empty differ. Rows with a null id come first in their source; rows of equal id are ordered by
leaf digest; equal rows are leaves each. A null source is a tree of its own, before all others. A source of one row has that
leaf as subroot; with one source its subroot is the root. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitlink.llm.common import ascii_lower
from hitlink.session import materialize

FANOUT, TIER = 16, 2
SPAN = FANOUT**TIER


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def position(level: int, index: int, n: int) -> int:
    """Place of node ``index`` of ``level`` in the postorder log of a tree of ``n`` leaves."""
    leaf = min((index + 1) * FANOUT**level, n) - 1
    at, step = level, leaf
    while step:
        at, step = at + step, step // FANOUT
    return at


def stretch(leaves: list[str], levels: int) -> list[str]:
    """The log of an aligned builder: its leaves and the ``levels`` above them, in the order of completion."""
    out, waiting = [], [[] for _ in range(levels + 1)]
    for j, leaf in enumerate(leaves):
        out.append(leaf)
        waiting[0].append(leaf)
        for level in range(levels):
            if len(waiting[level]) < FANOUT and j + 1 < len(leaves):
                break
            node = digest(*waiting[level])
            waiting[level] = []
            waiting[level + 1].append(node)
            out.append(node)
    return out


def siblings(log: list[str], n: int, levels: int, leaf: int) -> Iterator[tuple[str, str]]:
    """(those to the left, those to the right) of a leaf and of its ancestors, level by level, each as one text."""
    index, width = leaf, n
    for level in range(levels):
        first, last = index - index % FANOUT, min(index - index % FANOUT + FANOUT, width)
        run = [log[position(level, i, n)] for i in range(first, last)]
        yield "".join(run[: index - first]), "".join(run[index - first + 1 :])
        index, width = index // FANOUT, -(-width // FANOUT)


def field(c: Column) -> Column:
    """`-` if null, else the UTF-8 byte count, `:` and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def numbered(df: DataFrame, tree: str, *order: str) -> DataFrame:
    """Adds ``idx``, the place of a row in its tree by ``order``, and ``n``, the rows of the tree. No window over a tree: rows
    are range-partitioned, and the counts of the partitions (one row for each that a tree reaches) give the offsets."""
    ranged = materialize(df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
                         .withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ranged")
    parts = ranged.groupBy(tree, "__part").agg(F.count("*").alias("rows"), F.min("__at").alias("first"))
    before = Window.partitionBy(tree).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(tree, "__part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
                         F.sum("rows").over(Window.partitionBy(tree)).alias("n"))
    return ranged.join(parts, [tree, "__part"]).withColumn("idx", F.col("__at") - F.col("first") + F.col("offset")).drop("__part", "__at", "first", "offset")


def _build(nodes: DataFrame) -> DataFrame:
    """(tree, section, n, levels, log, top, ids, altered): one row for each aligned builder. ``nodes``: tree, idx, n, digest and
    what goes with a node into the proofs, id and altered (null above the leaves)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        n, held = int(rows["n"].iloc[0]), rows["digest"].to_list()
        levels = min(TIER, height(n))
        log = stretch(held, levels)
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "section": [int(rows["idx"].iloc[0]) // SPAN], "n": [n], "levels": [levels], "log": [log],
                             "top": [log[-1]], "ids": [rows["id"].to_list()], "altered": [rows["altered"].to_list()]})

    # Ids go as text: a null among numbers would turn pandas columns into floats.
    return (nodes.select("tree", "idx", "n", "digest", F.col("id").cast("string"), "altered", F.expr(f"idx div {SPAN}").alias("__section"))
            .groupBy("tree", "__section")
            .applyInPandas(run, "tree string, section long, n long, levels int, log array<string>, top string, ids array<string>, altered array<string>"))


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """The builders of each tier, the lowest first; the last tier has one for each tree."""
    out = []
    while True:
        out.append(materialize(_build(nodes), f"merkle_tier{len(out)}"))
        if (out[-1].agg(F.max("n")).first()[0] or 0) <= SPAN:
            return out
        nodes = out[-1].select("tree", F.col("section").alias("idx"), F.ceil(F.col("n") / SPAN).cast("long").alias("n"), F.col("top").alias("digest"),
                               F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("altered"))


def log_nodes(tier: DataFrame) -> DataFrame:
    """(tree, section, position, digest): the log of a tier as one row for each node, ``position`` inside the stretch."""
    return tier.select("tree", "section", F.posexplode("log").alias("position", "digest"))


PATH = "array<struct<left:string,right:string>>"
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def _proofs(r: dict) -> Iterator[tuple[int, list[dict]]]:
    """(place in the stretch, path to the root) of each node that a builder started from."""
    n, above = len(r["ids"]), r["path"] or []
    for j in range(n):
        yield j, [{"left": a, "right": b} for a, b in siblings(r["log"], n, r["levels"], j)] + above


def _with_path(tier: DataFrame, above: DataFrame) -> DataFrame:
    return tier.join(above.withColumnRenamed("idx", "section"), ["tree", "section"] if "idx" in above.columns else ["tree"], "left")


def paths(tier: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, idx, path): siblings of each node of a tier, level by level up to the root, each level as one text to the left
    and one to the right; ``above`` has the path of each builder's top node as (tree, idx, path)."""
    kind = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("path", pa.list_(STEP))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"tree": r["tree"], "idx": r["section"] * SPAN + j, "path": p} for j, p in _proofs(r)], schema=kind)

    return _with_path(tier, above).select("tree", "section", "levels", "log", "ids", "path").mapInArrow(run, f"tree string, idx long, path {PATH}")


def verified(tier: DataFrame, above: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf: its path, and the root folded from the
    altered leaf if it has one. ``above`` also has subroot and root."""
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    kind = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in names], ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out = []
                for j, path in _proofs(r):
                    leaf, key = r["log"][position(0, j, len(r["ids"]))], r["ids"][j]
                    proof, node = hashlib.sha256(), r["altered"][j] or leaf
                    for step in path:
                        proof.update((step["left"] + step["right"]).encode())
                        node = digest(step["left"], node, step["right"])
                    out.append({"doc_id": None if key is None else int(key), "leaf": leaf, "subroot": r["subroot"], "root": r["root"],
                                "proof_sha256": proof.hexdigest(), "folded_root": node, "verified": node == r["root"]})
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    joined = _with_path(tier, above).select("levels", "log", "ids", "altered", "path", "subroot", "root")
    return joined.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} string" for c in names) + ", verified boolean")


class Manifest:
    """The logs of all trees of a table: ``sources`` has the tiers of the trees of sources, ``top`` those of the tree over
    them; ``upper`` is (tree, idx, path, subroot, root), the path of each subroot."""

    def __init__(self, df: DataFrame, fields: list[str], tree_col: str, id_col: str, altered: dict[str, Column] | None = None,
                 where_altered: Column | None = None):
        """``altered`` replaces fields by expressions in the rows where ``where_altered`` holds: their proofs are folded from
        the digest of the altered row."""
        changed = F.when(F.lit(False) if where_altered is None else where_altered,
                         leaf_digest(*[(altered or {}).get(c, F.col(c)) for c in fields]))
        tree = F.coalesce(F.concat(F.lit("+"), F.col(tree_col).cast("string")), F.lit(""))  # null before all, then by UTF-8 bytes
        rows = df.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf_digest(*[F.col(c) for c in fields]).alias("digest"),
                         changed.alias("altered"))
        self.sources = tiers(numbered(rows, "tree", "id", "digest"))
        subroots = self.sources[-1].select(F.lit("").alias("all"), F.col("tree").alias("source"), F.col("top").alias("digest"))
        subroots = materialize(numbered(subroots, "all", "source"), "subroots")
        nothing = F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("altered")
        self.top = tiers(subroots.select(F.col("all").alias("tree"), "idx", "n", "digest", *nothing))
        start = self.top[-1].select("tree", F.lit(0).cast("long").alias("idx"), F.array().cast(PATH).alias("path"))
        ends = self.top[-1].select(F.col("tree").alias("all"), F.col("top").alias("root"))
        places = self.down(self.top, start).select(F.col("tree").alias("all"), "idx", "path")
        self.upper = materialize(subroots.join(places, ["all", "idx"]).join(ends, "all").select(
            F.col("source").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"), "root"), "upper_paths")

    @staticmethod
    def down(levels: list[DataFrame], top: DataFrame) -> DataFrame:
        """(tree, idx, path) of the lowest tier's nodes, given those of the trees' tops."""
        for tier in reversed(levels):
            top = paths(tier, top)
        return top

    def _above_leaves(self) -> DataFrame:
        return self.down(self.sources[1:], self.upper.select("tree", "idx", "path"))

    def proofs(self) -> DataFrame:
        """(tree, idx, path) of every leaf."""
        return paths(self.sources[0], self._above_leaves())

    def verified(self) -> DataFrame:
        above = self._above_leaves().join(self.upper.select("tree", "subroot", "root"), "tree")
        return verified(self.sources[0], above)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return Manifest(docs, FIELDS, "source", "doc_id", {"text": ascii_lower(F.col("text"))}, tampered).verified()


def _oracle(levels: int = 6, source_levels: int = 4) -> str:
    """The trees level by level, then each leaf's siblings cut out of its run; sources of up to 16^levels rows."""
    h = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = "sha256(" + " || ".join(h(c) for c in FIELDS) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = "sha256(" + " || ".join(h(low if c == "text" else c) for c in FIELDS) + ")"
    crc = ("xor(list_reduce([xor(4294967295::UBIGINT, ascii(d[1])::UBIGINT)] || [ascii(x)::UBIGINT FOR x IN string_split(d[2:], '') IF x <> ''] || [0::UBIGINT], "
           "lambda c, b: xor(list_reduce([c] || range(8)::UBIGINT[], lambda a, i: xor(a >> 1, 3988292384::UBIGINT * (a & 1))), b)), 4294967295)")
    out = [f"d AS (SELECT *, CAST(doc_id AS VARCHAR) AS d, {leaf} AS leaf, {changed} AS changed FROM documents)",
           f"r AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, leaf) AS rid, doc_id, source, leaf, CASE WHEN {crc} % 5 = 0 THEN changed ELSE leaf END AS fold FROM d)",
           "s0 AS (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, rid FROM r)"]
    steps = ("{p}{k}r AS (SELECT tree, i // 16 AS j, string_agg(h, '' ORDER BY i) AS run FROM {p}{k} GROUP BY tree, i // 16), "
             "{p}{k}n AS (SELECT tree, count(*) AS n FROM {p}{k} GROUP BY tree), "
             "{p}{next} AS (SELECT tree, j AS i, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h FROM {p}{k}r JOIN {p}{k}n ON {p}{k}r.tree IS NOT DISTINCT FROM {p}{k}n.tree "
             "SELECT_TREE)").replace("SELECT tree, j", "SELECT {p}{k}r.tree AS tree, j").replace(" SELECT_TREE", "")
    out += [steps.format(p="s", k=k, next=k + 1) for k in range(levels)]
    out.append(f"t0 AS (SELECT 1 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, h, tree AS source FROM s{levels})")
    out += [steps.format(p="t", k=k, next=k + 1) for k in range(source_levels)]
    out.append("f0 AS (SELECT r.*, s0.i, t0.i AS si, t0.h AS subroot, fold AS node, '' AS proof FROM r JOIN s0 USING (rid) JOIN t0 ON t0.source IS NOT DISTINCT FROM r.source)")
    up = ("f{m} AS (SELECT f.* REPLACE (CASE WHEN n > 1 THEN proof || left(run, 64 * (f.{i} % 16)) || substr(run, 64 * (f.{i} % 16) + 65) ELSE proof END AS proof, "
          "CASE WHEN n > 1 THEN sha256(left(run, 64 * (f.{i} % 16)) || node || substr(run, 64 * (f.{i} % 16) + 65)) ELSE node END AS node, f.{i} // 16 AS {i}) "
          "FROM f{was} f JOIN {p}{k}r x ON x.tree IS NOT DISTINCT FROM {tree} AND x.j = f.{i} // 16 JOIN {p}{k}n y ON y.tree IS NOT DISTINCT FROM {tree})")
    out += [up.format(m=k + 1, was=k, k=k, p="s", i="i", tree="f.source") for k in range(levels)]
    out += [up.format(m=levels + k + 1, was=levels + k, k=k, p="t", i="si", tree="1") for k in range(source_levels)]
    return ("WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, x.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = x.h AS verified "
            f"FROM f{levels + source_levels}, t{source_levels} x")


ORACLE = _oracle()
