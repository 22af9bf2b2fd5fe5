"""Operator 13: audit of how far the sources of a language differ in their words, by three-dimensional cube partitioning.

Every (language, source) group and every language has a smoothed share p = 1 + floor(10^9 (count + 2) / (N + 2 V)) of each
kept term (V terms in at least ``min_docs`` documents of the language, N the counts of the kept terms). The divergence of two
groups is the sum over all kept terms of floor((p - q)^2 / (p + q)); all numbers are whole, so any order of adding gives them.

The cube has two axes of groups and one of terms. Groups and terms are dealt into blocks by hash, and a cell (group block,
group block, term block) owns the partial divergences of its pairs over its terms. A slice of counts (group block, term
block) is sent to each cell of its row and column; a cell is a dense matrix of at most about ``group_block`` x ``term_block``
shares for each side. Divergences are symmetric, so cells lie on or above the diagonal. The last step adds the cells of a pair
along the term axis.

At scale: texts are read once; each task counts its own words and sends a (language, source, term) when its table is full,
so frequent words are pre-aggregated. Terms are shuffled once, by (language, term), for counts and document frequencies alike.
A cell is bounded by the block sizes whatever the sizes of sources, languages and vocabularies. Shares are computed in
decimals before the cube, so counts may be of any size.

Null text, lang and source count as ''. An empty or blank text, or one without letters, is a document without terms, whose
group still takes part: it has p of count 0 for each kept term. Repeated rows are documents each. A language without kept
terms gives pairs of value 0; a group alone in its language has no pair. Ties of value go to the smaller item by UTF-8
bytes. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitlink.llm.common import texts
from hitlink.session import materialize

GROUP_BLOCK, TERM_BLOCK = 32, 8192
TABLE_ENTRIES = 400_000  # of a task's table of counts, before it is sent

# A-Z to a-z; all other ASCII to a space; bytes of longer characters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and non-ASCII characters, A-Z in lower case."""
    return text.translate(_LETTERS).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, n_docs), partial: a term of a group has a row for each task and table."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("n_docs", pa.int64())])

    def send(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs_of) in held.items():
            if counts:
                size = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size), pa.array([source] * size), pa.array(list(counts), pa.binary()).cast(pa.string()),
                     pa.array(list(counts.values()), pa.int64()), pa.array([docs_of[t] for t in counts], pa.int64())], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts(batch["text"])):
                words = terms_of(text)
                if not words:
                    continue
                pair = held.get((lang, source))
                if pair is None:
                    pair = held[(lang, source)] = (Counter(), Counter())
                before = len(pair[0])
                pair[0].update(words)
                pair[1].update(set(words))
                entries += len(pair[0]) - before
                if entries > TABLE_ENTRIES:
                    yield from send(held)
                    held, entries = {}, 0
        yield from send(held)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, count long, n_docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms))."""
    wide = lambda c: c.cast("decimal(28,0)")
    top, below = (wide(count) + F.lit(2)) * F.lit(1_000_000_000).cast("decimal(10,0)"), (wide(total) + F.lit(2) * wide(terms))
    return (F.lit(1) + F.call_function("div", top, below)).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def cell(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Divergences of each row of ``left`` from each row of ``right``, summed over the terms (columns)."""
    out = np.empty((len(left), len(right)), np.int64)
    for i, p in enumerate(left):
        d = np.abs(right - p).astype(np.uint64)
        out[i] = ((d * d) // (right + p).astype(np.uint64)).sum(axis=1).astype(np.int64)
    return out


def _cells(counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """One cell of the cube: ``counts`` holds the shares of terms that a group has, ``groups`` all groups of both blocks with
    the share of a term they lack and the number of terms of the block."""
    names = ["lang", "source", "item", "value"]
    if not len(groups):
        return pd.DataFrame({n: [] for n in names})
    groups = groups.sort_values(["block", "source"], ignore_index=True)
    first, second = int(groups["b1"].iloc[0]), int(groups["b2"].iloc[0])
    codes, found = pd.factorize(counts["term"])
    shares = np.repeat(groups["p0"].to_numpy(np.int64)[:, None], len(found) + 1, axis=1)  # the last column: a term no group here has
    at = pd.Series(np.arange(len(groups)), index=groups["source"])
    if len(counts):
        shares[at.loc[counts["source"]].to_numpy(), codes] = counts["p"].to_numpy(np.int64)
    lacked = int(groups["n_terms"].iloc[0]) - len(found)
    rows = np.flatnonzero((groups["block"] == first).to_numpy())
    columns = np.flatnonzero((groups["block"] == second).to_numpy())
    value = cell(shares[rows][:, :-1], shares[columns][:, :-1]) + lacked * cell(shares[rows][:, -1:], shares[columns][:, -1:])
    i, j = np.nonzero(rows[:, None] < columns[None, :]) if first == second else np.nonzero(np.ones_like(value, bool))
    a, b, v = groups["source"].to_numpy()[rows[i]], groups["source"].to_numpy()[columns[j]], value[i, j]
    return pd.DataFrame({"lang": groups["lang"].iloc[0], "source": np.concatenate([a, b]), "item": np.concatenate([b, a]), "value": np.concatenate([v, v])})


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10,
          top_terms: int = 10, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language, the most different one
    first; part ``term`` the ``top_terms`` terms that the group has more often than its language."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    by_term = Window.partitionBy("lang", "term")
    kept = materialize(
        count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("n_docs").alias("n_docs"))
        .withColumn("n_docs", F.sum("n_docs").over(by_term)).withColumn("in_lang", F.sum("count").over(by_term))
        .where(F.col("n_docs") >= min_docs).drop("n_docs"), "kept_terms")

    # One row for each language, group and (language, term block).
    terms = kept.select("lang", "term", "in_lang").distinct()
    langs = docs.select("lang", "source").distinct().groupBy("lang").agg(F.count("*").alias("n_groups"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_total"))
    langs = langs.join(sizes, "lang", "left").select(
        "lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        F.ceil(F.col("n_groups") / group_block).cast("int").alias("group_blocks"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / term_block)).cast("int").alias("term_blocks"))
    langs = materialize(langs, "languages")
    total = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    deal = lambda c, n: F.pmod(F.xxhash64(F.lit("cube"), c), n).cast("int")
    groups = (docs.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(langs, "lang")
              .withColumn("total", F.coalesce("total", F.lit(0))).withColumn("block", deal(F.col("source"), F.col("group_blocks")))
              .withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)))).otherwise(F.lit(1))))
    groups = materialize(groups, "groups")
    dealt = terms.join(langs, "lang").select("lang", deal(F.col("term"), F.col("term_blocks")).alias("term_block"))
    in_block = dealt.groupBy("lang", "term_block").agg(F.count("*").alias("n_terms"))

    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "in_lang", "lang_total", "v", "block", "group_blocks",
        deal(F.col("term"), F.col("term_blocks")).alias("term_block"), share(F.col("count"), F.col("total"), F.col("v")).alias("p"))

    # A slice goes to each cell of its row and column.
    other = F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)).alias("other")
    b1, b2 = F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")
    left = shares.select("*", other).select("lang", "term_block", b1, b2, "source", "term", "p")
    right = (groups.select("*", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("term_block"))
             .join(in_block, ["lang", "term_block"], "left").select("*", other)
             .select("lang", "term_block", b1, b2, "block", "source", "p0", F.coalesce("n_terms", F.lit(0)).alias("n_terms")))
    of_cell = ["lang", "term_block", "b1", "b2"]
    partial = left.groupBy(*of_cell).cogroup(right.groupBy(*of_cell)).applyInPandas(_cells, "lang string, source string, item string, value long")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    q = share(F.col("in_lang"), F.col("lang_total"), F.col("v"))
    over = shares.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                           distance(F.col("p"), F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(over)


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) t USING (lang, source)),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
l AS (SELECT lang, sum(n) AS total FROM lt GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.v) AS p
      FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lt.lang, lt.term, 1 + (1000000000::HUGEINT * (lt.n + 2)) // (l.total + 2 * v.v) AS q FROM lt JOIN l USING (lang) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 10
"""
