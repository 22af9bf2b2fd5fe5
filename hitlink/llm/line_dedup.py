"""Operator 2: line dedup with levelled sorted runs of line keys.

The key of a line is the line stripped and lower-cased; two 64-bit hashes stand for it. ``LineRuns`` keeps what was
seen of every key (number of documents, largest id) in runs: Parquet tables sorted by key, each written once. A new
batch is merged against the runs and adds its own run to level 0; when a level has ``fanout`` runs they are
compacted into one run of the next level, so a key is rewritten once a level and a lookup reads at most
``fanout`` runs a level.

Two uses. ``new_lines`` is the incremental one: a batch's lines whose keys no run holds (a merge anti-join).
``dedup_lines`` removes, over all batches, the lines of keys that at least ``min_docs`` documents hold, but for those of
the document with the largest id: all batches add their runs, then each document's keys are anti-joined with the
compacted run of repeated keys.

At scale: keys are counted by document and partition before the shuffle (a line that a third of all documents hold
leaves each task as one row for each document it keeps), joins are on the key hash with AQE's skew handling on the
side of the documents, and a document's text meets its own dropped keys by id only.

Null and empty texts are one empty line. Documents are told apart by id: rows that repeat an id are one document in
the counts, and each row is rewritten. Null ids count as one document, smaller than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlink.llm.common import documents, texts
from hitlink.session import materialize

FANOUT = 4
BATCHES = 4
STRIPPED = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    return line.strip(STRIPPED).lower()


def code_points(text: bytes) -> int:
    return len(text) - sum(map(text.count, CONTINUATION)) if not text.isascii() else len(text)


CONTINUATION = [bytes([k]) for k in range(0x80, 0xC0)]


def key_hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, doc_id): the keys of at least ``min_chars`` code points, once for each row of ``docs`` that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                own = NO_ID if doc is None else doc
                keys = {k for k in map(line_key, text.split(b"\n")) if len(k) >= min_chars and code_points(k) >= min_chars}
                rows += [(*key_hash(k), own) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)],
                                             names=["k1", "k2", "doc_id"])

    return docs.mapInArrow(run, "k1 long, k2 long, doc_id long")


class LineRuns:
    """Levelled sorted runs of (k1, k2, n_docs, max_doc)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(materialize(rows.sortWithinPartitions("k1", "k2"), f"line_run_{level}"))

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def add(self, keys: DataFrame) -> None:
        """Adds a batch of (k1, k2, doc_id), each once; an id must not come again in a later batch."""
        self._write(keys.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self.merged(full), level + 1)
            level += 1

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` that no run holds."""
        for run in self.runs():
            keys = keys.join(run.select("k1", "k2"), ["k1", "k2"], "left_anti")
        return keys

    def compact(self) -> DataFrame:
        """One run of everything."""
        runs = self.runs()
        if len(runs) != 1:
            self.levels = [[] for _ in self.levels]
            self._write(self.merged(runs), len(self.levels))
        return self.runs()[0]


def new_lines(runs: LineRuns, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """Incremental use: (k1, k2, doc_id) of the batch's keys that no earlier batch held; the batch's run is added."""
    keys = materialize(line_keys(documents(batch, id_col, text_col), min_chars).distinct(), "line_batch")
    fresh = materialize(runs.unseen(keys), "line_fresh")
    runs.add(keys)
    return fresh


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
                batches: int = BATCHES, keep: list[str] | None = None) -> DataFrame:
    """Every row with ``__kept`` (text of the kept lines), ``__n_lines`` and ``__n_dropped``, and the columns in ``keep`` (by
    default the id)."""
    spark, keep = df.sparkSession, keep if keep is not None else [id_col]
    rows = df.select(*keep, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    # One pass over the texts; a batch is one slice of the ids, so each id is in one batch.
    keys = line_keys(rows.select("__id", "__text"), min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    keys = materialize(keys.distinct() if _repeats_ids(rows) else keys, "line_keys")
    runs = LineRuns(spark)
    for k in range(batches):
        runs.add(keys.where(F.col("batch") == k).drop("batch"))
    repeated = runs.compact().where(F.col("n_docs") >= min_docs)
    dropped = (keys.join(repeated, ["k1", "k2"]).where(F.col("doc_id") != F.col("max_doc"))
               .groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("k1").alias("__k1"), F.collect_list("k2").alias("__k2")))
    return _without(rows.join(dropped, "__id", "left").select(*keep, "__text", "__k1", "__k2"), keep)


def _repeats_ids(rows: DataFrame) -> bool:
    return not rows.groupBy("__id").count().where("count > 1").isEmpty()


def _without(rows: DataFrame, keep: list[str]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            n = batch.num_columns
            for text, k1, k2 in zip(texts(batch.column(n - 3)), batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if k1:
                    gone = set(zip(k1, k2))
                    lines = [x for x in lines if key_hash(line_key(x)) not in gone]
                    text = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: n - 3], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[*keep, "__kept", "__n_lines", "__n_dropped"])

    return rows.mapInArrow(run, f"{schema}, __kept string, __n_lines long, __n_dropped long")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
repeated AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.*, r.k IS NOT NULL AND l.doc_id <> r.last AS gone FROM lines l LEFT JOIN repeated r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""".replace(r"e' \t\n\x0b\x0c\r'", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                      F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))
