"""Operator 3: packing documents into fixed windows by non-negative least squares.

A document's ids are cut into full windows, one main piece that is a whole number of ``unit`` ids, and a tail
shorter than a unit. Main pieces therefore have ``window / unit`` possible lengths, and every way to fill a window
exactly with them is enumerated (``combinations``; 8,349 for 32 units, fewer when ``depth`` bounds the pieces of a
window). Non-negative least squares finds how often each combination is used so that the uses meet the histogram of
all pieces; the counts are rounded down and never use more pieces than there are. Pieces are numbered within their
length, and a piece's number says which use of which combination it fills. What the combinations leave over and all
tails are packed by first-fit decreasing in groups of some 64 windows.

At scale: documents are read once, by partition, and only rows of some 50 bytes per piece leave that pass. The
histogram (one row per length) and the solution are the only things on the driver. Numbering works on (length, salt)
groups with one count for each, so a length that most pieces share is numbered by many tasks; the salts and the
groups of the greedy step grow with the rows.

Null and empty texts have the end id alone. Repeated rows are packed as often as they come; ``offset`` and
``sequence_id`` tell them apart. Padding: a sequence is padded to the window unless its length is a power of two.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hitlink.llm.common import texts, trim_memory
from hitlink.session import materialize

WINDOW, UNIT = 4096, 128
END = (2).to_bytes(4, "little")  # the id after each document
GROUP_WINDOWS = 64          # windows in a group of the greedy step
SALT_ROWS = 10_000          # pieces that one numbering task gets, about
WORDS_KEPT = 1_500_000      # words whose ids a worker remembers, some 300 MB

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row_key long, part string, place long"


class WordIds(dict):
    """Token ids by white-space separated word, as little-endian unsigned 32-bit bytes. The tokenizer drops white space and
    never joins across it, so a text's ids are its words' ids in order; words come again and again, so each is tokenized
    once."""

    def __init__(self, tokenizer: str, most: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(tokenizer), most

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if text[-1] in ".,;:!?" and text[:-1].isalpha():  # the tokenizer parts letters from signs
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """The ids of a text, the end id last."""
        if len(self) > self.most:
            self.clear()
        # The tokenizer lower-cases; doing so first makes fewer different words. Not where a special token may stand, and not
        # in a word with a mark (U+0300 to U+036F): the tokenizer composes first, and some pairs have a small composed form only.
        if b"<|" in text:
            words = text.split()
        elif b"\xcc" in text or b"\xcd" in text:
            words = [w.lower() if w.isascii() else w for w in text.split()]
        else:
            words = text.lower().split()
        return b"".join(map(self.__getitem__, words)) + END


@cache
def word_ids(tokenizer: str, most: int) -> WordIds:
    """One for each worker process: its later tasks find the words of its earlier ones."""
    return WordIds(tokenizer, most)


def cut(n: int, window: int, unit: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids: windows, a whole number of units, the rest."""
    rest = n % window
    return [window] * (n // window) + [x for x in (rest // unit * unit, rest % unit) if x]


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
           unit: int = UNIT, order: tuple[str, str] | None = None, words_kept: int = WORDS_KEPT) -> DataFrame:
    """A row per piece of every document; ``row_key`` is the same for the pieces of one row of the input only. ``part`` and
    ``place`` are the columns of ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()  # what earlier stages left in this worker
        words = word_ids(tokenizer, words_kept)
        for batch in batches:
            rows: list[tuple] = []
            keys = zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)))
            for (doc, key, part, place), text in zip(keys, texts(batch.column(1))):
                ids, at = words.ids(text), 0
                size = len(ids) // 4
                for n in cut(size, window, unit):
                    rows.append((doc, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), size, key, part, place))
                    at += n
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_key", "part", "place"]
            kinds = [pa.int64()] * 6 + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                     F.monotonically_increasing_id().alias("row_key"), (F.col(order[0]) if order else F.lit(None)).cast("string").alias("part"),
                     (F.col(order[1]) if order else F.lit(None)).cast("long").alias("place"))
    return rows.mapInArrow(run, PIECES)


@cache
def combinations(units: int, depth: int) -> np.ndarray:
    """Every multiset of at most ``depth`` piece lengths (in units) that fills a window: a row per multiset, a column
    per length 1..units, the number of pieces."""
    found: list[list[int]] = []

    def fill(left: int, largest: int, parts: list[int]) -> None:
        if not left:
            found.append(parts)
        elif len(parts) < depth:
            for x in range(min(left, largest), 0, -1):
                fill(left - x, x, [*parts, x])

    fill(units, units, [])
    out = np.zeros((len(found), units), np.int64)
    for row, parts in zip(out, found):
        np.add.at(row, np.array(parts) - 1, 1)
    return out


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| over x >= 0 by the active-set method: the column with the steepest gradient joins, and columns
    whose free solution turns negative leave."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        free[best] = True
        while True:
            columns = np.flatnonzero(free)
            solution = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            if (solution > 0).all():
                x[:] = 0
                x[columns] = solution
                break
            low = solution <= 0
            now = x[columns]
            step = float((now[low] / np.maximum(now[low] - solution[low], 1e-300)).min())
            x[columns] = now + step * (solution - now)
            free[columns[(x[columns] <= 1e-12) & low]] = False
            x[~free] = 0
    return x


def solve(histogram: np.ndarray, depth: int) -> list[tuple[np.ndarray, int]]:
    """Combinations with their whole numbers of uses, most used first, within the pieces there are. Rounding down
    leaves pieces; the rounds that follow solve again for what is left until a round places none."""
    a = combinations(len(histogram), depth)
    left, plan = histogram.astype(np.int64).copy(), []
    for _ in range(4):
        if not left.any():
            break
        x = least_squares(a.T.astype(float), left.astype(float))
        placed = False
        for k in np.argsort(-x, kind="stable")[: int((x > 0.5).sum())]:
            used = a[k] > 0
            uses = int(min(math.floor(x[k] + 0.5), (left[used] // a[k][used]).min()))
            if uses > 0:
                left -= uses * a[k]
                plan.append((a[k], uses))
                placed = True
        if not placed:
            break
    return plan


def slots(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(units, first piece number, end, pieces of that length in one use, first sequence) for each length of each
    combination."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for row, uses in plan:
        for j in np.flatnonzero(row):
            first = taken.get(int(j), 0)
            taken[int(j)] = first + uses * int(row[j])
            out.append((int(j) + 1, first, taken[int(j)], int(row[j]), sequence))
        sequence += uses
    return out


def first_fit(lengths: list[int], window: int) -> list[int]:
    """Window of each piece, longest first; windows with the same room are kept together, so a piece costs at most
    ``window`` steps whatever their number."""
    rooms: dict[int, list[int]] = {}
    order, out, windows = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)), [0] * len(lengths), 0
    for k in order:
        n = lengths[k]
        room = min((r for r in rooms if r >= n), default=None)
        if room is None:
            at, room = windows, window
            windows += 1
        else:
            at = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
        out[k] = at
        rooms.setdefault(room - n, []).append(at)
    return out


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, unit: int = UNIT,
         depth: int | None = None, order: tuple[str, str] | None = None, words_kept: int = WORDS_KEPT) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it. ``order`` names two columns, a part (such as a
    file) and the place in it: pieces of a length are then used in that order, so windows keep documents together that
    follow each other; without it in an order by hash. ``words_kept`` bounds a worker's table of words."""
    spark, units = df.sparkSession, window // unit
    cuts = materialize(pieces(df, tokenizer, id_col, text_col, window, unit, order, words_kept), "pieces")
    main = cuts.where(F.col("length") % unit == 0).withColumn("units", (F.col("length") / unit).cast("int"))
    counts = {r.units: r.n for r in main.groupBy("units").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    plan = solve(np.array([counts.get(k + 1, 0) for k in range(units)]), depth or units)
    n_planned = sum(uses for _, uses in plan)

    salts = max(1, total // SALT_ROWS)
    salt = F.col("part") if order else F.format_string("%012d", F.pmod(F.xxhash64("row_key", "start"), F.lit(salts)))
    main = main.withColumn("salt", F.coalesce(salt, F.lit("")))
    sizes = main.groupBy("units", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("units", "salt", (F.sum("n").over(Window.partitionBy("units").orderBy("salt")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("units", "salt").orderBy("place", "doc_id", "row_key", "start")) - 1
    numbered = main.withColumn("number", number).join(before, ["units", "salt"]).withColumn("number", F.col("number") + F.col("before"))

    kinds = "units int, first long, end long, times long, base long"
    slot = spark.createDataFrame(slots(plan), kinds)  # at most 4 x 32 combinations with 32 lengths: bounded by the units
    held = (numbered.join(F.broadcast(slot.withColumnRenamed("units", "u")), (F.col("units") == F.col("u"))
                          & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end")), "left"))
    planned = (held.where(F.col("u").isNotNull())
               .withColumn("sequence_id", F.col("base") + F.floor((F.col("number") - F.col("first")) / F.col("times"))))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "number")
    planned = planned.withColumn("offset", F.sum("length").over(within) - F.col("length")).select(names)

    rest = held.where(F.col("u").isNull()).select(cuts.columns).unionByName(cuts.where(F.col("length") % unit != 0))
    spare = cuts.where(F.col("length") % unit != 0).agg(F.sum("length")).first()[0] or 0
    spare += sum((k * counts.get(k, 0) - sum(int(r[k - 1]) * u for r, u in plan) * k) * unit for k in counts)
    groups = max(1, round(spare / (window * GROUP_WINDOWS)))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "row_key", "start"], kind="stable", ignore_index=True)
        frame["at"] = first_fit(frame["length"].tolist(), window)
        frame["sequence_id"] = n_planned + frame["at"] * groups + frame["group"]
        frame["offset"] = frame.groupby("at")["length"].cumsum() - frame["length"]
        return frame[names]

    packed = (rest.withColumn("group", F.pmod(F.xxhash64("row_key", "start"), F.lit(groups)))
              .groupBy("group").applyInPandas(greedy, schema))
    return planned.unionByName(packed)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
