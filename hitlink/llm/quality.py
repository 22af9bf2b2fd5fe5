"""Operator 7: quality rules on repetition inside a document, by suffix arrays.

A document is its sequence of words. Prefix doubling ranks all suffixes by their first 1, 2, 4, ... words; the
last ranking is the suffix array, and walking the rankings down gives the longest common prefix of neighbours. The
maximal repeated substrings are the longest-common-prefix intervals of at least ``min_words`` words; the union of
their spans gives the covered fraction. A document is dropped when the covered fraction or the longest repeat
passes its limit.

Each document is scored alone in the task that reads it: no shuffle, memory in proportion to the longest text.
Null, empty or blank texts have no words: they fail the minimum number of words. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlink.llm.common import documents, texts

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "covered_words long, longest_repeat long, repeat_starts array<long>, repeat_ends array<long>")


def _ranks(pairs: np.ndarray) -> tuple[np.ndarray, int]:
    _, inverse = np.unique(pairs, return_inverse=True)
    return inverse.astype(np.int64), int(inverse.max()) + 1 if len(inverse) else 0


def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
    """rank of the suffix ``by`` words further on, 0 past the end."""
    out = np.zeros(len(rank), np.int64)
    out[: len(rank) - by] = rank[by:] + 1
    return out


def repeats(codes: np.ndarray) -> np.ndarray:
    """For each word position the length of the longest substring that starts there and also starts elsewhere."""
    n = len(codes)
    rank, kinds = _ranks(codes)
    levels, width = [rank], 1
    while kinds < n and width < n:
        rank, kinds = _ranks(rank * np.int64(n + 2) + _shifted(rank, width))
        width *= 2
        levels.append(rank)
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step, r = 1 << level, levels[level]
        inside = (a + step <= n) & (b + step <= n)
        same = np.zeros(len(a), bool)
        same[inside] = r[a[inside]] == r[b[inside]]
        lcp[same] += step
        a[same] += step
        b[same] += step
        np.minimum(a, n, out=a)
        np.minimum(b, n, out=b)
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = lcp
    longest[order[1:]] = np.maximum(longest[order[1:]], lcp)
    return longest


def union_spans(longest: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the united spans of all repeats of ``min_words`` words or more."""
    starts = np.flatnonzero(longest >= min_words)
    if not len(starts):
        return starts, starts
    reach = np.maximum.accumulate(starts + longest[starts])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return starts[first], reach[np.concatenate([first[1:] - 1, [len(starts) - 1]])]


def measure(text: bytes, min_words: int) -> tuple:
    words = text.split()
    n = len(words)
    word_chars = len(text.translate(None, SPACES + CONTINUATION))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    if n < 4:
        return n, word_chars, n_symbols, dup, 0, 0, 0, [], []
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    two = codes[:-1] * len(ids) + codes[1:]
    if len(ids) >= 1 << 20:
        two, kinds = _ranks(two)
    _, inverse, counts = np.unique(two[:-1] * len(ids) + codes[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] >= 2
    if not again.any():
        return n, word_chars, n_symbols, dup, 0, 0, 0, [], []
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k : n - 2 + k] |= again
    longest = repeats(codes)
    starts, ends = union_spans(longest, min_words)
    top = int(longest.max())
    return (n, word_chars, n_symbols, dup, int(marked.sum()), int((ends - starts).sum()), top if top >= min_words else 0,
            starts.tolist(), ends.tolist())


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8) -> DataFrame:
    """Word, symbol, line and repetition figures of every document, with the united spans (in words) of all maximal
    repeated substrings of at least ``min_words`` words."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t, min_words) for t in texts(batch.column(1))]
            columns = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words",
                       "longest_repeat", "repeat_starts", "repeat_ends"])

    return documents(df, id_col, text_col).mapInArrow(score, SCHEMA)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8,
            max_covered: float = 0.4, max_longest: float = 0.35) -> DataFrame:
    """``repetition`` with the verdict: ``base_failed`` (fewer than 50 words, or over half of them in repeated 3-word
    windows) and ``kept``. ``max_covered`` limits the covered fraction of the words, ``max_longest`` the longest repeat
    as a fraction of the words."""
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return (repetition(df, id_col, text_col, min_words)
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("covered_words") <= max_covered * n)
                        & (F.col("longest_repeat") <= max_longest * n)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "covered_words", "longest_repeat")
