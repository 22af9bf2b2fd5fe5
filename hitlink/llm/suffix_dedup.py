"""Operator 10: removal of repeated byte strings by a hash-compared sparse suffix sort.

Every byte that a string of ``length`` bytes covers which starts elsewhere too (in the same text or another) goes.

Anchors. A polynomial prefix hash of each text gives the hash of any substring in one subtraction. Of the ``GRAM``-byte
substrings of each ``length``-byte window the one with the smallest hash is an anchor. Equal windows have equal anchors
at the same place, so a repeated window shows as a repeated anchor, and only suffixes at repeated anchors need sorting.
An anchor's context is all that the windows around it can cover: ``length - GRAM`` bytes to its left, ``length`` from it.

Counting. Anchors are counted by (anchor hash, digest of the context), partial sums first, so a passage that a
third of the texts share is a row from each task. If a context comes again, all its windows do.

Sorting. Contexts that come once beside others with the same anchor (the borders of repeated passages) are fetched,
one representative for each distinct context. In tasks of about ``TASK_CONTEXTS`` of them, mergesort orders the
suffixes to the right of the anchors and the reversed prefixes to the left; two suffixes are compared by binary search
for their common extension on the prefix hashes and then by one byte. The common extensions of neighbours are verified
on the bytes. The window that starts d bytes left of the anchor is repeated just if two contexts are in one interval of
neighbours with left extension >= d and in one with right extension >= length - d.

Splitting. An anchor with more than ``GROUP_CONTEXTS`` distinct contexts (a passage that many texts share, each going on in
its own way) is split by further prefix hashes until its parts are small. A window that starts d bytes left of the anchor,
d in [lo, hi), has the ``lo`` bytes left of the anchor and ``length`` - hi + 1 bytes from it: two contexts that share such a
window agree on the hash of these, so a part is an interval of d and one such hash. Contexts that agree on all bytes that windows of
the interval can cover have all of these windows in common: their spans are known, and one of them stays for the others. Parts that
are still large go on with a quarter of the interval each, those that are not are sorted as above. An interval of one
d has one window, so it ends there; a context is in few parts of a level, and there are at most five levels.

Texts are read twice or three times and shuffled only if the list of places for a pass is too long to broadcast
(``BROADCAST_ENTRIES``; beyond it the pass joins by key).

Null and empty texts lose nothing. Each row is a text of its own, also when it repeats another row. Removal can cut
UTF-8 characters; the kept bytes are binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitlink.llm.common import documents, mix, signed, texts
from hitlink.session import drop_tables, materialize, recorded_tables

LENGTH, GRAM = 400, 128
TASK_CONTEXTS = 4000      # in a task, about
SORTED_CONTEXTS = 1500    # sorted together: some 1 MB of text, 60 MB of hashes and orders
GROUP_CONTEXTS = 100      # of an anchor or a part of it that are sorted together
SPLIT = 4
BROADCAST_ENTRIES = 3_000_000  # of 8 bytes
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class PrefixHashes:
    """Polynomial hashes modulo 2^64 of all substrings of ``data``."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls.powers) < n:
            n = max(n, 2 * len(cls.powers))
            with np.errstate(over="ignore"):
                for name, base in (("powers", BASE), ("inverses", INVERSE)):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    setattr(cls, name, np.multiply.accumulate(steps))

    def __init__(self, data: np.ndarray):
        self._grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + size] - self.sums[start]) * self.inverses[start]


def _sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each run of ``w`` neighbours."""
    n = len(x)
    fill = x[-1:] if n else x
    padded = np.concatenate([x, np.repeat(fill, -n % w)]).reshape(-1, w)
    ahead = f.accumulate(padded, axis=1).ravel()
    back = f.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors of a text."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = mix(PrefixHashes(data).of(np.arange(len(data) - gram + 1), gram))
    w = length - gram + 1
    least = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    top = _sliding(np.concatenate([edge, least, edge]), w, np.maximum)  # of the windows that hold each place
    at = np.flatnonzero(top == h)
    return at, h[at]


def common_extension(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, at most ``most``, by binary search."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = hashes.of(a, middle) == hashes.of(b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_order(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start : start + size] by (group, content) and the common extension of each with the one
    before it (-1 between groups). Bottom-up mergesort: each element finds its rank in the neighbouring run."""
    n, hashes = len(starts), PrefixHashes(data)

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Is suffix a before b; ``ties`` where they are equal."""
        out = group[a] < group[b]
        k = np.flatnonzero(group[a] == group[b])
        x, y = a[k], b[k]
        most = np.minimum(sizes[x], sizes[y])
        ext = common_extension(hashes, starts[x], starts[y], most)
        ended = ext == most
        inside = np.minimum(ext, np.maximum(most - 1, 0))
        last = len(data) - 1
        byte = data[np.minimum(starts[x] + inside, last)] < data[np.minimum(starts[y] + inside, last)]
        shorter = np.where(sizes[x] == sizes[y], ties[k], sizes[x] < sizes[y])
        out[k] = np.where(ended, shorter, byte)
        return out

    order, width = np.argsort(group, kind="stable"), 1
    while width < n:
        place = np.arange(n)
        run = place // width
        sibling = np.minimum((run ^ 1) * width, n)
        low, high = sibling.copy(), np.minimum(sibling + width, n)
        first = (run & 1) == 0
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            # elements of the first run go before equal ones of the second
            less = before(order[middle], order[open_], ~first[open_])
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        target = (run // 2) * 2 * width + (place - run * width) + (low - sibling)
        merged = np.empty(n, np.int64)
        merged[target] = order
        order, width = merged, 2 * width
    extension = np.full(n, -1, np.int64)
    k = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
    a, b = order[k - 1], order[k]
    most = np.minimum(sizes[a], sizes[b])
    extension[k] = common_extension(hashes, starts[a], starts[b], most)
    # Hashes can collide: neighbours are compared byte by byte.
    for i, x, y in zip(k, a, b):
        e = extension[i]
        if not np.array_equal(data[starts[x] : starts[x] + e], data[starts[y] : starts[y] + e]):
            return _order_by_bytes(data, starts, sizes, group)
    return order, extension


def _order_by_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes, for the case of a collision."""
    content = [data[s : s + z].tobytes() for s, z in zip(starts, sizes)]
    order = np.array(sorted(range(len(starts)), key=lambda k: (group[k], content[k])), np.int64)
    extension = np.full(len(starts), -1, np.int64)
    for i in range(1, len(order)):
        x, y = order[i - 1], order[i]
        if group[x] == group[y]:
            n = min(sizes[x], sizes[y])
            differ = np.flatnonzero(data[starts[x] : starts[x] + n] != data[starts[y] : starts[y] + n])
            extension[i] = differ[0] if len(differ) else n
    return order, extension


def repeated_windows(contexts: list[bytes], left: np.ndarray, group: np.ndarray, length: int = LENGTH,
                     gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct context the least and the greatest number of bytes that a repeated window starts before the
    anchor (-1 if none); ``left`` is the number of the context's bytes before the anchor."""
    n = len(contexts)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum([len(c) for c in contexts])
    starts = ends - [len(c) for c in contexts]
    place = starts + left
    order_r, ext_r = suffix_order(data, place, ends - place, group)
    order_l, ext_l = suffix_order(data[::-1].copy(), len(data) - place, place - starts, group)
    least, greatest = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(length - gram + 1):
        if not (ext_r >= length - d).any() or not (ext_l >= d).any():
            continue
        right_class[order_r] = np.cumsum(ext_r < length - d)
        left_class[order_l] = np.cumsum(ext_l < d)
        # classes of one context on the right need no further look
        size = np.bincount(right_class)
        k = np.flatnonzero((size[right_class] > 1) & (left >= d) & (ends - place >= length - d))
        pair = right_class[k] * np.int64(n + 2) + left_class[k]
        _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        k = k[counts[inverse] > 1]
        greatest[k] = d
        least[k] = np.where(least[k] < 0, d, least[k])
    return least, greatest


def _context(text: bytes, at: int, length: int, gram: int) -> tuple[bytes, int]:
    left = min(at, length - gram)
    return text[at - left : at + length], left


def _anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, places, hashes, contexts = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                at, h = anchors(np.frombuffer(text, np.uint8), length, gram)
                keys.append(np.full(len(at), key, np.int64))
                places.append(at)
                hashes.append(h)
                contexts += [digest(*_context(text, p, length, gram)) for p in at.tolist()]
            columns = [np.concatenate(x) if x else np.zeros(0) for x in (keys, places, hashes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int32)),
                 pa.array(signed(columns[2].astype(np.uint64))), pa.array(signed(np.array(contexts, np.uint64)))],
                names=["key", "at", "anchor", "context"])

    return rows.mapInArrow(run, "key long, at int, anchor long, context long")


def _with_lists(rows: DataFrame, lists: DataFrame, n_entries: int, how: str) -> DataFrame:
    """``rows`` joined with their lists by key; the lists are broadcast if they have few enough entries in all."""
    return rows.join(F.broadcast(lists) if n_entries <= BROADCAST_ENTRIES else lists, "key", how)


def _fetch(rows: DataFrame, border: DataFrame, n: int, length: int, gram: int) -> DataFrame:
    """The bytes around each place of ``border``; ``anchor`` is a digest of the anchor's own bytes."""
    coded = F.col("at").cast("long") * 2 + F.col("once").cast("long")
    lists = border.groupBy("key").agg(F.collect_list(coded).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[tuple] = []
            for key, text, places in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist()):
                for code in places:
                    at = code >> 1
                    out.append((key, at, bool(code & 1), digest(text[at : at + gram]) - (1 << 63), *_context(text, at, length, gram)))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["key", "at", "once", "anchor", "bytes", "left"])

    return (_with_lists(rows, lists, n, "inner").select("key", "text", "places")
            .mapInArrow(run, "key long, at int, once boolean, anchor long, bytes binary, left int"))


def _parts(group: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts between groups, so that a part has about ``most`` rows; a group is never cut."""
    starts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
    first = 0
    for k in range(1, len(starts)):
        if k == len(starts) - 1 or starts[k + 1] - starts[first] > most:
            yield starts[first], starts[k]
            first = k


def _sorted_groups(contexts: DataFrame, n: int, length: int, gram: int) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("anchor", kind="stable", ignore_index=True)
        group = np.unique(frame["anchor"].to_numpy(), return_inverse=True)[1]
        contexts, left = frame["bytes"].tolist(), frame["left"].to_numpy().astype(np.int64)
        least, greatest = np.full(len(group), -1, np.int64), np.full(len(group), -1, np.int64)
        for a, b in _parts(group, SORTED_CONTEXTS):
            least[a:b], greatest[a:b] = repeated_windows(contexts[a:b], left[a:b], group[a:b], length, gram)
        found = (greatest >= 0) & frame["once"].to_numpy()
        at = frame["at"].to_numpy().astype(np.int64)
        return pd.DataFrame({"key": frame["key"], "start": at - greatest, "end": at - least + length})[found]

    task = F.pmod(F.xxhash64("anchor"), F.lit(max(1, n // TASK_CONTEXTS)))
    return contexts.groupBy(task.alias("task")).applyInPandas(run, "key long, start long, end long")


def _split_groups(contexts: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Spans (key, start, end) of windows found on the way, and the contexts of the parts to sort, ``anchor`` being the part."""
    contexts = materialize(contexts, "hot_bytes")
    digest = xxhash.xxh3_64_intdigest

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, left = r["bytes"], r["left"]
                right = len(text) - left
                for lo, hi in zip(r["los"], r["his"]):  # each in quarters
                    step = max(1, -(-(hi - lo) // SPLIT))
                    for a in range(lo, hi, step):
                        b = min(a + step, hi)
                        first, last = max(a, length - right), min(b - 1, left)  # the windows that the text has room for
                        if first <= last:
                            anchor = r["anchor"] & (1 << 64) - 1
                            weak = digest(text[left - a : left + length - b + 1], digest(b"%d %d" % (a, b), anchor))
                            whole = digest(text[left - last : left + length - first], digest(b"%d %d" % (last, first), weak))
                            rows.append((r["key"], r["at"], r["once"], a, b, first, last, weak - (1 << 63), whole - (1 << 63)))
            kinds = [pa.int64(), pa.int32(), pa.bool_(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)],
                                             names=["key", "at", "once", "lo", "hi", "first", "last", "weak", "whole"])

    kind = "key long, at int, once boolean, lo int, hi int, first int, last int, weak long, whole long"
    active = contexts.select("*", F.array(F.lit(0)).alias("los"), F.array(F.lit(length - gram + 1)).alias("his"))
    spans, parts = None, None
    while True:
        rows = materialize(active.select("key", "at", "once", "anchor", "bytes", "left", "los", "his").mapInArrow(keys, kind), "split_keys")
        # One of the contexts that agree on all windows stays; they are repeated if there is another, or if one comes more than once.
        wholes = rows.groupBy("weak", "whole").agg((F.count("*") + F.max((~F.col("once")).cast("long"))).alias("times"), F.min(F.struct("key", "at")).alias("one"))
        wholes = materialize(wholes.join(wholes.groupBy("weak").agg(F.count("*").alias("kinds")), "weak"), "split_wholes")
        again = rows.where("once").join(wholes.where("times > 1").select("weak", "whole"), ["weak", "whole"]).select(
            "key", (F.col("at") - F.col("last")).cast("long").alias("start"), (F.col("at") - F.col("first") + length).cast("long").alias("end"))
        spans = again if spans is None else spans.unionByName(again)
        stay = rows.join(wholes.where("kinds > 1").select("weak", "whole", "times", "one", "kinds"), ["weak", "whole"])
        stay = stay.where((F.col("one.key") == F.col("key")) & (F.col("one.at") == F.col("at"))).select(
            "key", "at", "lo", "hi", "weak", "kinds", (F.col("once") & (F.col("times") == 1)).alias("once"))
        stay = materialize(stay, "split_stay")
        done = stay.where(F.col("kinds") <= GROUP_CONTEXTS).select("key", "at", F.col("weak").alias("anchor"), "once")
        parts = done if parts is None else parts.unionByName(done)
        more = stay.where(F.col("kinds") > GROUP_CONTEXTS)
        if more.isEmpty():
            break
        # Whether a context's windows are known differs by interval: one row for each answer.
        more = more.groupBy("key", "at", "once").agg(F.collect_list(F.struct("lo", "hi")).alias("of")).select(
            "key", "at", "once", F.col("of.lo").alias("los"), F.col("of.hi").alias("his"))
        active = contexts.drop("once").join(more, ["key", "at"])
    return spans, parts.join(contexts.select("key", "at", "bytes", "left"), ["key", "at"])


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, start, end): the maximal byte spans of (key, text) rows that repeated windows cover; a span at the end of a
    text may reach past it."""
    with recorded_tables() as large:  # most of the disk that the operator takes: gone once the few rows that matter are written
        places = materialize(_anchor_rows(rows.select("key", "text"), length, gram), "anchors")
    with recorded_tables() as larger:
        contexts = materialize(places.groupBy("anchor", "context").agg(
            F.count("*").alias("times"), F.min(F.struct("key", "at")).alias("one")), "contexts")
    repeated = materialize(contexts.where("times > 1").select("anchor", "context"), "repeated")
    shared = (contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.min("times").alias("fewest"))
              .where("n > 1 AND fewest = 1").select("anchor", "n"))
    border = materialize(contexts.join(shared, "anchor").select(
        F.col("one.key").alias("key"), F.col("one.at").alias("at"), (F.col("times") == 1).alias("once"),
        (F.col("n") > GROUP_CONTEXTS).alias("hot")), "borders")
    drop_tables(rows.sparkSession, larger)
    # A context that is cut short by the ends of its text comes again with the same cuts, so its windows do too.
    whole = materialize(places.join(repeated, ["anchor", "context"]).select(
        "key", F.greatest(F.lit(0), F.col("at") - (length - gram)).cast("long").alias("start"), (F.col("at") + length).cast("long").alias("end")), "whole")
    drop_tables(rows.sparkSession, large)
    n, n_hot = border.agg(F.count("*"), F.count_if("hot")).first()
    spans = whole
    if n > n_hot:
        spans = spans.unionByName(_sorted_groups(_fetch(rows, border.where("NOT hot"), n - n_hot, length, gram), n - n_hot, length, gram))
    if n_hot:
        found, parts = _split_groups(_fetch(rows, border.where("hot"), n_hot, length, gram), length, gram)
        parts = materialize(parts, "split_parts")
        spans = spans.unionByName(found).unionByName(_sorted_groups(parts, parts.count(), length, gram))
    return _united(spans)


def _united(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a key as one."""
    ahead = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > reach, F.lit(True)).cast("long")
    return (spans.groupBy("key", "start").agg(F.max("end").alias("end")).withColumn("new", new)
            .withColumn("island", F.sum("new").over(ahead)).groupBy("key", "island")
            .agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row per row of ``df``: ``n_bytes``, the ``removed`` spans (maximal, in bytes) and the ``kept`` bytes."""
    docs = documents(df, id_col, text_col)
    keyed = docs.withColumn("key", F.xxhash64(F.lit("row"), "doc_id", "text"))
    spans = materialize(repeated_spans(keyed, length, gram), "spans")
    n, lists = spans.count(), spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, own in zip(texts(batch.column(1)), batch.column(2).to_pylist()):
                gone, at, parts = [(x["start"], min(x["end"], len(text))) for x in own or ()], 0, []
                for s, e in gone:
                    parts.append(text[at:s])
                    at = e
                sizes.append(len(text))
                removed.append([{"start": s, "end": e} for s, e in gone])
                kept.append(b"".join([*parts, text[at:]]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "removed", "kept"])

    joined = _with_lists(keyed, lists, n, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"),
                      F.coalesce(F.array_max(F.transform("removed", lambda x: x["end"] - x["start"])), F.lit(0)).cast("long").alias("longest_removed"))
