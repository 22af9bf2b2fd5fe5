"""Operator 1: n-gram Jaccard join by token-combination prefixes.

A document is its set of n-word shingles (tokens). Sets x and y link when |x & y| >= t |x | y|.

Signatures. Tokens have one order: rare ones first. Tokens of frequency up to ``RARE`` are indexed singly; of those more
frequent, combinations of 2 (up to ``COMMON``) or 3 tokens of one group, a group being a hash slice of a class. From the
front of the order a prefix is taken until its groups, less k - 1 tokens each, hold more tokens than a partner may lack
(|x| - t |x|). Whatever a partner lacks, some group then keeps k shared tokens that lie in both prefixes, so linked sets
share a signature. Groups are as many as sizes of a band (a power of two) call for; a set near the border of a
band is indexed in both bands. A small set's tokens can run out first. It then has every signature that its partners'
full prefixes can have, so only two such sets can miss each other; they are also indexed by single tokens, whatever
their frequency, under a salt of their own (at t = 0.8 sets of 4 to 6, at 0.9 none).

The order. Frequencies are counted, over all distinct sets, for the tokens of a hash slice of the token space
(``SLICE``), which come first in the order; prefixes seldom reach beyond it. Those that do go on with the other tokens
by hash, in combinations of 3. Any order gives the same links; this one keeps the work to a slice of the tokens.

Verification. Signatures that only one set has vanish. In buckets of at most ``SMALL`` sets pairs are formed, and those
whose number of shared signatures is too small for their sizes are dropped (prefixes of single tokens only). Every comparison
is of whole sets.

Larger buckets form no pairs. One set of a bucket, the pivot, is compared with the others, and these are joined again by
what tells them from the pivot: the tokens that one of x and the pivot has and the other lacks. Those that more than half of the
group has change sides (a set that has one loses it, the others gain it), as if the pivot were the group's median; d(x) is what is left.
With s = (1 - t) / (1 + t), x and y link when |d(x) ^ d(y)| <= s (|x| + |y|) (^: symmetric difference), as d(x) ^ d(y) = x ^ y whatever
set the pivot is. Let e(x) = |d(x)| - s |x|. If e(x) + e(y) <= 0 they link for certain, and one link to the set of least e in the group
connects all such sets; they count as one label from there on. Otherwise they must
share at least (e(x) + e(y)) / 2 tokens of d, so prefixes in d, rare tokens first, find them; frequent tokens are again indexed
in combinations, and a group that few tokens tell from its pivot is done at once. Sets that links already connect have one label;
groups and buckets of one label are left out, and so are sets with too few tokens in common with other labels. In buckets of at most
``SMALL_REST`` sets pairs are formed; those that are still larger have pivots of their own, all in the same round. No token of d is in
more than half of its group, so no bucket is.

At scale: copies (equal sets) are one set throughout. All grouping is by hashes with partial counts; lists of frequent
tokens, repeated signatures and wanted ids are broadcast up to a stated number of entries and joined beyond it.
Tokens are 64-bit hashes.

Texts without words, null and empty ones are empty sets and link with nothing, not with each other. Repeated rows are
copies. A null id cannot name a component: it is passed over unless all ids of a component are null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitlink.llm.common import documents, lists, mix, signed, texts, word_hashes
from hitlink.llm.components import components
from hitlink.session import materialize

SLICE = 2.25                    # share of the token space whose frequencies are counted, in units of 1 - threshold
RARE, COMMON = 16, 256          # greatest frequencies of tokens indexed singly and in pairs
SMALL, SMALL_REST = 16, 256     # sets in a bucket whose pairs are formed: of the index, under a pivot
BROADCAST_ENTRIES = 500_000     # of 8 to 16 bytes
SENT = 100_000                  # signatures that a task holds before it sends them
SHORT = 64                      # the band of sets whose tokens run out before their prefix is long enough; no size is in it


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    m = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - m + 1, m, np.uint64)
        for k in range(m):
            out = mix(out) + h[k : len(h) - m + 1 + k]
    return np.unique(mix(out))


def set_digest(tokens: np.ndarray) -> int | None:
    """The id of a set; sets are equal just if their ids are (64 bits)."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def counted_below(threshold: float) -> int:
    """Tokens under this hash are counted: somewhat more than a prefix of single tokens has."""
    return min(int(SLICE * (1 - threshold) * 2**64), 2**64 - 1)


def least_shared(n: int, threshold: float) -> int:
    """Tokens that a set of n shares with any partner, at least."""
    return math.ceil(threshold * n - 1e-9)


def band_groups(band: int, threshold: float) -> int:
    return max(1, int(2.0**band * (1 - threshold) / 3))


def bands(n: int, threshold: float) -> set[int]:
    sizes = (n, least_shared(n, threshold), math.floor(n / threshold + 1e-9))
    return {max(0, s.bit_length() - 1) for s in sizes}


def longest_prefix(n: int, threshold: float) -> int:
    """Tokens that a prefix can need, whatever the classes."""
    groups = max(band_groups(b, threshold) for b in bands(n, threshold))
    return n - least_shared(n, threshold) + 1 + 5 * groups


def signatures(n: int, head: np.ndarray, kinds: np.ndarray, threshold: float) -> tuple[list[np.ndarray], bool]:
    """Signatures in each band (in the order of the bands; those of ``SHORT`` last, if any), and whether all are single
    tokens. ``head`` holds the first tokens by hash, ``kinds`` how many tokens a signature of each has: 1, 2, 3, or 4 for
    tokens beyond the counted slice (3 tokens, after all others)."""
    need = n - least_shared(n, threshold) + 1
    single = head[kinds == 1]
    salts = {b: mix(np.array([b + 1], np.uint64))[0] for b in sorted(bands(n, threshold))}
    if len(single) >= need:
        return [mix(single[:need] ^ salts[b]) for b in salts], True
    out, short = [], False
    for b, salt in salts.items():
        groups, held = band_groups(b, threshold), len(single)
        inside: dict[tuple[int, int], list[int]] = {}
        for kind in (2, 3, 4):
            size = min(kind, 3)
            for token in head[kinds == kind].tolist():
                if held >= need:
                    break
                own = inside.setdefault((kind, (token >> 7) % groups), [])
                own.append(token)
                held += len(own) >= size
        short = short or held < need
        found = [*single.tolist()]
        joint = []
        for (kind, group), own in inside.items():
            joint += [(kind, group, *c) for c in itertools.combinations(own, min(kind, 3))]
        digests = [xxhash.xxh3_64_intdigest(np.array(c, np.uint64).tobytes()) for c in joint]
        out.append(mix(np.array(found + digests, np.uint64) ^ salt))
    if short:  # the head is the whole set: its first tokens in the one order
        first = head[np.argsort(kinds, kind="stable")][:need]
        out.append(mix(first ^ mix(np.array([SHORT + 1], np.uint64))[0]))
    return out, False


def _heads(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, row, n_shingles, id, head): size and digest of each set (null if empty) and its first tokens by hash."""
    limit = np.uint64(counted_below(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, heads = [], [], []
            for text in texts(batch.column(1)):
                s = shingles(text, n)
                sizes.append(len(s))
                digests.append(set_digest(s))
                heads.append(s[: max(int(np.searchsorted(s, limit)), longest_prefix(len(s), threshold))] if len(s) else s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()),
                 lists(signed(np.concatenate([*heads, np.zeros(0, np.uint64)])), [len(h) for h in heads])],
                names=["doc_id", "row", "n_shingles", "id", "head"])

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "doc_id long, row long, n_shingles long, id long, head array<long>")


def _kinds(head: np.ndarray, frequent: np.ndarray, classes: np.ndarray, limit: int) -> np.ndarray:
    kinds = np.ones(len(head), np.int8)
    kinds[head >= np.uint64(limit)] = 4
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, head), len(frequent) - 1)
        kinds = np.where(frequent[at] == head, classes[at], kinds)
    return kinds


def _signature_rows(sets: DataFrame, threshold: float, sent) -> DataFrame:
    """(sig, id, n, pure, band) of sets (id, n, head[, tokens, classes]); ``sent`` is the broadcast table of frequent
    tokens, None where each set has its own list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, pure, band, rows, lengths = [], [], [], [], [], []
            columns = batch.to_pydict()
            for k, (i, n) in enumerate(zip(columns["id"], columns["n"])):
                head = np.array(columns["head"][k], np.int64).view(np.uint64)
                if sent is not None:
                    frequent, classes = sent.value
                else:
                    frequent = np.array(columns["tokens"][k] or [], np.int64).view(np.uint64)
                    order = np.argsort(frequent)
                    frequent, classes = frequent[order], np.array(columns["classes"][k] or [], np.int8)[order]
                found, single = signatures(n, head, _kinds(head, frequent, classes, counted_below(threshold)), threshold)
                for b, part in zip([*sorted(bands(n, threshold)), SHORT], found):
                    part = np.unique(part)
                    rows.append(part)
                    lengths.append(len(part))
                    ids.append(i)
                    sizes.append(n)
                    pure.append(single)
                    band.append(b)
            repeat = lambda x, kind: np.repeat(np.array(x, kind), lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate([*rows, np.zeros(0, np.uint64)]))), pa.array(repeat(ids, np.int64)),
                 pa.array(repeat(sizes, np.int32)), pa.array(repeat(pure, bool)), pa.array(repeat(band, np.int8))],
                names=["sig", "id", "n", "pure", "band"])

    return sets.mapInArrow(run, "sig long, id long, n int, pure boolean, band byte")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ENTRIES else df


def _buckets(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` whose signature more than one set has, with the size of the bucket."""
    again = materialize(rows.groupBy("sig").agg(F.count("*").alias("bucket")).where("bucket > 1"), f"{name}_counts")
    return materialize(rows.join(again, "sig"), name)


def _compatible(a: str, b: str, threshold: float):
    return (F.col(a) >= threshold * F.col(b) - 1e-9) & (F.col(b) >= threshold * F.col(a) - 1e-9)


def _needed(a, b, threshold: float):
    """Shared tokens that sets of these sizes need to link."""
    return F.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _pairs(buckets: DataFrame, threshold: float, small: int) -> DataFrame:
    """Pairs (a, b) of small buckets, less those known to be connected (of one label) and those that share too few signatures
    for their sizes."""
    rows = buckets.where(F.col("bucket") <= small)
    left = rows.select("sig", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pure").alias("pa"), "band", F.col("label").alias("la"))
    right = rows.select("sig", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pure").alias("pb"), F.col("label").alias("lb"))
    found = left.join(right, (left["sig"] == right["sig"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
                      & _compatible("na", "nb", threshold))
    counted = found.groupBy("a", "b", "na", "nb", "band").agg(F.count("*").alias("shared"), F.min(F.col("pa") & F.col("pb")).alias("pure"))
    most = F.greatest("na", "nb")
    enough = F.col("shared") >= _needed(F.col("na"), F.col("nb"), threshold) - F.ceil(threshold * most - 1e-9) + 1
    return counted.where(~F.col("pure") | enough).select("a", "b").distinct()


def _labels(links: DataFrame, steps: int = 3) -> DataFrame:
    """(id, label): sets of one label are connected by links. Not all that are connected have one label yet: labels reach some
    steps, the farther the more there are."""
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both_ways")
    label = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(steps - 1):
        near = both.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        jump = label.select(F.col("id").alias("label"), F.col("label").alias("further"))  # a label is an id, which has a label
        label = label.join(near, "id").join(jump, "label", "left").select("id", F.least("label", "near", "further").alias("label"))
        label = materialize(label, "labels")
    return label


def _least_of_others(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, low, low_label, other): the least value of a key, its label, and the least of the other labels; keys of one label
    are left out."""
    by_label = rows.groupBy(key, "label").agg(F.min(value).alias("v"))
    first = by_label.groupBy(key).agg(F.min(F.struct("v", "label")).alias("m"))
    rest = by_label.join(first, key).where(F.col("label") != F.col("m.label")).groupBy(key).agg(F.min("v").alias("other"))
    return first.join(rest, key).select(key, F.col("m.v").alias("low"), F.col("m.label").alias("low_label"), "other")


def rest_signatures(tokens: np.ndarray, times: np.ndarray, least: int, groups: int) -> np.ndarray:
    """Signatures of one set under a pivot, which shares at least ``least`` of its tokens with any partner: prefixes in the order
    of ``times`` (how many sets of the group have a token). A signature has 1 token, 2 or 3 by its class; combinations are taken
    inside ``groups`` hash slices."""
    order = np.lexsort((tokens, times))
    tokens, kinds = tokens[order], np.where(times[order] <= RARE, 1, np.where(times[order] <= COMMON, 2, 3))
    need = len(tokens) - least + 1
    single = tokens[kinds == 1][:need]
    if len(single) >= need:
        return mix(single)
    out, held, inside = [mix(single)], len(single), {}
    for kind in (2, 3):
        for token in tokens[kinds == kind].tolist():
            if held >= need:
                break
            own = inside.setdefault((kind, (token >> 7) % groups), [])
            own.append(token)
            held += len(own) >= kind
    if held < need:  # too few tokens for combinations: all of them singly, under a salt that only such sets have
        out.append(mix(mix(tokens[:need]) ^ np.uint64(1)))
    joint = [(kind, group, *c) for (kind, group), own in inside.items() for c in itertools.combinations(own, kind)]
    out.append(np.array([xxhash.xxh3_64_intdigest(np.array(c, np.uint64).tobytes()) for c in joint], np.uint64))
    return np.unique(np.concatenate(out))


def _rest_buckets(stars: DataFrame, label: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Buckets (sig, id, n, label, bucket) of the sets under their pivots, of more than one label each, and links (a, b) that are certain."""
    share = (1 - threshold) / (1 + threshold)
    items = stars.select(F.col("a").alias("p"), F.col("b").alias("id"), F.col("nb").alias("n"), "rest")
    items = items.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = items.groupBy("p").agg(F.count("*").alias("k"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    items = materialize(items.join(several.select("p", "k"), "p"), "star_items")
    # What tells more than half of the sets from the pivot changes sides, as if the pivot were the group's median.
    most = items.select("p", "k", F.explode("rest").alias("token")).groupBy("p", "token").agg(F.count("*").alias("times"), F.first("k").alias("k"))
    most = materialize(most.where("2 * times > k").select("p", "token"), "medians")
    turned = most.groupBy("p").agg(F.collect_list("token").alias("turned"))
    items = items.join(_small(turned, most.count()), "p", "left")
    rest = F.concat(F.array_except("rest", "turned"), F.array_except("turned", "rest"))
    items = items.withColumn("rest", F.when(F.col("turned").isNull(), F.col("rest")).otherwise(rest))
    items = materialize(items.select("p", "id", "n", (F.size("rest") - share * F.col("n")).alias("e"), "label", "rest"), "median_items")
    # Certain links: with the set of least e, wherever the sum is not above 0. The labels that they connect are one under this pivot.
    least = items.groupBy("p").agg(F.min(F.struct("e", "id", "label")).alias("m")).select("p", F.col("m.e").alias("me"), F.col("m.id").alias("mid"), F.col("m.label").alias("one"))
    near = materialize(items.select("p", "id", "e", "label").join(least, "p").where((F.col("id") != F.col("mid")) & (F.col("e") + F.col("me") <= 1e-9))
                       .select("p", "id", "mid", "label", "one"), "certain")
    certain = near.select(F.col("mid").alias("a"), F.col("id").alias("b"))
    items = items.join(near.select("p", "label", "one").distinct(), ["p", "label"], "left").withColumn("label", F.coalesce("one", "label"))
    groups = materialize(_least_of_others(items, "p", "e"), "groups")
    items = items.join(groups, "p").withColumn("partner", F.when(F.col("label") == F.col("low_label"), F.col("other")).otherwise(F.col("low")))
    items = materialize(items.select("p", "id", "n", "e", "partner", "label", "rest"), "items")
    # A linked pair that is not certain shares this many tokens at least.
    alpha = F.greatest(F.lit(1), F.ceil((F.col("e") + F.col("partner")) / 2 - 1e-9)).cast("int")
    rest = items.select("p", "id", "n", "label", alpha.alias("least"), F.explode("rest").alias("token"))
    for _ in range(2):
        shared = rest.groupBy("p", "token").agg(F.count("*").alias("times"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        rest = rest.drop("times").join(shared.select("p", "token", "times"), ["p", "token"])
        left = F.count("*").over(Window.partitionBy("p", "id"))  # a set's own tokens
        rest = materialize(rest.withColumn("left", left).where("left >= least").drop("left"), "rest")
    own = rest.groupBy("p", "id", "n", "label", "least").agg(F.collect_list(F.struct("token", "times")).alias("of"))  # a set's own tokens
    own = materialize(own, "rest_sets")
    # One number of groups for all sets under a pivot: half of the tokens that a prefix needs on average.
    groups = own.groupBy("p").agg(F.greatest(F.lit(1), F.floor(F.avg(F.size("of") - F.col("least") + 1) / 2)).cast("int").alias("groups"))
    own = own.join(groups, "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = np.asarray(batch["of"].value_lengths()), batch["of"].flatten()
            tokens, times = flat.field("token").to_numpy().view(np.uint64), flat.field("times").to_numpy()
            ends, pivots = np.cumsum(sizes), mix(batch["p"].to_numpy().view(np.uint64))
            found, at, held = [], [], 0
            for k, (low, slices) in enumerate(zip(batch["least"].to_numpy(), batch["groups"].to_numpy())):
                part = slice(ends[k] - sizes[k], ends[k])
                found.append(mix(rest_signatures(tokens[part], times[part], int(low), int(slices)) ^ pivots[k]))
                at.append(np.full(len(found[-1]), k))
                held += len(found[-1])
                if held > SENT or k == len(sizes) - 1:  # sets with many signatures go on by themselves
                    own_rows = pa.array(np.concatenate(at))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found))), *[batch[c].take(own_rows) for c in ("id", "n", "label")]],
                                                     names=["sig", "id", "n", "label"])
                    found, at, held = [], [], 0

    sigs = materialize(own.mapInArrow(run, "sig long, id long, n long, label long"), "rest_signatures")
    wide = sigs.groupBy("sig").agg(F.count("*").alias("bucket"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return materialize(sigs.join(wide.select("sig", "bucket"), "sig"), "rest_buckets"), certain


def _rest_pairs(buckets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different labels of the small buckets under pivots."""
    rows = buckets.where(F.col("bucket") <= SMALL_REST)
    left = rows.select("sig", F.col("id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    right = rows.select(F.col("sig").alias("sig2"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    found = left.join(right, (F.col("sig") == F.col("sig2")) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _compatible("na", "nb", threshold))
    return found.select("a", "b").distinct()


def _pivots(buckets: DataFrame, small: int) -> DataFrame:
    """(a, b): the pivot of each large bucket with each other set in it. The pivot is the set that meets most others in
    large buckets, so buckets of one group of near copies have one pivot."""
    large = buckets.where(F.col("bucket") > small).select("sig", "id", "bucket")
    weight = large.groupBy("id").agg(F.sum("bucket").alias("weight"))
    pivot = large.join(weight, "id").groupBy("sig").agg(F.max(F.struct("weight", F.negative("id").alias("i"))).alias("p"))
    return (large.join(pivot.select("sig", F.negative("p.i").alias("a")), "sig").where("a <> id")
            .select("a", F.col("id").alias("b")).distinct())


def _compare(pairs: DataFrame, sets: DataFrame, threshold: float, with_rest: bool) -> DataFrame:
    """(a, b, na, nb, shared, rest): exact sizes of intersections; ``rest`` the tokens that just one of a and b has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, na, nb, rests = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = x[at] == y
                shared.append(int(common.sum()))
                na.append(len(x))
                nb.append(len(y))
                if with_rest:
                    rests.append(np.concatenate([y[~common], np.delete(x, at[common])]))
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (na, nb, shared))]
            names = ["a", "b", "na", "nb", "shared"]
            if with_rest:
                columns.append(lists(np.concatenate([*rests, np.zeros(0, np.int64)]), [len(r) for r in rests]))
                names.append("rest")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    n = pairs.count()
    # Few pairs go to the sets, so that only the sets compared are shuffled.
    x = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")).join(_small(pairs, 2 * n), "a")
    y = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    y = y.join(_small(pairs, 2 * n), "b") if 2 * n <= BROADCAST_ENTRIES else y
    both = x.join(y, ["a", "b"] if 2 * n <= BROADCAST_ENTRIES else "b").select("a", "b", "x", "y")
    schema = "a long, b long, na long, nb long, shared long" + (", rest array<long>" if with_rest else "")
    return both.mapInArrow(run, schema)


def _linked(compared: DataFrame, threshold: float) -> DataFrame:
    union = F.col("na") + F.col("nb") - F.col("shared")
    return compared.where(F.col("shared") >= threshold * union - 1e-9).select("a", "b")


def _whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, tokens) of the wanted sets (id, doc_id of a text that has it), tokens sorted as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = [], []
            for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                s = shingles(text, n)
                if set_digest(s) == i:  # another text may have the same doc_id
                    ids.append(i)
                    sets.append(np.sort(signed(s)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), lists(np.concatenate([*sets, np.zeros(0, np.int64)]), [len(s) for s in sets])], names=["id", "tokens"])

    wanted = materialize(wanted, "wanted")
    n_wanted = wanted.count()
    whole = docs.join(_small(wanted, 2 * n_wanted), "doc_id").select("id", "text").mapInArrow(run, "id long, tokens array<long>")
    repeated = not wanted.groupBy("doc_id").count().where("count > 1").isEmpty()
    return materialize(whole.dropDuplicates(["id"]) if repeated else whole, "whole_sets")


def similarity_links(docs: DataFrame, sets: DataFrame, named: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b) links between distinct sets (rows of ``_heads``) that connect all linked ones; ``named`` has a set_id, the
    doc_id of a text, for each."""
    spark = docs.sparkSession
    sets = sets.select("id", F.col("n_shingles").cast("int").alias("n"), "head")
    # Tokens are unsigned and stored as signed longs.
    below, token = counted_below(threshold), F.col("token")
    counted_token = (token >= 0) & (token < below) if below < 1 << 63 else (token >= 0) | (token < below - (1 << 64))
    counted = (sets.select(F.explode("head").alias("token")).where(counted_token)
               .groupBy("token").agg(F.count("*").alias("times")).where(F.col("times") > RARE))
    frequent = materialize(counted.select("token", F.when(F.col("times") <= COMMON, 2).otherwise(3).cast("byte").alias("class")), "frequent")
    if frequent.count() <= BROADCAST_ENTRIES:
        table = frequent.toPandas()
        tokens = table["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        sent = spark.sparkContext.broadcast((tokens[order], table["class"].to_numpy(np.int8)[order]))
    else:
        sent = None
        own = (sets.select("id", F.explode("head").alias("token")).join(frequent, "token")
               .groupBy("id").agg(F.collect_list("token").alias("tokens"), F.collect_list("class").alias("classes")))
        sets = sets.join(own, "id", "left")
    buckets = _buckets(_signature_rows(sets, threshold, sent).withColumn("label", F.col("id")), "buckets")
    pairs, pivots = materialize(_pairs(buckets, threshold, SMALL), "pairs"), materialize(_pivots(buckets, SMALL), "pivots")
    met = pairs.unionByName(pivots).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = _whole_sets(docs, met.join(named, "id").select("id", F.col("set_id").alias("doc_id")), n)
    links = materialize(_linked(_compare(pairs, whole, threshold, False), threshold), "small_links")
    while not pivots.isEmpty():
        stars = materialize(_compare(pivots, whole, threshold, True), "stars")
        links = links.unionByName(_linked(stars, threshold))
        label = _labels(links)
        buckets, certain = _rest_buckets(stars, label, threshold)
        pairs = materialize(_rest_pairs(buckets, threshold), "pairs")
        found = _linked(_compare(pairs, whole, threshold, False), threshold).unionByName(certain)
        links = links.unionByName(materialize(found, "links"))
        pivots = materialize(_pivots(buckets, SMALL_REST), "pivots")
    return links


def ngram_jaccard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """A row per row of ``df``: doc_id, ``n_shingles``, ``set_id`` (the smallest id with an equal set) and ``component_id``
    (the smallest id that links reach)."""
    docs = documents(df, id_col, text_col)
    heads = materialize(_heads(docs, n, threshold), "heads")
    # One row for each set; rows are told apart by their number, as ids may come again.
    one = heads.where("id IS NOT NULL AND doc_id IS NOT NULL").groupBy("id").agg(F.min(F.struct("doc_id", "row")).alias("one"))
    one = materialize(one.select("id", F.col("one.doc_id").alias("set_id"), "one.row"), "sets")
    n_sets = one.count()
    least = math.ceil(threshold / (1 - threshold) - 1e-9)  # smaller sets link with copies only
    sets = heads.where(F.col("n_shingles") >= least).join(_small(one.select("row"), n_sets), "row")
    links = similarity_links(docs, sets, one, n, threshold)
    label = components(links)
    named = label.join(one.select("id", "set_id"), "id")
    least_id = named.groupBy("component").agg(F.min("set_id").alias("component_id"))
    named = named.join(least_id, "component").select("id", "component_id")
    names = materialize(one.select("id", "set_id").join(named, "id", "left"), "set_names")
    return (heads.select("doc_id", "n_shingles", "id").join(names, "id", "left")
            .select("doc_id", "n_shingles", F.coalesce("set_id", "doc_id").alias("set_id"),
                    F.coalesce("component_id", "set_id", "doc_id").alias("component_id")))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the document with the smallest id. Rows without words
    and rows without an id all stay; rows that repeat an id and its text stay once."""
    found = ngram_jaccard(df, id_col, text_col, n, threshold)
    alone = (F.col("doc_id") == F.col("component_id")) & (F.col("n_shingles") > 0)
    gone = materialize(found.groupBy("doc_id").agg(F.max(alone | (F.col("n_shingles") == 0)).alias("stays")).where("NOT stays")
                       .select(F.col("doc_id").alias("__gone")), "near_duplicates")
    kept = df.join(_small(gone, gone.count()), F.col(id_col) == F.col("__gone"), "left_anti")
    again = not df.groupBy(id_col).count().where("count > 1").isEmpty()
    return kept.dropDuplicates([id_col, text_col]) if again else kept


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, threshold=0.9)
    return out.select("doc_id", "n_shingles", "component_id", "set_id")
