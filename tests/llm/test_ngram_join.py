"""Operator 1 against comparing all pairs."""

import random

import numpy as np
import pytest

from hitlink.llm import ngram_join
from hitlink.llm.components import components

from .conftest import WORDS, prose


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def all_pairs(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return {(i, len(sets[k]), least[top(k)]) for k, (i, _) in enumerate(rows)}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.6:
            words[k] = f"new{rng.randrange(10**6)}"
        elif kind < 0.8 and len(words) > 12:
            del words[k]
        else:
            words.insert(k, rng.choice(WORDS))
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [prose(rng, rng.choice([1, 2, 3, 8, 11, 12, 13, 30, 90])) for _ in range(30)]
    for size, copies in ((40, 8), (150, 25), (400, 12)):
        base = prose(rng, size).split()
        out += [edited(rng, base, rng.randrange(0, max(2, size // 20))) for _ in range(copies)]
        out += [" ".join(base)] * 3
        # the same passage in otherwise different texts, and cuts of different lengths
        out += [prose(rng, 10) + " " + " ".join(base) + " " + prose(rng, rng.randrange(0, 60)) for _ in range(6)]
        out += [" ".join(base[:k]) for k in range(size - size // 8, size, max(1, size // 40))]
    out += ["", None, "ONE two THREE", "one TWO three"]
    rng.shuffle(out)
    return [(3 * k + 7, t) for k, t in enumerate(out)]


def found(spark, rows, n, threshold):
    out = ngram_join.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), n=n, threshold=threshold)
    return {(r.doc_id, r.n_shingles, r.component_id) for r in out.collect()}


def test_large_buckets_go_through_pivots(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", 2)
    monkeypatch.setattr(ngram_join, "COMMON", 10)
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    assert found(spark, rows, 3, 0.9) == all_pairs(rows, 3, 90)


def test_joins_in_place_of_broadcasts(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ENTRIES", -1)
    monkeypatch.setattr(ngram_join, "RARE", 4)
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    assert found(spark, rows, 5, 0.8) == all_pairs(rows, 5, 80)


def test_prefixes_of_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(9, 400))
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        lost = int(rng.integers(0, max(1, len(x) // 20) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[lost:], rng.integers(0, 2**64, int(rng.integers(0, lost + 1)), dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 90 * (len(x) + len(y) - shared):
            continue
        sigs = []
        for s in (x, y):
            kinds = np.where(s >= np.uint64(ngram_join.counted_below(0.9)), 4, 1 + (s >> np.uint64(3)) % np.uint64(3)).astype(np.int8)
            head = s[: max(int((kinds < 4).sum()), ngram_join.longest_prefix(len(s), 0.9))]
            parts, _ = ngram_join.signatures(len(s), head, kinds[: len(head)], 0.9)
            sigs.append(set(np.concatenate(parts).tolist()))
        assert sigs[0] & sigs[1]


def test_prefixes_of_small_sets_share_a_signature():
    rng = np.random.default_rng(4)
    checked = 0
    for _ in range(6000):
        x = np.unique(rng.integers(0, 2**64, int(rng.integers(4, 13)), dtype=np.uint64))
        y = np.unique(np.concatenate([x[int(rng.integers(0, 2)):], rng.integers(0, 2**64, int(rng.integers(0, 2)), dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 10 * shared < 8 * (len(x) + len(y) - shared):
            continue
        sigs = []
        kind = int(rng.integers(2, 4))  # of the counted tokens of both, but for some
        for s in (x, y):
            counted = s < np.uint64(ngram_join.counted_below(0.8))
            kinds = np.where(counted, np.where(s % np.uint64(5) == 0, 1, kind), 4).astype(np.int8)
            head = s[: max(int(counted.sum()), ngram_join.longest_prefix(len(s), 0.8))]
            parts, _ = ngram_join.signatures(len(s), head, kinds[: len(head)], 0.8)
            sigs.append(set(np.concatenate(parts).tolist()))
        assert sigs[0] & sigs[1], (x, y)
        checked += 1
    assert checked > 2000


def test_short_texts_of_frequent_shingles_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", 4)
    monkeypatch.setattr(ngram_join, "COMMON", 10)
    rng = random.Random(6)
    below = np.uint64(ngram_join.counted_below(0.8))
    rows = []
    for in_slice in (1, 2, 3):  # frequent shingles in the counted slice: 2 of 4 leave no group of three
        while True:
            short = " ".join(rng.sample(WORDS, 8))
            if int((ngram_join.shingles(short.encode(), 5) < below).sum()) == in_slice:
                break
        rows += [(1000 * in_slice, short)] + [(1000 * in_slice + k, f"{short} other{in_slice}x{k}") for k in range(1, 30)]
    assert found(spark, rows, 5, 0.8) == all_pairs(rows, 5, 80)


def variants(rng, n, linked):
    """One text with a passage of it replaced at a random place: by one other passage, so that texts with nearly the same place
    link, or by words of its own, so that none do."""
    base, other = prose(rng, 300).split(), prose(rng, 40).split()
    out = []
    for k in range(n):
        at = rng.randrange(len(base) - 40)
        own = other if linked else [f"own{k}x{j}" for j in range(40)]
        out.append((k, " ".join(base[:at] + own + base[at + 40 :])))
    return out


@pytest.mark.parametrize("linked", [True, False])
def test_many_variants_of_one_text(spark, monkeypatch, linked):
    """Most pairs of such a group do not link. Pairs compared grow with the group, and rounds do not."""
    pairs, rounds = {}, {}
    real = ngram_join.materialize
    for n in (150, 450):
        pairs[n] = rounds[n] = 0

        def spy(df, name, n=n):
            out = real(df, name)
            if name in ("pairs", "pivots"):
                pairs[n] += out.count()
                rounds[n] += name == "pivots"
            return out

        monkeypatch.setattr(ngram_join, "materialize", spy)
        rows = variants(random.Random(8), n, linked)
        assert found(spark, rows, 3, 0.9) == all_pairs(rows, 3, 90)
    assert rounds[450] <= rounds[150] + 3
    assert pairs[450] < 6 * pairs[150] + 450 and pairs[450] < 450 * 449 / 2 / 4


def test_sets_under_an_odd_pivot_are_told_apart_by_their_own_tokens(spark):
    """All sets lack the pivot's own tokens; these leave the differences, and sets near the group's median link for certain."""
    base, own = list(range(100, 200)), list(range(300, 315))
    rest = [[*own, 1000 + k] for k in range(20)] + [[*own, *range(2000 + 40 * k, 2030 + 40 * k)] for k in range(4)]
    stars = [(1, 10 + k, 115, len(base) + len(r) - 15, 100, r) for k, r in enumerate(rest)]
    stars = spark.createDataFrame(stars, "a long, b long, na long, nb long, shared long, rest array<long>")
    made, real = {}, ngram_join.materialize

    def spy(df, name):
        made[name] = real(df, name)
        return made[name]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngram_join, "materialize", spy)
        buckets, certain = ngram_join._rest_buckets(stars, spark.createDataFrame([], "id long, label long"), 0.9)
        assert {(r.a, r.b) for r in certain.collect()} == {(10, k) for k in range(11, 30)}
        assert {tuple(r.rest) for r in made["items"].where("id < 30").select("rest").collect()} == {(1000 + k,) for k in range(20)}
        assert {r.label for r in made["items"].where("id < 30").select("label").collect()} == {10}
        assert buckets.count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5), (160, 90)]
    got = {(r.id, r.component) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {(k, 90) for k in [90, *range(100, 161)]} | {(k, 7) for k in [7, *range(200, 260)]} | {(k, 300) for k in (300, 301, 302)}
    assert got == want


def test_odd_rows_and_no_rows(odd, nothing):
    got = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in ngram_join.ngram_jaccard(odd).collect()}
    assert {(1, False, 1), (2, False, 2), (3, False, 3), (4, True, 4), (5, True, 5), (6, True, 6), (12, True, 6), (None, True, None)} <= got
    assert ngram_join.ngram_jaccard(odd).count() == odd.count()
    assert ngram_join.ngram_jaccard(nothing).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
