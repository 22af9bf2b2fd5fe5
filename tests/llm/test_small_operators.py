"""Operators 2 to 10 against plain versions on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hitlink import session
from hitlink.session import materialize
from hitlink.llm import ann, langid, licenses, line_dedup, mixing, packing, pii, quality, suffix_dedup

from .conftest import prose

SPACE = " \t\n\x0b\x0c\r"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ---- 2: line dedup ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def liney():
    rng = random.Random(2)
    common = [f"A common line number {k} of some length" for k in range(6)] + ["short", "  ünïcode líne of twenty  "]
    out = []
    for i in range(60):
        lines = [rng.choice(common) if rng.random() < 0.4 else prose(rng, rng.randrange(0, 6)) for _ in range(rng.randrange(1, 9))]
        out.append((i, "\n".join(x.upper() if rng.random() < 0.2 else x + " " * rng.randrange(3) for x in lines)))
    return [*out, (100, None), (101, ""), (102, "\n\n")]


def plain_lines(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(SPACE).translate(low)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(spark, liney):
    df = spark.createDataFrame(liney, "doc_id long, text string")
    assert rows_of(line_dedup.dedup_lines(df), "doc_id", "__n_lines", "__n_dropped", "__kept") == plain_lines(liney)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(liney, columns=["doc_id", "text"]))
    want = sorted(((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in plain_lines(liney)), key=repr)
    assert sorted(con.execute(line_dedup.ORACLE).fetchall(), key=repr) == want


def test_line_runs_are_compacted_by_level(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batches = [spark.createDataFrame([(k, k, 10 * b) for k in range(b + 2)], "k1 long, k2 long, doc_id long") for b in range(4)]
    for b in batches[:3]:
        runs.add(b)
    assert [len(level) for level in runs.levels] == [1, 1]
    assert rows_of(runs.unseen(batches[3]), "k1") == [(4,)]
    runs.add(batches[3])
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert rows_of(runs.compact(), "k1", "n_docs", "max_doc") == [(0, 4, 30), (1, 4, 30), (2, 3, 30), (3, 2, 30), (4, 1, 30)]


# ---- 3: packing ------------------------------------------------------------------------------------------------------

def test_packing_round_trip(spark, odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(3)
    rows = [(i, t) for i, t in odd_rows if i not in (5, None)] + [(100 + k, prose(rng, rng.randrange(1, 900))) for k in range(80)]
    rows.append((99, "It's é, É. 12.5, ’s ab's, <|endoftext|> \x1c\x85 word., a! né:"))
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path).toPandas()
    for i, t in rows:
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for p in out[out.doc_id == i].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    padding = 0
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        n = int(s.length.sum())
        assert n <= 4096
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    assert padding < 4096 * 2


def test_least_squares_and_first_fit():
    rng = np.random.default_rng(1)
    a = packing.combinations(8, 8)
    assert len(a) == 22 and (a @ np.arange(1, 9) == 8).all()
    x = np.zeros(len(a))
    x[rng.choice(len(a), 4, False)] = rng.integers(1, 50, 4)
    got = packing.least_squares(a.T.astype(float), a.T @ x)
    assert (got >= 0).all() and np.allclose(a.T @ got, a.T @ x)
    lengths = rng.integers(1, 100, 300).tolist()
    at = packing.first_fit(lengths, 128)
    load = Counter()
    for n, k in zip(lengths, at):
        load[k] += n
    assert max(load.values()) <= 128 and len(load) <= sum(lengths) / 128 * 1.15 + 1


def test_packing_of_rows_that_repeat_an_id(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "x")], "doc_id long, text string")
    out = packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0)


def test_words_with_combining_marks_have_the_ids_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), packing.WordIds(path)
    pairs = ["T\u0308", "H\u0331", "J\u030c", "W\u030a", "Y\u030a", "T\u0323\u0308", "E\u0301"]
    pairs += [chr(c) + chr(m) for c in range(65, 91) for m in range(0x300, 0x370)]
    for text in [*pairs, " ".join(pairs), "PLAIN J\u030cAR, H\u0331.", "É PLAIN Ünï"]:
        want = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert words.ids(text.encode()) == want, text


# ---- 4: licences -----------------------------------------------------------------------------------------------------

def test_licenses(spark):
    mit = licenses.KNOWN[-1][1]
    rows = [(1, "  released UNDER the mit licence!! "), (2, "(c) 2020 Someone\nReleased under the MIT License."), (3, "prose\nLicensed under CC BY-NC 4.0.\nmore"),
            (4, "prose about the MIT License in a sentence"), (5, None), (6, ""), (7, "head\n\n" + mit.replace(" to ", "\nto ") + "\n\ntail"), (8, "!!!"), (9, mit)]
    got = {r.doc_id: (r.license, r.n_notices, r.notices) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1, "MIT"), 2: ("MIT", 1, "MIT"), 3: (None, 1, "CC-BY-NC-4.0"), 4: (None, 0, ""), 5: (None, 0, ""), 6: (None, 0, ""),
                   7: (None, 1, "MIT"), 8: (None, 0, ""), 9: ("MIT", 1, "MIT")}


# ---- 5: mixing -------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("weights,cycle", [({"a": 5, "b": 3, "c": 1}, 9), ({"a": 0.001, "b": 7, "c": 2.5, "d": 2.5}, 100), ({"x": 1}, 10)])
def test_schedule_keeps_within_one_block(weights, cycle):
    blocks = mixing.shares(weights, cycle)
    slots = mixing.schedule(blocks)
    assert sum(blocks.values()) == len(slots) == cycle and Counter(slots) == blocks
    had = Counter()
    for t, k in enumerate(slots * 2, 1):
        had[k] += 1
        assert all(abs(had[x] - blocks[x] * t / cycle) < 1 for x in blocks)


def test_mix_is_an_order_of_all_rows(spark):
    rows = [(k, None if k % 10 == 0 else f"s{k % 3 if k % 4 else 0}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("mine"))
    out = mixing.mix(df, {"s0": 4, "s1": 2, "s2": 1, None: 1}, block=4, cycle=8).toPandas().sort_values(["slot", "place"])
    assert sorted(out.doc_id) == list(range(400)) and not out.duplicated(["slot", "place"]).any()
    assert out.groupby("slot").source.agg(lambda s: s.fillna("-").nunique()).max() == 1
    held, had = out[out.balanced].drop_duplicates("slot").source.fillna("-"), Counter()
    for t, k in enumerate(held, 1):
        had[k] += 1
        assert all(abs(had[x] - w * t / 8) < 1 for x, w in (("s0", 4), ("s1", 2), ("s2", 1), ("-", 1)))
    assert len(held) > 8


@pytest.mark.parametrize("broadcast", [10**6, -1])
def test_mix_keeps_to_the_true_weights_over_many_cycles(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", broadcast, raising=False)
    sizes = {"big": 4000, "tiny": 1} | {f"s{k}": 300 + 37 * k for k in range(15)}
    df = spark.createDataFrame([(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    out = mixing.mix(df, sizes | {"tiny": 0.5, "big": 4000.3}, block=1).toPandas().sort_values("slot")
    total = sum(sizes.values()) - 0.2
    weight = {s: n / total for s, n in (sizes | {"tiny": 0.5, "big": 4000.3}).items()}
    assert len(out) == out.slot.nunique() == sum(sizes.values())
    for s, part in out.groupby("source"):
        turn = np.arange(len(part))  # every block in its window, those after the first source has run out too
        assert (part.slot >= np.floor(turn / weight[s] - 1e-3)).all() and (part.slot < np.ceil((turn + 1) / weight[s] + 1e-3)).all()
    held, had = out[out.balanced], Counter()
    assert len(held) > 4 * mixing.CYCLE and held.slot.tolist() == list(range(len(held)))
    for t, k in enumerate(held.source, 1):
        had[k] += 1
        assert all(abs(had[x] - w * t) < 1.001 for x, w in weight.items())


# ---- 6: personal data ------------------------------------------------------------------------------------------------

FORMS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_base_spans_on_random_texts(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "@", ".", "..", "-", "+", "+1", " ", "1.2.3.4", "256", "255.01.0.7", "4111111111111111", "4111 1111-1111 1111", "  ", "(", ")", "x", "é", "日", "\n", "_", "%",
             "00", "7", "555-0100", "a.b-c@d-e.f.g", "12345678901234567890", "+49 (30) 1234567"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    texts += ["1" * 30_000, "a." * 20_000, "a@" + "b." * 20_000, "+1" * 5_000, "1-" * 10_000, "1." * 10_000, None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.scan(df).collect():
        text = texts[r.doc_id] or ""
        want = [(k, m.start(), m.end()) for k, (kind, form) in enumerate(FORMS) for m in re.finditer(form, text) if len(text) < 5000 and plain_valid(kind, m.group())]
        if len(text) < 5000:
            assert [(s.kind, s.start, s.end) for s in r.spans] == want, text


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(5)
    rows = [(k, f"{prose(rng, 5)} please call us at +1 555 010 {1000 + k} today") for k in range(12)]
    rows += [(20, "please call us at 555-010-7777 now"), (21, "the invoice number 555-010-8888 is due"), (22, f"{prose(rng, 30)}")]
    rows += [(30 + k, f"write to user{k}@host{k}.org soon") for k in range(6)] + [(40, "write to jane dot doe at home dot org soon"), (41, "write to jane at home dot org soon")]
    out = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    added = {(r.doc_id, pii.KINDS[s.kind], text[r.doc_id][s.start : s.end]) for r in out for s in r.added}
    assert (20, "phone", "555-010-7777") in added and (41, "email", "jane at home dot org") in added
    assert not {i for i, *_ in added} & {21, 22}


def test_accepted_instances_carry_on_to_further_contexts(spark):
    texts, sizes = [f"{c} +1 555 020 {k:03d}" for c in ("la0", "lb0") for k in range(40)], [32, 16, 8, 4, 2]
    number = lambda level, k: f"555 010 {level}{k:03d}"
    for level, n in enumerate(sizes):  # contexts of each level hold its own numbers and those of the one before
        texts += [f"{c}{level} {number(level, k)}" for c in ("la", "lb") for k in range(n)]
        texts += [f"{c}{level} {number(level - 1, k)}" for c in ("la", "lb") if level for k in range(sizes[level - 1])]
    texts += [f"order 555 030 {k:04d}" for k in range(30)] + [f"order +1 555 040 {k:03d}" for k in range(3)]
    out = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    added = {texts[r.doc_id][s.start : s.end] for r in out for s in r.added}
    assert added == {number(level, k) for level, n in enumerate(sizes) for k in range(n)}


def test_contexts_with_many_unseen_identifiers(spark):
    texts = [f"phone: +49 30 55{k:04d}" for k in range(60)] + [f"phone: 030 66{k:04d}" for k in range(40)]
    texts += [f"host {k}.1.2.3" for k in range(40)] + [f"host +49 30 77{k:04d}" for k in range(60)] + ["host 030 880000"]  # of two kinds
    out = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.added} == set(range(60, 100))


# ---- 7: quality ------------------------------------------------------------------------------------------------------

def test_suffix_arrays_find_all_repeats():
    rng = random.Random(6)
    for _ in range(150):
        s = [rng.randrange(3) for _ in range(rng.randrange(4, 28))]

        def common(p, q):
            n = 0
            while max(p, q) + n < len(s) and s[p + n] == s[q + n]:
                n += 1
            return n

        assert quality.repeats(np.array(s)).tolist() == [max(common(p, q) for q in range(len(s)) if q != p) for p in range(len(s))]


def test_quality_rules(spark):
    rng = random.Random(7)
    clean, line = prose(rng, 300), prose(rng, 40)
    rows = [(1, clean), (2, "\n".join([prose(rng, 100), line, prose(rng, 20), line, line])), (3, "word " * 200), (4, clean[:100]), (5, None), (6, "a #b|\na #b|\n \n \n")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and not got[1].base_failed
    assert not got[2].base_failed or got[2].n_repeat_words * 2 > got[2].n_words
    assert not got[2].kept and got[2].longest_repeat >= 40
    assert got[3].base_failed and got[4].base_failed and got[5].base_failed and got[5].n_words == 0
    assert (got[6].n_words, got[6].word_chars, got[6].n_symbols, got[6].n_dup_lines) == (4, 8, 4, 1)


# ---- 8: nearest neighbours -------------------------------------------------------------------------------------------

def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((8, 16)) * 2
    x = centres[rng.integers(0, 8, 1500)] + rng.standard_normal((1500, 16)) * 0.4
    x[7] = x[11] = x[900]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [1.0] * 3), (3080, [1.0] * 15 + [None]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, block_rows=400, query_rows=40).toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(part.vec_id) & set(np.lexsort((np.arange(1500), -scores))[:20]))
        assert part["rank"].tolist() == list(range(1, 21)) and np.allclose(part.score, scores[part.vec_id], rtol=1e-12)
        assert part.score.is_monotonic_decreasing
    assert got.query_id.nunique() == 75 and hits / (75 * 20) >= 0.95
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3, 4]
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# ---- 9: language ID --------------------------------------------------------------------------------------------------

def test_kneser_ney_probabilities_sum_to_one():
    counts = Counter()
    for w, n in (("abab", 3), ("abc", 2), ("ba", 4), ("cab", 1)):
        m = "\x02" + w + "\x03"
        for e in range(2, len(m) + 1):
            counts[m[max(0, e - 3) : e]] += n
    model = langid.estimate(pd.DataFrame([("x", g, n) for g, n in counts.items()], columns=["lang", "gram", "n"]), 3)
    cost = lambda w: float(model.score_words([w])[0][0])  # noqa: E731  of the word and its end
    # p(c | a, start) for each c, as a difference of words that share what follows
    table, context = model.grams[3], "\x02a"
    seen = sum(float(np.exp(table[1][k, 0])) for k in range(len(table[0])) if table[0][k] in {
        langid.gram_hashes(np.frombuffer((context + c).encode("utf-32-le"), "<u4").astype(np.uint64), 3)[-1] for c in "abc\x03"})
    assert 0.5 < seen <= 1.0 + 1e-6
    assert cost("abab") < cost("ccc") < cost("zzz")


def test_languages(spark):
    rng = random.Random(9)
    stems = {"aa": ["lor", "ven", "kat", "mis"], "bb": ["zug", "pfo", "sch", "wim"], "cc": ["ñol", "rrá", "ció", "lla"]}
    text = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(k, 60), k) for i, k in enumerate(rng.choices(list(stems), k=120))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(500 + i, text(k, 40), k) for i, k in enumerate(rng.choices(list(stems), k=60))]
    odd = [(1, None, None), (2, "", None), (3, "123 456 !!", None), (4, "qqq xxyxx jjwq vvv qqjj " * 9, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(test + odd, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i].lang_pred == k and not got[i].rejected and 0 <= got[i].score <= 1 for i, _, k in test)
    assert [(got[i].lang_pred, got[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4].rejected
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(test, "doc_id long, text string, lang string"), none).collect()} == {"und"}


def test_marks_inside_words():
    model = langid.estimate(pd.DataFrame([("x", g, 3) for g in ("\x02a", "\x02ab", "ab\x03")], columns=["lang", "gram", "n"]), 3)
    words = ["a\x02b", "ab", "\x02", "\x03a", "b\x02\x02"]
    together = model.score_words(words)
    assert together[:, 1].tolist() == [len(w) + 1 for w in words]
    assert np.allclose(together, np.concatenate([model.score_words([w]) for w in words]))


def test_languages_of_texts_with_marks(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(k, f"lor\x02ven kat{k} mis\x03 \x02 lor \x03kat", "aa") for k in range(30)] + [(100 + k, f"zug pfo{k} sch wim", "bb") for k in range(30)]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.train(df)).collect()}
    assert got == {i: lang for i, _, lang in rows}


# ---- 10: suffix dedup ------------------------------------------------------------------------------------------------

def plain_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()),
                    hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group,broadcast", [(1500, 10**6), (3, -1)])
def test_repeated_strings(spark, monkeypatch, group, broadcast):
    monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", group)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ENTRIES", broadcast)
    rng = random.Random(10)
    passages = [prose(rng, n) for n in (8, 12, 30, 80)] + ["ü" * 90, "ab" * 70]
    rows = []
    for i in range(70):
        parts = [rng.choice(passages)[rng.randrange(3):] if rng.random() < 0.5 else prose(rng, rng.randrange(0, 25)) for _ in range(rng.randrange(1, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, passages[3] + passages[3])]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=60, gram=20).collect()
    got = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in out), key=repr)
    assert got == plain_repeats(rows, 60)


def test_hash_compared_order_equals_the_order_of_bytes():
    rng = np.random.default_rng(11)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = rng.integers(0, 400, 120)
    sizes = np.minimum(rng.integers(0, 60, 120), 400 - starts)
    group = rng.integers(0, 4, 120)
    order, extension = suffix_dedup.suffix_order(data, starts, sizes, group)
    plain, plain_extension = suffix_dedup._order_by_bytes(data, starts, sizes, group)
    content = lambda o: [(group[k], data[starts[k] : starts[k] + sizes[k]].tobytes()) for k in o]
    assert content(order) == content(plain) and extension.tolist() == plain_extension.tolist()


# ---- odd rows through all --------------------------------------------------------------------------------------------

@pytest.mark.parametrize("operator", [
    line_dedup.dedup_lines, licenses.license_scan, pii.personal_data, quality.quality, suffix_dedup.remove_repeats,
    lambda df: mixing.mix(df, mixing.temperature_weights(df)), lambda df: langid.identify(df, langid.train(df))],
    ids=["lines", "licenses", "pii", "quality", "suffixes", "mix", "languages"])
def test_odd_rows_and_no_rows(odd, nothing, operator):
    out = operator(odd)
    ids = sorted(r.doc_id or 0 for r in out.collect())
    assert ids in (sorted(r.doc_id or 0 for r in odd.collect()), sorted({r.doc_id or 0 for r in odd.collect()}))
    assert operator(nothing).collect() == []


def test_license_units_bring_a_text_into_canonical_form_once(spark):
    df = spark.createDataFrame([(1, "MIT License\n\nx")], "doc_id long, text string")
    plan = licenses.license_scan(df)._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(generated) == 1 and generated[0].count("translate(") <= 1


def test_suffix_dedup_keeps_no_table_of_all_anchors(spark, monkeypatch):
    """The tables that grow with the texts are gone before the sorting: they were most of the disk taken."""
    written = []

    def spy(df, name):
        out = materialize(df, name)
        written.append((name, session._CREATED[-1]))
        return out

    monkeypatch.setattr(suffix_dedup, "materialize", spy)
    rows = [(k, f"{k} " + "the same words once more " * 4 + f"and {k * k} others") for k in range(20)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=60, gram=20).collect()
    assert all(r["removed"] for r in out) and {"anchors", "contexts", "spans"} <= {name for name, _ in written}
    assert not [name for name, path in written if name in ("anchors", "contexts") and path in session._CREATED]
