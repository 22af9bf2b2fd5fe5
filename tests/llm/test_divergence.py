"""Operator 13 against a plain version, over blocks of every size, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from hitlink.llm import divergence

from .conftest import WORDS

SCHEMA = "doc_id long, text string, lang string, source string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, min_docs=10):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))) for _, text, lang, source in rows]
    out = []
    for lang in sorted({d[0] for d in docs}):
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in in_docs.items() if n >= min_docs]
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if w in set(kept))
        counts = {s: counts[s] for s in {d[1] for d in own}}
        both = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s, c in counts.items():
            found = [("pair", o, sum(f(p(c, t), p(x, t)) for t in kept)) for o, x in counts.items() if o != s]
            found += [("term", t, f(p(c, t), p(both, t))) for t in kept if c[t] and p(c, t) > p(both, t)]
            for part in ("pair", "term"):
                order = sorted((x for x in found if x[0] == part), key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (_, i, v) in enumerate(order, 1) if part == "pair" or k <= 10]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [*WORDS, "Überall", "GRÖSSE", "naïve", "日本", "a b"]
    out = []
    for k in range(500):
        source = "hot" if k % 3 == 0 else rng.choice(["s1", "s2", "ü", "S1", None, "", *[f"t{j}" for j in range(9)]])
        some = words[hash(source or "") % 7 :: 2] + words[:20]
        out.append((k, rng.choice([" ", ", ", "\n", "-7-"]).join(rng.choice(some) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "en", "de", None]), source))
    out += [(900, "rare words only", "xx", "a"), (901, None, "xx", "b"), (902, "", "xx", None), (903, "alone", "yy", "z")]
    return out + [(950, "Repeated Zebra", "en", "s1")] * 12


def test_audit(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = plain(rows)
    assert got(divergence.audit(df)) == want
    assert any(r[3] == "zebra" for r in want) and any(r[:4] == ("xx", "a", "pair", "b") and r[4] == 0 for r in want)
    assert not any(r[0] == "yy" for r in want)


def test_blocks_and_tables_do_not_matter(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "TABLE_ENTRIES", 50)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(divergence.audit(df, group_block=3, term_block=10)) == plain(rows)


def test_shares_of_great_counts(spark):
    row = spark.range(1).select(divergence.share(*[divergence.F.lit(x).cast("long") for x in (3_000_000_000_000, 7_000_000_000_000, 5)])).first()
    assert row[0] == 1 + 1000000000 * 3_000_000_000_002 // (7_000_000_000_000 + 10)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in odd.collect()]
    assert got(divergence.audit(odd)) == plain(rows) and got(divergence.audit(odd, min_docs=1)) == plain(rows, 1)
    assert got(divergence.audit(nothing)) == []


def test_sql(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    assert sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({divergence.ORACLE})").fetchall()) == plain(rows)
