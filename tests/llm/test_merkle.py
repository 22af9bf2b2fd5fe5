"""Operator 12 against a plain recursive tree, and its query against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hitlink.llm import merkle
from hitlink.llm.common import ascii_lower

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, low=False):
    i, text, lang, source, n = row
    values = [i, source, lang, n, text.translate(LOW) if low and text is not None else text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def steps(levels, j):
    for level in levels[:-1]:
        run = level[j - j % 16 : j - j % 16 + 16]
        yield "".join(run[: j % 16]), "".join(run[j % 16 + 1 :])
        j //= 16


def plain(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted((r for r in rows if r[3] == s), key=key) for s in sources}
    trees = {s: levels_of([leaf_of(r) for r in held[s]]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for j, r in enumerate(held[s]):
            path = [*steps(trees[s], j), *steps(top, k)]
            node = leaf_of(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for a, b in path:
                node = sha(a + node + b)
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def manifest(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.Manifest(df, merkle.FIELDS, "source", "doc_id", {"text": ascii_lower(F.col("text"))}, tampered)


def got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in manifest(df).verified().collect()), key=repr)


def test_positions_are_those_of_a_postorder_walk():
    def walk(level, index, n, out):
        if level:
            width = -(-n // 16 ** (level - 1))
            for i in range(index * 16, min(index * 16 + 16, width)):
                walk(level - 1, i, n, out)
        out.append((level, index))
        return out

    for n in (1, 2, 15, 16, 17, 255, 256, 257, 300, 4097):
        order = walk(merkle.height(n), 0, n, [])
        assert [merkle.position(k, i, n) for k, i in order] == list(range(len(order)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(k, f"Text {rng.random()} É", rng.choice(["en", None]), "big", rng.randrange(99)) for k in rng.sample(range(9000), 4400)]
    out += [(k, "Only One", "en", f"s{k}", None) for k in range(20)]
    out += [(k, None if k % 2 else "", "de", None, k) for k in range(300)]
    return [*out, (7, "copy", "en", "big", 1), (7, "copy", "en", "big", 1), (None, "No id", "en", "big", 1), (8, "x", "en", "", 0), (9, "ü", "en", "ü", 0), (9, "z", "en", "~", 0)]


def test_manifest(spark, rows):
    """A source over several tiers, sources of one row, null and empty sources, repeated rows, null ids."""
    want = plain(rows)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 3


def test_one_source_one_row_and_nothing(spark):
    one = [(3, "Abc", None, "s", 1)]
    assert got(spark.createDataFrame(one, SCHEMA)) == plain(one)
    many = [(k, "Abc", None, None, 1) for k in range(257)]
    assert got(spark.createDataFrame(many, SCHEMA)) == plain(many)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_proofs_lead_to_the_root(spark, rows):
    m = manifest(spark.createDataFrame(rows[:700], SCHEMA))
    leaves = {(r.tree, r.idx): r.digest for r in m.sources[0].selectExpr("tree", "section", "ids", "posexplode(log) AS (at, digest)").where("false").collect()}
    logs = {(r.tree, r.section): r for r in m.sources[0].collect()}
    root = m.top[-1].first().top
    n = 0
    for r in m.proofs().collect():
        section = logs[(r.tree, r.idx // merkle.SPAN)]
        node = section.log[merkle.position(0, r.idx % merkle.SPAN, len(section.ids))]
        for step in r.path:
            node = sha(step.left + node + step.right)
        assert node == root
        n += 1
    assert n == 700 and not leaves
    assert merkle.log_nodes(m.sources[0]).count() == sum(len(r.log) for r in logs.values())


def test_odd_rows(spark, odd, odd_rows, nothing):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd.collect()]
    assert got(odd) == plain(rows) and got(nothing) == []


def test_sql(rows):
    con = duckdb.connect()
    few = rows[:60] + rows[4380:]
    con.register("documents", pd.DataFrame({c: pd.Series([r[k] for r in few], dtype="Int64" if c in ("doc_id", "n_chars") else "object")
                                            for k, c in enumerate(["doc_id", "text", "lang", "source", "n_chars"])}))
    assert sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({merkle.ORACLE})").fetchall(), key=repr) == plain(few)
