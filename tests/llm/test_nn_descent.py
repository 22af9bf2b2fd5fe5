"""Operator 11 against all pairs."""

import numpy as np
import pytest

from hitlink.llm import nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, node int"


def plain(rows, threshold=0.93):
    ok = [k for k, (i, v, lab, *_) in enumerate(rows) if i is not None and lab is not None and v is not None and len(v)
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    adjacent = {k: [] for k in range(len(rows))}
    groups = {}
    for k in ok:
        groups.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for members in groups.values():
        x = np.array([rows[k][1] for k in members], np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, hit in zip(members, x @ x.T >= threshold):
            adjacent[a] = [members[j] for j in np.flatnonzero(hit) if members[j] != a]
    component = {}
    for k in range(len(rows)):
        if k in component:
            continue
        group, stack = {k}, [k]
        while stack:
            for j in adjacent[stack.pop()]:
                if j not in group:
                    group.add(j)
                    stack.append(j)
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        component |= {j: min(ids) if ids else None for j in group}
    return sorted(((r[0], len(adjacent[k]), component[k], r[0] == component[k]) for k, r in enumerate(rows)), key=repr)


def got(df, **options):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in nn_descent.near_duplicates(df, **options).collect()), key=repr)


def near(rng, centre, cosine):
    """A unit vector at this cosine from ``centre``."""
    side = rng.standard_normal(len(centre))
    side -= side @ centre * centre
    return cosine * centre + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def unit(rng, n=32):
    x = rng.standard_normal(n)
    return x / np.linalg.norm(x)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [unit(rng) for _ in range(600)]
    out += [near(rng, out[k], rng.choice([0.94, 0.97, 0.92, 0.999])) for k in range(0, 120, 2)]  # pairs, some below the threshold
    tight, wide = unit(rng), unit(rng)
    out += [near(rng, tight, 0.99) for _ in range(150)]     # all link, sure by their angles
    out += [near(rng, wide, 0.963) for _ in range(130)]     # in doubt: cosines about 0.927
    chain = unit(rng)
    for _ in range(40):
        chain = near(rng, chain, 0.95)
        out.append(chain)
    for _ in range(6):                                       # groups about the length of a list
        c = unit(rng)
        out += [near(rng, c, 0.985) for _ in range(rng.integers(8, 14))]
    rows = [(k, [float(np.float32(x)) for x in v], int(k % 2) if k < 600 else 0, "s", 1) for k, v in enumerate(out)]
    rows += [(2000 + k, rows[k % 5][1], rows[k % 5][2], "s", 1) for k in range(50)]  # exact copies
    rows += [(2100 + k, [2 * x for x in rows[700][1]], 0, "s", 1) for k in range(3)]  # scaled
    rows += [(2200, rows[700][1], 1, "s", 1), (2201, rows[700][1], None, "s", 1)]  # another label, none
    return rows


def test_all_links_are_found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = plain(rows)
    assert got(df) == want
    # Short lists and small blocks: what is found is audited to a share, and nothing is found that is not there.
    short = got(df, block=16, k=6)
    assert all(a[1] <= b[1] for a, b in zip(short, want)) and sum(a == b for a, b in zip(short, want)) >= 0.99 * len(want)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1, "s", 1), (1, v, 1, "s", 1), (2, None, 1, "s", 1), (3, [0.0, 0.0, 0.0], 1, "s", 1), (4, [1.0, None, 3.0], 1, "s", 1),
            (5, [1.0, float("nan"), 3.0], 1, "s", 1), (6, [1.0, float("inf"), 3.0], 1, "s", 1), (7, [], 1, "s", 1), (8, [1.0, 2.0], 1, "s", 1),
            (9, [1.0, 2.0, 3.0], None, "s", 1), (None, v, 1, "s", 1), (10, [2.0, 4.0, 6.0], 1, "s", 1), (0, v, 2, "s", 1), (11, [-1.0, -2.0, -3.0], 1, "s", 1)]
    want = [(i, n, i if i != 10 else 1, i != 10) for i, n in [(1, 2), (1, 2), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0), (None, 0), (10, 2), (0, 0), (11, 0)]]
    assert got(spark.createDataFrame(rows, SCHEMA)) == sorted(want, key=repr)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame(rows[2:4], SCHEMA)) == [(2, 0, 2, True), (3, 0, 3, True)]
    huge = [(k, [x * 1e300 for x in (1.0, 2.0, k)], 1) for k in (3.0, 3.01, -3.0)]
    df = spark.createDataFrame([(int(k), v, 1) for k, (_, v, _) in enumerate(huge)], "vec_id long, embedding array<double>, label int")
    assert [r[1] for r in got(df)] == [1, 1, 0]


def test_bipartite_components():
    rng = np.random.default_rng(1)
    for _ in range(50):
        mask = rng.random((6, 7)) < 0.2
        rows, columns = nn_descent.connected(mask)
        for i, j in zip(*np.nonzero(mask)):
            assert rows[i] == columns[j]
        assert all(rows[i] == i for i in range(6) if not mask[i].any()) and all(columns[j] == -1 for j in range(7) if not mask[:, j].any())
        reach = (mask.astype(int) @ mask.T.astype(int) > 0) | np.eye(6, dtype=bool)
        for _ in range(6):
            reach = reach.astype(int) @ reach.astype(int) > 0
        assert all((rows[a] == rows[b]) == reach[a, b] for a in range(6) for b in range(6))
