"""Operators against brute force on small fixtures."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hitlink.operators import dedup as U
from hitlink.operators import evaluation as EV
from hitlink.operators import linkage as L
from hitlink.operators import ranking as RK
from hitlink.operators import sampling as SM
from hitlink.operators import stats as ST


def md5_order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), str(i)))


def test_keep_best_ties_nulls_and_partitions(spark):
    rows = [("k", "a", None), ("k", "b", 5), ("k", "c", 5), ("j", "d", 1), ("", "e", 9), ("", "f", 8)]
    df = spark.createDataFrame(rows, "key string, id string, pop int")
    for parts in (1, 3):
        out = U.keep_best(df.repartition(parts), ["key"], [U.desc("pop"), U.asc("id")], isolate_empty=True)
        got = sorted((r.key, r.id) for r in out.collect())
        assert got == [("", "e"), ("", "f"), ("j", "d"), ("k", "b")]


def test_link_pass_precedence_and_row_count(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "", "z"), (4, "q", "q")], "id int, k1 string, k2 string")
    r1 = spark.createDataFrame([("a", "A1")], "k1 string, v string")
    r2 = spark.createDataFrame([("x", "X2"), ("y", "Y2"), ("z", "Z2"), ("", "E2")], "k2 string, v string")
    out = L.link(left, [L.Pass("one", r1, ["k1"], ["k1"]), L.Pass("two", r2, ["k2"], ["k2"])], ["v"])
    got = {r.id: (r.v, r.match_pass) for r in out.collect()}
    assert out.count() == left.count()
    assert got == {1: ("A1", "one"), 2: ("Y2", "two"), 3: ("Z2", "two"), 4: (None, "none")}


def test_anti_join_ignores_null_keys(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a",), (None,), ("",)], "k string")
    got = sorted((r.k or "<null>") for r in L.anti_join(left, right, ["k"], ["k"]).collect())
    assert got == ["<null>", "b"]


@pytest.mark.parametrize("n", [0, 1, 7, 50, 200])
def test_exact_sample_matches_md5_sort(spark, n):
    ids = [f"id{i}" for i in range(120)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(5)
    got = sorted(r.id for r in SM.exact_sample(df, n, key="id").collect())
    assert got == sorted(md5_order(ids)[:n])


def test_exact_sample_per_group(spark):
    rows = [(f"id{i}", i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, g int")
    got = SM.exact_sample(df, 10, key="id", by=["g"]).collect()
    for g in range(3):
        want = md5_order([r[0] for r in rows if r[1] == g])[:10]
        assert sorted(r.id for r in got if r.g == g) == sorted(want)


def test_strict_sample_fails_when_short(spark):
    df = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(ValueError):
        SM.exact_sample_strict(df, 2, key="id")


def test_split_and_folds_are_exact(spark):
    rows = [(f"r{i}", int(i % 4 == 0)) for i in range(103)]
    df = spark.createDataFrame(rows, "id string, label int")
    s = SM.stratified_split(df, "label", "id").toPandas()
    for lab, grp in s.groupby("label"):
        assert grp.is_test.sum() == round(0.2 * len(grp))
    f = SM.fold_column(df, "label", "id", k=5).toPandas()
    assert set(f.fold) == set(range(5))
    assert f.groupby("label").fold.apply(lambda x: x.value_counts().max() - x.value_counts().min()).max() <= 1


def test_global_rank_and_running_sums(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": [f"x{i:03d}" for i in range(300)], "score": rng.integers(0, 5, 300).astype(float),
                        "v": rng.integers(0, 3, 300)})
    df = spark.createDataFrame(pdf)
    got = RK.global_rank(df, [U.desc("score"), U.asc("id")], partitions=7).toPandas().set_index("id")["rank"]
    want = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
    assert all(got[i] == k + 1 for k, i in enumerate(want.id))
    cs = RK.running_sums(df, [U.asc("score"), U.asc("id")], ["v"], partitions=5).toPandas().set_index("id")["cum_v"]
    w2 = pdf.sort_values(["score", "id"]).assign(c=lambda d: d.v.cumsum()).set_index("id")["c"]
    assert (cs.sort_index() == w2.sort_index()).all()


def test_precision_at_k_divides_by_k(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("b", 0, 0.8)], "id string, label int, score double")
    r = RK.precision_at_k(df, [U.desc("score"), U.asc("id")], "label", 10).first()
    assert r.precision == pytest.approx(0.1)


def test_auc_with_ties_matches_pairs(spark):
    pdf = pd.DataFrame({"label": [1, 0, 1, 0, 1, 0, 0], "score": [0.9, 0.9, 0.5, 0.4, 0.4, 0.1, 0.4]})
    pos, neg = pdf[pdf.label == 1].score, pdf[pdf.label == 0].score
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert EV.auc(spark.createDataFrame(pdf), "label", "score") == pytest.approx(want)


def test_classification_report_and_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, prediction int")
    cm = {(r.actual, r.predicted): r.n for r in EV.confusion_matrix(df, "label", "prediction").collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 1}
    rep = {r["class"]: r for r in EV.classification_report(df, "label", "prediction").collect()}
    assert rep["1"].precision == 1.0 and rep["1"].recall == 0.5 and rep["accuracy"].f1 == 0.75


def test_histogram_matches_numpy(spark):
    x = [0.1, 0.2, 0.2, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    got = {r.bin: r["count"] for r in ST.histogram(df, "x", 4).collect()}
    counts, _ = np.histogram(x, bins=4)
    assert [got.get(i, 0) for i in range(4)] == counts.tolist()
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    c2, _ = np.histogram([3.0, 3.0], bins=40)
    assert {r.bin: r["count"] for r in ST.histogram(const, "x", 40).collect()} == {int(np.argmax(c2)): 2}


def test_summary_quartiles_linear(spark):
    vals = [1.0, 2.0, 10.0, 20.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = ST.summary(df, ["x"]).first()
    assert (r.p25, r.p50, r.p75) == tuple(np.percentile(vals, [25, 50, 75]).tolist())


def test_welch_p_value_known():
    assert ST.student_t_two_sided_p(2.0, 10) == pytest.approx(0.0733880347707, rel=1e-9)
    assert ST.student_t_two_sided_p(0.0, 3) == pytest.approx(1.0)


def test_group_median_impute(spark):
    from hitlink.operators.impute import group_median_impute
    rows = [(1, 2000, True, 1.0), (2, 2000, True, 3.0), (3, 2000, False, None), (4, 2001, False, None),
            (5, None, False, None), (6, 2002, True, None), (7, 2002, False, None)]
    df = spark.createDataFrame(rows, "id int, year int, ok boolean, f double")
    got = {r.id: (r.f, r.features_imputed) for r in group_median_impute(df, "year", ["f"], "ok").collect()}
    # 2000 has features: its median; 2001 and NULL years take the overall median;
    # 2002 exists with an all-NULL column and stays NULL.
    assert got[3] == (2.0, True) and got[4] == (2.0, True) and got[5] == (2.0, True)
    assert got[7] == (None, True) and got[1] == (1.0, False)


def _rows_with_missing(spark):
    return spark.createDataFrame([(None if k % 10 < 3 else k, None if k % 2 else "a", k) for k in range(100)], "key long, label string, row long")


def test_samples_are_exact_with_missing_keys_and_groups(spark):
    df = _rows_with_missing(spark)
    assert SM.exact_sample(df, 50, "key", tiebreak=["row"]).count() == 50
    got = {r.label: r["count"] for r in SM.exact_sample(df, 5, "key", by=["label"], tiebreak=["row"]).groupBy("label").count().collect()}
    assert got == {None: 5, "a": 5}


def test_splits_and_folds_keep_rows_with_missing_keys_and_labels(spark):
    df = _rows_with_missing(spark)
    split = SM.stratified_split(df, "label", "row")
    assert split.count() == 100 and split.where("is_test").groupBy("label").count().where("count = 10").count() == 2
    assert SM.fold_column(df, "label", "key").count() == 100
    assert sorted(r.pos for r in SM.shuffle_positions(df, "key").collect()) == list(range(1, 101))


def test_append_and_pending_are_idempotent_with_a_missing_key_part(spark, tmp_path):
    from hitlink.operators.setops import append_new
    from hitlink.streaming.incremental import append_new_keys, pending
    batch = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (2, 5, "z")], "year int, rank int, v string")
    once = append_new(batch.limit(0), batch, ["year", "rank"], distinct=True)
    assert once.count() == 2 and append_new(once, batch, ["year", "rank"]).count() == 2
    assert pending(batch, [once], ["year", "rank"]).count() == 0
    for _ in range(2):
        append_new_keys(spark, batch, str(tmp_path / "sink"), ["year", "rank"])
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3


def test_keep_best_orders_large_integers_exactly(spark):
    df = spark.createDataFrame([("k", 2**53, "low"), ("k", 2**53 + 1, "high")], "k string, n long, v string")
    assert [r.v for r in U.keep_best(df, ["k"], [U.desc("n")]).collect()] == ["high"]


def test_splits_and_folds_shuffle_whole_rows_at_most_once(spark):
    """Bucket counts are sent to the rows: nothing but a ranking window may move these, in the split that of one bucket."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).selectExpr("cast(id as string) id", "cast(id % 3 as double) label", "repeat('x', 50) wide")
        for out in (SM.stratified_split(df, "label", "id"), SM.fold_column(df, "label", "id"), SM.shuffle_positions(df, "id")):
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
            assert out.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_split_without_test_rows_and_with_test_rows_alone(spark):
    df = spark.range(40).selectExpr("cast(id as string) id", "id % 2 label")
    assert SM.stratified_split(df, "label", "id", 0.0).where("is_test").count() == 0
    assert SM.stratified_split(df, "label", "id", 1.0).where("is_test").count() == 40
    ranked = SM.shuffle_positions(df.where("label = 1"), "id").where("pos <= 7").select("id")
    split = SM.stratified_split(df.where("label = 1"), "label", "id", 0.35).where("is_test").select("id")
    assert sorted(ranked.collect()) == sorted(split.collect())


@pytest.mark.parametrize("sent", [True, False])
def test_group_median_impute_deals_no_row_by_group(spark, monkeypatch, sent):
    """A few groups hold most rows: their medians go to the rows, and with too many groups only rows to be filled are dealt."""
    from hitlink.operators import impute

    monkeypatch.setattr(impute, "BROADCAST_GROUPS", 100 if sent else 0)
    rows = [(i, None if i % 9 == 8 else 2000 + i % 2, i % 7 != 0 if i % 11 else None, float(i) if i % 5 else None) for i in range(400)]
    rows += [(900, 1990, True, None), (901, 1990, False, 5.0), (902, 1980, False, None)]  # no value in the group; no such group
    df = spark.createDataFrame(rows, "id int, year int, ok boolean, f double")
    out = impute.group_median_impute(df, "year", ["f"], "ok")
    have = pd.DataFrame([r for r in rows if r[2]], columns=["id", "year", "ok", "f"])
    want = {}
    for i, year, ok, f in rows:
        group = have[have.year == year]
        fill = group.f.median() if len(group) else have.f.median()
        value = f if ok is not False else None if np.isnan(fill) else float(fill)
        want[i] = (year, value, True, None if ok is None else not ok)
    assert {r.id: (r.year, r.f, r.ok, r.features_imputed) for r in out.collect()} == want
    if sent:
        assert "hashpartitioning(year" not in out._jdf.queryExecution().executedPlan().toString()
