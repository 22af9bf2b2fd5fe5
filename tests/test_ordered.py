"""Positions, running sums and order statistics with one exchange; dedup orders; correlations."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hitlink.operators import dedup as U
from hitlink.operators import ordered as OD
from hitlink.operators import ranking as RK
from hitlink.operators import stats as ST
from hitlink.operators.impute import MedianImputer


def written_exchanges(df):
    """Row exchanges in the plan of a frame: those that feed a broadcast are left out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange (hash|range|RoundRobin)", plan))


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.choice(["hot", "a", "b", None], n, p=[0.7, 0.1, 0.1, 0.1]),
                        "x": np.round(rng.normal(size=n), 2), "y": rng.integers(0, 4, n).astype(float), "z": rng.exponential(size=n) * 1e6})
    pdf.loc[rng.random(n) < 0.2, "x"] = np.nan
    pdf.loc[:, "w"] = pdf["x"] * 3 + rng.normal(size=n)
    return pdf


def spark_frame(spark, pdf):
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "id long, g string, x double, y double, z double, w double")
    return df.repartition(6)


def test_quantiles_of_all_groups_and_columns(spark, frame):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    df = spark_frame(spark, frame)
    got = {(r.g, r.feature): (r.total, r.q) for r in OD.quantiles(df, ["x", "y", "z"], probs, ["g"]).collect()}
    groups = [g for g in frame.g.unique()]
    assert len(got) == len(groups) * 3
    for g in groups:
        part = frame[frame.g == g] if g is not None else frame[frame.g.isna()]
        for c in ("x", "y", "z"):
            v = part[c].dropna()
            assert got[(g, c)][0] == len(v) and got[(g, c)][1] == pytest.approx(np.quantile(v, probs).tolist(), rel=1e-12)
    whole = {r.feature: r.q for r in OD.quantiles(df, ["x", "z"], [0.5]).collect()}
    assert whole["x"][0] == pytest.approx(frame.x.median()) and whole["z"][0] == pytest.approx(frame.z.median())


def test_quantiles_of_nothing_one_value_and_infinities(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, float("inf")), ("b", 2.0, float("inf"))], "g string, x double, y double")
    got = {(r.g, r.feature): r.q for r in OD.quantiles(df, ["x", "y"], [0.0, 1.0], ["g"]).collect()}
    assert got == {("b", "x"): [2.0, 2.0], ("a", "y"): [1.0, float("inf")], ("b", "y"): [float("inf")] * 2}
    assert OD.quantiles(df.where("false"), ["x"], [0.5]).collect() == []


def test_no_percentile_in_any_plan(spark, frame, monkeypatch):
    """Quartiles, outliers, boxes and medians never hold a group's values in one aggregate."""
    plans = []
    real = OD.materialize
    spy = lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1]
    monkeypatch.setattr(OD, "materialize", spy)
    monkeypatch.setattr(ST, "materialize", spy)
    df = spark_frame(spark, frame)
    out = [ST.summary(df, ["x", "z"]), ST.outliers_iqr(df, ["x", "z"]), ST.box_stats(df, "x", "g")]
    MedianImputer(inputCols=["x"]).fit(df)
    text = " ".join(plans + [o._jdf.queryExecution().executedPlan().toString() for o in out])
    assert "percentile" not in text and "median(" not in text and len(plans) >= 7


def test_summary_outliers_and_boxes(spark, frame):
    df = spark_frame(spark, frame)
    got = {r.feature: r for r in ST.summary(df, ["x", "z", "y"]).collect()}
    for c in ("x", "y", "z"):
        want = frame[c].describe()
        assert [got[c][k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(want.tolist(), rel=1e-9)
    out = {r.feature: r for r in ST.outliers_iqr(df, ["z"], k=1.5).collect()}["z"]
    q1, q3 = frame.z.quantile([0.25, 0.75])
    assert out.outliers == ((frame.z < q1 - 1.5 * (q3 - q1)) | (frame.z > q3 + 1.5 * (q3 - q1))).sum()
    boxes = {r.g: r for r in ST.box_stats(df, "z", "g").collect()}
    v = frame[frame.g == "a"].z
    a, b = v.quantile([0.25, 0.75])
    assert boxes["a"].whisker_high == pytest.approx(v[v <= b + 1.5 * (b - a)].max()) and boxes["a"].median == pytest.approx(v.median())
    assert set(boxes) == {"hot", "a", "b", None}


def test_ranks_take_one_exchange_of_the_rows(spark, frame, monkeypatch):
    seen = []
    real = OD.materialize
    monkeypatch.setattr(OD, "materialize", lambda df, name: (seen.append(written_exchanges(df)), real(df, name))[1])
    df = spark.createDataFrame(frame[["id", "y"]])
    ranked = RK.global_rank(df, [U.desc("y"), U.asc("id")], partitions=5)
    summed = RK.running_sums(df, [U.desc("y"), U.asc("id")], ["y"], partitions=5)
    assert seen == [1, 1]  # the range partition, before the rows are written
    for out in (ranked, summed):  # afterwards only the table of ranges is exchanged, for the broadcast
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    want = frame.sort_values(["y", "id"], ascending=[False, True]).reset_index(drop=True)
    assert [r.id for r in ranked.orderBy("rank").collect()] == want.id.tolist()
    got = summed.toPandas().set_index("id")["cum_y"]
    assert np.allclose(got.loc[want.id].to_numpy(), want.y.cumsum().to_numpy())


def test_positives_in_top(spark):
    df = spark.createDataFrame([(k, float(100 - k), int(k in (1, 4, 50, 99))) for k in range(100)], "id long, s double, label int")
    r = RK.positives_in_top(df, [U.desc("s"), U.asc("id")], "label", ks=(5, 60)).first()
    assert (r.positives_top_5, r.positives_top_60, r.median_rank) == (2, 3, (5 + 51) / 2)
    none = RK.positives_in_top(df.withColumn("label", F.lit(0)), [U.desc("s"), U.asc("id")], "label", ks=(5,)).first()
    assert none.positives_top_5 == 0 and none.median_rank is None


def test_keep_best_in_descending_order_of_every_type(spark):
    rows = [("k", "a", 1.0, True, None), ("k", "ab", float("nan"), False, 3), ("k", "b", -1.0, None, -5), ("k", "é", None, True, 2**62)]
    df = spark.createDataFrame(rows, "k string, s string, d double, b boolean, n long")
    df = df.withColumn("day", F.expr("date_add(date'2020-01-01', CAST(coalesce(n, 0) % 7 AS INT))")).withColumn("at", F.col("day").cast("timestamp"))
    df = df.withColumn("dec", F.col("n").cast("decimal(30,5)")).withColumn("raw", F.col("s").cast("binary"))
    for c in ("s", "d", "b", "n", "day", "at", "dec", "raw"):
        for last in (True, False):
            o = U.Order(c, desc=True, nulls_last=last)
            want = df.orderBy(o.sort_col(), F.desc("s")).first().s
            assert U.keep_best(df, ["k"], [o, U.desc("s")]).first().s == want, c


def test_correlations_pairwise_complete(spark, frame):
    df = spark_frame(spark, frame).withColumn("z", F.col("z") + 1e9).withColumn("c", F.lit(1.0)).withColumn("e", F.lit(None).cast("double"))
    got = {(r.f1, r.f2): r.r for r in ST.correlations(df, ["x", "y", "z", "w", "c", "e"]).collect()}
    for a, b in (("x", "y"), ("x", "z"), ("x", "w"), ("y", "z"), ("y", "w"), ("z", "w")):
        assert got[(a, b)] == pytest.approx(frame[a].corr(frame[b]), abs=1e-6)
    assert got[("x", "c")] is None and got[("x", "e")] is None and len(got) == 15
    assert all(r.r is None for r in ST.correlations(df.where("false"), ["x", "y"]).collect())
    plan = ST.correlations(df, ["x", "y", "z"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # rows are not multiplied by pairs
