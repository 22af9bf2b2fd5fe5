"""Ranking, sampling and evaluation queries (W1-W10, M2, M3, M8, M11-M14) on the
``songs`` role with a fixed score column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as U
from ..operators import evaluation as EV
from ..operators import ranking as RK
from ..operators import sampling as SM
from ..operators.impute import MedianImputer
from . import fixtures as FX
from .registry import register

SS = FX.sql_scored_songs()
S = FX.sql_songs()
BY_SCORE = [U.desc("score"), U.asc("id")]
FEAT = FX.EDA_FEATURES


def _scored(spark, sf_dir):
    return FX.scored_songs(spark, sf_dir)


def _r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("rank_w1_multi_key_sort", f"SELECT id, year, label FROM {S} ORDER BY year ASC NULLS LAST, label DESC, id")
def rank_w1(spark, sf_dir):
    s = FX.songs(spark, sf_dir).select("id", "year", "label")
    return RK.sort_rows(s, [U.asc("year"), U.desc("label"), U.asc("id")])


@register("rank_w2_global_rank",
          f"SELECT id, label, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {SS}")
def rank_w2(spark, sf_dir):
    return RK.global_rank(_scored(spark, sf_dir).select("id", "label", "score"), BY_SCORE).drop("score")


@register("rank_w3_top_k", f"SELECT id, label, round(score, 6) AS score FROM {SS} ORDER BY score DESC, id LIMIT 100")
def rank_w3(spark, sf_dir):
    return _r6(RK.top_k(_scored(spark, sf_dir).select("id", "label", "score"), BY_SCORE, 100))


@register("rank_w4_precision_at_k",
          f"SELECT 100 AS k, CAST(sum(label) AS BIGINT) AS hits, round(sum(label) / 100.0, 6) AS precision "
          f"FROM (SELECT label FROM {SS} ORDER BY score DESC, id LIMIT 100)")
def rank_w4(spark, sf_dir):
    return _r6(RK.precision_at_k(_scored(spark, sf_dir), BY_SCORE, "label", 100))


@register("rank_w5_precision_curve",
          f"WITH t AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS k FROM {SS} "
          "QUALIFY k <= 700), c AS (SELECT k, sum(label) OVER (ORDER BY k) AS hits FROM t) "
          f"SELECT k, CAST(hits AS BIGINT) AS hits, round(hits / k, 6) AS precision, "
          f"(SELECT round(avg(CAST(label AS DOUBLE)), 6) FROM {S}) AS base_rate FROM c WHERE k % 10 = 0")
def rank_w5(spark, sf_dir):
    c = RK.precision_curve(_scored(spark, sf_dir), BY_SCORE, "label", 700, 10)
    return _r6(c.withColumn("k", F.col("k").cast("long")))


@register("rank_w6_positives_in_top",
          f"WITH r AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {SS}) "
          "SELECT CAST(sum(CASE WHEN label = 1 AND rank <= 100 THEN 1 ELSE 0 END) AS BIGINT) AS positives_top_100, "
          "CAST(sum(CASE WHEN label = 1 AND rank <= 200 THEN 1 ELSE 0 END) AS BIGINT) AS positives_top_200, "
          "(SELECT CAST(median(rank) AS DOUBLE) FROM r WHERE label = 1) AS median_rank FROM r")
def rank_w6(spark, sf_dir):
    return RK.positives_in_top(_scored(spark, sf_dir), BY_SCORE, "label")


@register("sample_w7_exact_n",
          f"SELECT id, label FROM {S} ORDER BY md5(id || '|42'), id LIMIT 1000")
def sample_w7(spark, sf_dir):
    return SM.exact_sample(FX.songs(spark, sf_dir).select("id", "label"), 1000, key="id")


@register("sample_w8_exact_n_per_group",
          f"SELECT id, year FROM (SELECT id, year, row_number() OVER (PARTITION BY year ORDER BY md5(id || '|42'), id) "
          f"AS rn FROM {S}) WHERE rn <= 400")
def sample_w8(spark, sf_dir):
    return SM.exact_sample(FX.songs(spark, sf_dir).select("id", "year"), 400, key="id", by=["year"])


@register("sample_w9_exact_n_strict",
          f"SELECT id FROM {S} WHERE label = 1 ORDER BY md5(id || '|7'), id LIMIT 500")
def sample_w9(spark, sf_dir):
    s = FX.songs(spark, sf_dir).filter(F.col("label") == 1).select("id")
    return SM.exact_sample_strict(s, 500, key="id", seed=7)


@register("sample_w10_seeded_shuffle",
          f"SELECT id, row_number() OVER (ORDER BY md5(id || '|42'), id) AS pos FROM {S}")
def sample_w10(spark, sf_dir):
    return SM.shuffle_positions(FX.songs(spark, sf_dir).select("id"), key="id", seed=42)


@register("eval_m2_stratified_split",
          f"SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(id || '|42'), id) <= "
          f"round(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM {S}")
def eval_m2(spark, sf_dir):
    s = FX.songs(spark, sf_dir).select("id", "label")
    return SM.stratified_split(s, "label", "id", 0.2, 42)


@register("eval_m2_split_balance",
          f"WITH t AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(id || '|42'), id) <= "
          f"round(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM {S}) "
          "SELECT is_test, count(*) AS n, round(avg(CAST(label AS DOUBLE)), 6) AS positive_share FROM t GROUP BY is_test")
def eval_m2b(spark, sf_dir):
    t = SM.stratified_split(FX.songs(spark, sf_dir).select("id", "label"), "label", "id", 0.2, 42)
    return t.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"),
                                    F.round(F.avg(F.col("label").cast("double")), 6).alias("positive_share"))


@register("eval_m3_train_medians",
          f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(id || '|42'), id) <= "
          f"round(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM {S}) "
          + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(median({c}), 6) AS median FROM t WHERE NOT is_test"
                               for c in FEAT))
def eval_m3(spark, sf_dir):
    t = SM.stratified_split(FX.songs(spark, sf_dir), "label", "id", 0.2, 42)
    model = MedianImputer(inputCols=FEAT).fit(t.filter(~F.col("is_test")))
    rows = [(c, None if model.medians[c] is None else round(float(model.medians[c]), 6)) for c in FEAT]
    # The fitted model is a handful of numbers; show them as a frame.
    return spark.createDataFrame(rows, "feature string, median double")


@register("eval_m8_stratified_folds",
          f"SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(id || '|42'), id) - 1) % 5 "
          f"AS INTEGER) AS fold FROM {S}")
def eval_m8(spark, sf_dir):
    return SM.fold_column(FX.songs(spark, sf_dir).select("id", "label"), "label", "id", 5, 42)


_PRED = f"(SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM {SS})"


@register("eval_m11_binary_metrics",
          f"WITH s AS {_PRED}, c AS (SELECT CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS DOUBLE) tp, "
          "CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS DOUBLE) fp, "
          "CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS DOUBLE) tn, "
          "CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS DOUBLE) fn FROM s), "
          "d AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY score), "
          "r AS (SELECT *, sum(n) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) - n + (n + 1) / 2.0 AS avg_rank FROM d), "
          "a AS (SELECT (sum(p * avg_rank) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))) AS auc FROM r) "
          "SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, "
          "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, "
          "round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, "
          "round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, "
          "round(auc, 6) AS roc_auc FROM c, a")
def eval_m11(spark, sf_dir):
    s = EV.with_prediction(_scored(spark, sf_dir), "score")
    return _r6(EV.binary_metrics(s, "label", "prediction", "score"))


@register("eval_m12_confusion_matrix",
          f"WITH s AS {_PRED}, g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(actual, predicted)) "
          "SELECT g.actual, g.predicted, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT label AS actual, prediction AS "
          "predicted, count(*) AS n FROM s GROUP BY 1, 2) x ON g.actual = x.actual AND g.predicted = x.predicted")
def eval_m12(spark, sf_dir):
    s = EV.with_prediction(_scored(spark, sf_dir), "score")
    return EV.confusion_matrix(s, "label", "prediction")


def _report_sql() -> str:
    def cls(k):
        tp = f"CAST(sum(CASE WHEN label = {k} AND prediction = {k} THEN 1 ELSE 0 END) AS DOUBLE)"
        pr = f"CAST(sum(CASE WHEN prediction = {k} THEN 1 ELSE 0 END) AS DOUBLE)"
        sp = f"CAST(sum(CASE WHEN label = {k} THEN 1 ELSE 0 END) AS DOUBLE)"
        return (f"CASE WHEN {pr} > 0 THEN {tp} / {pr} ELSE 0 END", f"CASE WHEN {sp} > 0 THEN {tp} / {sp} ELSE 0 END",
                sp)
    p0, r0, s0 = cls(0)
    p1, r1, s1 = cls(1)
    f = lambda p, r: f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0 END"
    n = "CAST(count(*) AS DOUBLE)"
    rows = [("'0'", p0, r0, f(p0, r0), s0), ("'1'", p1, r1, f(p1, r1), s1),
            ("'macro avg'", f"(({p0}) + ({p1})) / 2", f"(({r0}) + ({r1})) / 2", f"(({f(p0, r0)}) + ({f(p1, r1)})) / 2", n),
            ("'weighted avg'", f"(({p0}) * {s0} + ({p1}) * {s1}) / {n}", f"(({r0}) * {s0} + ({r1}) * {s1}) / {n}",
             f"(({f(p0, r0)}) * {s0} + ({f(p1, r1)}) * {s1}) / {n}", n),
            ("'accuracy'", "NULL", "NULL", f"sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) / {n}", n)]
    return " UNION ALL ".join(
        f"SELECT {a} AS class, round(CAST({b} AS DOUBLE), 6) AS precision, round(CAST({c} AS DOUBLE), 6) AS recall, "
        f"round({d}, 6) AS f1, CAST({e} AS BIGINT) AS support FROM {_PRED}" for a, b, c, d, e in rows)


@register("eval_m13_classification_report", _report_sql())
def eval_m13(spark, sf_dir):
    s = EV.with_prediction(_scored(spark, sf_dir), "score")
    return _r6(EV.classification_report(s, "label", "prediction"))


@register("eval_m14_roc_points",
          f"WITH d AS (SELECT score, count(*) AS n, sum(label) AS p FROM {SS} GROUP BY score), "
          "c AS (SELECT score, sum(p) OVER w AS cp, sum(n - p) OVER w AS cn FROM d "
          "WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), "
          f"t AS (SELECT CAST(sum(label) AS DOUBLE) AS P, CAST(count(*) - sum(label) AS DOUBLE) AS N FROM {S}) "
          "SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr UNION ALL "
          "SELECT round(score, 6), round(cn / N, 6), round(cp / P, 6) FROM c, t")
def eval_m14(spark, sf_dir):
    return _r6(EV.roc_points(_scored(spark, sf_dir), "label", "score"))
