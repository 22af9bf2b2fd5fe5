"""Aggregation and statistics queries (A1-A18, A22) over the ``songs`` role
(lineitem x orders; label = returned line)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as PC
from ..operators import stats as ST
from ..operators.impute import group_median_impute
from . import fixtures as FX
from .registry import REGISTRY, r6, register
from .report import eda_report

S = FX.sql_songs()
FEAT = FX.EDA_FEATURES
AUDIO = FX.AUDIO_COLS


def _songs(spark, sf_dir):
    return FX.songs(spark, sf_dir)


def _round_doubles(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _union(parts):
    return " UNION ALL ".join(parts)


@register("agg_a1_value_counts", f"SELECT label, count(*) AS n FROM {S} GROUP BY label")
def agg_a1(spark, sf_dir):
    return ST.value_counts(_songs(spark, sf_dir), "label")


@register("agg_a2_class_balance",
          f"SELECT round(avg(CAST(label AS DOUBLE)), 6) AS positive_share, count(*) AS n FROM {S}")
def agg_a2(spark, sf_dir):
    return _round_doubles(ST.class_balance(_songs(spark, sf_dir)))


@register("agg_a3_summary_statistics", _union([
    f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM {S}" for c in FEAT]))
def agg_a3(spark, sf_dir):
    return _round_doubles(ST.summary(_songs(spark, sf_dir), FEAT))


_A4_COLS = ["peak_rank", "wks_on_chart", "explicit"] + AUDIO
@register("agg_a4_missing_values",
          "SELECT column_name, missing FROM (" + _union([
              f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing "
              f"FROM {S}" for c in _A4_COLS]) + ") WHERE missing > 0")
def agg_a4(spark, sf_dir):
    return ST.missing_audit(_songs(spark, sf_dir), _A4_COLS).withColumnRenamed("column", "column_name")


@register("agg_a5_decade_label_counts",
          f"SELECT CAST(floor(year / 10) * 10 AS INTEGER) AS decade, count(*) FILTER (WHERE label = 0) AS n_label0, "
          f"count(*) FILTER (WHERE label = 1) AS n_label1 FROM {S} GROUP BY 1")
def agg_a5(spark, sf_dir):
    s = _songs(spark, sf_dir).withColumn("decade", PC.decade("year"))
    p = ST.pivot_counts(s, "decade", "label", [0, 1])
    return p.withColumnRenamed("0", "n_label0").withColumnRenamed("1", "n_label1")


_TREND = ["danceability", "energy", "acousticness", "valence"]
@register("agg_a6_feature_means_by_decade_label",
          f"SELECT CAST(floor(year / 10) * 10 AS INTEGER) AS decade, label, "
          + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _TREND) + f" FROM {S} GROUP BY 1, 2")
def agg_a6(spark, sf_dir):
    s = _songs(spark, sf_dir).withColumn("decade", PC.decade("year"))
    return s.groupBy("decade", "label").agg(*[F.round(F.avg(c), 6).alias(c) for c in _TREND])


@register("agg_a7_a8_rates_and_means_by_label",
          f"SELECT label, round(avg(coalesce(CAST(explicit AS INTEGER), 0)) * 100, 6) AS explicit_pct, "
          f"round(avg(duration_ms / 60000.0), 6) AS mean_duration_min FROM {S} GROUP BY label")
def agg_a7_a8(spark, sf_dir):
    s = _songs(spark, sf_dir)
    return s.groupBy("label").agg(F.round(F.avg(PC.is_explicit("explicit")) * 100, 6).alias("explicit_pct"),
                                  F.round(F.avg(PC.minutes("duration_ms")), 6).alias("mean_duration_min"))


_IMP = ", ".join(f"median({c}) AS m_{c}" for c in AUDIO)
@register("agg_a9_year_median_imputation",
          f"WITH s AS {S}, ym AS (SELECT year, {_IMP} FROM s WHERE audio_features_available AND year IS NOT NULL "
          f"GROUP BY year), gm AS (SELECT {_IMP} FROM s WHERE audio_features_available) SELECT s.id, "
          + ", ".join(f"round(CASE WHEN NOT s.audio_features_available THEN (CASE WHEN ym.year IS NOT NULL THEN ym.m_{c} "
                      f"ELSE gm.m_{c} END) ELSE s.{c} END, 6) AS {c}" for c in AUDIO)
          + ", NOT s.audio_features_available AS features_imputed FROM s LEFT JOIN ym ON s.year = ym.year CROSS JOIN gm")
def agg_a9(spark, sf_dir):
    d = group_median_impute(_songs(spark, sf_dir), "year", AUDIO, "audio_features_available")
    return d.select("id", *[r6(c) for c in AUDIO], "features_imputed")


def _welch_sql(c):
    n1, m1, v1 = (f"count({c}) FILTER (WHERE label = 1)", f"avg({c}) FILTER (WHERE label = 1)",
                  f"var_samp({c}) FILTER (WHERE label = 1)")
    n0, m0, v0 = (f"count({c}) FILTER (WHERE label = 0)", f"avg({c}) FILTER (WHERE label = 0)",
                  f"var_samp({c}) FILTER (WHERE label = 0)")
    a, b = f"({v1} / {n1})", f"({v0} / {n0})"
    return (f"SELECT '{c}' AS feature, round({m1}, 6) AS mean_hits, round({m0}, 6) AS mean_non_hits, "
            f"round({m1} - {m0}, 6) AS difference, round(({m1} - {m0}) / sqrt({a} + {b}), 6) AS t, "
            f"round(({a} + {b}) * ({a} + {b}) / ({a} * {a} / ({n1} - 1) + {b} * {b} / ({n0} - 1)), 6) AS dof FROM {S}")


@register("agg_a10_welch_t", _union([_welch_sql(c) for c in FEAT]))
def agg_a10(spark, sf_dir):
    return _round_doubles(ST.welch_moments(_songs(spark, sf_dir), "label", FEAT))


@register("agg_a10_a11_welch_p_values", None)
def agg_a10_p(spark, sf_dir):
    """Welch test with p-values (no SQL twin for the incomplete beta); A11 is the
    ``significant`` column."""
    return ST.welch_test(_songs(spark, sf_dir), "label", FEAT).orderBy("p_value")


def _outlier_sql(c):
    return (f"SELECT '{c}' AS feature, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, "
            f"CAST(sum(CASE WHEN {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) "
            f"AS outliers, round(sum(CASE WHEN {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1) THEN 1 ELSE 0 END) "
            f"* 100.0 / count(*), 6) AS pct_rows FROM {S}, (SELECT quantile_cont({c}, 0.25) AS q1, "
            f"quantile_cont({c}, 0.75) AS q3 FROM {S}) GROUP BY q1, q3")


@register("agg_a12_outliers_3iqr", _union([_outlier_sql(c) for c in FEAT]))
def agg_a12(spark, sf_dir):
    return _round_doubles(ST.outliers_iqr(_songs(spark, sf_dir), FEAT))


_CORR_COLS = FEAT + ["duration_ms"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]


@register("agg_a13_correlation_matrix",
          _union([f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({a}, {b}), 6) AS r FROM {S}" for a, b in _PAIRS]))
def agg_a13(spark, sf_dir):
    return _round_doubles(ST.correlations(_songs(spark, sf_dir), _CORR_COLS))


@register("agg_a14_strong_correlations",
          "SELECT f1, f2, round(r, 6) AS r FROM (" + _union(
              [f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM {S}" for a, b in _PAIRS])
          + ") WHERE abs(r) > 0.7")
def agg_a14(spark, sf_dir):
    return _round_doubles(ST.strong_pairs(ST.correlations(_songs(spark, sf_dir), _CORR_COLS)))


def _hist_sql(x, bins, by, src):
    g = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    w = f"((hi - lo) / CAST({bins} AS DOUBLE))"
    return (f"WITH d AS (SELECT {g}CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL), "
            f"r AS (SELECT {g}min(x) AS mn, max(x) AS mx, count(*) AS n FROM d {'GROUP BY ' + by if by else ''}), "
            "r2 AS (SELECT *, CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END AS lo, "
            "CASE WHEN mx = mn THEN mx + 0.5 ELSE mx END AS hi FROM r), "
            f"b AS (SELECT {g}CAST(least(floor((x - lo) * CAST({bins} AS DOUBLE) / (hi - lo)), {bins - 1}) AS INTEGER) "
            f"AS bin, lo, hi, n FROM d JOIN r2 {on}) "
            f"SELECT {g}bin, count(*) AS count, round(lo + bin * {w}, 6) AS bin_start, "
            f"round(count(*) / (n * {w}), 6) AS density FROM b GROUP BY {g}bin, lo, hi, n")


@register("agg_a15_density_histogram_by_label", _hist_sql("danceability", 40, "label", S))
def agg_a15(spark, sf_dir):
    return _round_doubles(ST.histogram(_songs(spark, sf_dir), "danceability", 40, by=["label"]))


@register("agg_a15_peak_rank_histogram",
          _hist_sql("peak_rank", 50, "", f"(SELECT * FROM {S} WHERE label = 1)"))
def agg_a15b(spark, sf_dir):
    s = _songs(spark, sf_dir).filter(F.col("label") == 1)
    return _round_doubles(ST.histogram(s, "peak_rank", 50))


@register("agg_a15_weeks_histogram",
          _hist_sql("wks_on_chart", 40, "", f"(SELECT * FROM {S} WHERE label = 1)"))
def agg_a15c(spark, sf_dir):
    s = _songs(spark, sf_dir).filter(F.col("label") == 1)
    return _round_doubles(ST.histogram(s, "wks_on_chart", 40))


@register("agg_a15_short_duration_histogram",
          _hist_sql("duration_min", 40, "label", f"(SELECT label, duration_ms / 60000.0 AS duration_min FROM {S} WHERE duration_ms / 60000.0 < 10)"))
def agg_a15d(spark, sf_dir):
    """Durations under ten minutes, by label."""
    s = _songs(spark, sf_dir).withColumn("duration_min", PC.minutes("duration_ms")).filter(F.col("duration_min") < 10)
    return _round_doubles(ST.histogram(s, "duration_min", 40, by=["label"]))


@register("agg_a11_significant_split",
          "SELECT feature, abs(t) > 5 AS significant FROM (" + _union([_welch_sql(c) for c in FEAT]) + ")")
def agg_a11(spark, sf_dir):
    """A11 on p < 1e-6: with these many degrees of freedom that is |t| beyond 4.9 (SQL has no t distribution)."""
    yes, no = ST.split_significant(ST.welch_test(_songs(spark, sf_dir), "label", FEAT, alpha=5.8e-7))
    return yes.select("feature", F.lit(True).alias("significant")).unionByName(no.select("feature", F.lit(False).alias("significant")))


@register("agg_a16_duration_histogram",
          _hist_sql("duration_min", 50, "label", f"(SELECT label, duration_ms / 60000.0 AS duration_min FROM {S})"))
def agg_a16(spark, sf_dir):
    s = _songs(spark, sf_dir).withColumn("duration_min", PC.minutes("duration_ms"))
    return _round_doubles(ST.histogram(s, "duration_min", 50, by=["label"]))


@register("agg_a17_box_plot_numbers",
          f"WITH q AS (SELECT label, quantile_cont(energy, 0.25) AS q1, quantile_cont(energy, 0.5) AS median, "
          f"quantile_cont(energy, 0.75) AS q3 FROM {S} GROUP BY label) "
          "SELECT s.label, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
          "round(min(CASE WHEN energy >= q1 - 1.5 * (q3 - q1) THEN energy END), 6) AS whisker_low, "
          "round(max(CASE WHEN energy <= q3 + 1.5 * (q3 - q1) THEN energy END), 6) AS whisker_high "
          f"FROM {S} s JOIN q ON s.label = q.label GROUP BY s.label, q1, median, q3")
def agg_a17(spark, sf_dir):
    return _round_doubles(ST.box_stats(_songs(spark, sf_dir), "energy", "label"))


@register("agg_a18_rank_buckets",
          "WITH b AS (SELECT * FROM (VALUES ('Top 10', 0), ('11-50', 1), ('51-100', 2)) AS t(bucket, bucket_order)), "
          f"c AS (SELECT CASE WHEN peak_rank > 0 AND peak_rank <= 10 THEN 'Top 10' WHEN peak_rank > 10 AND "
          f"peak_rank <= 50 THEN '11-50' WHEN peak_rank > 50 AND peak_rank <= 100 THEN '51-100' END AS bucket FROM {S} "
          "WHERE label = 1) SELECT b.bucket, b.bucket_order, coalesce(n, 0) AS n FROM b LEFT JOIN "
          "(SELECT bucket, count(*) AS n FROM c WHERE bucket IS NOT NULL GROUP BY bucket) x ON b.bucket = x.bucket")
def agg_a18(spark, sf_dir):
    s = _songs(spark, sf_dir).filter(F.col("label") == 1).withColumn("bucket", PC.rank_bucket("peak_rank"))
    return ST.bucket_counts(s, "bucket", PC.RANK_BUCKETS)


@register("agg_a22_distinct_years", f"SELECT DISTINCT year FROM {S}")
def agg_a22(spark, sf_dir):
    return _songs(spark, sf_dir).select("year").distinct().orderBy("year")


# --- C9: the composed report ------------------------------------------------------

def _unpivot(section: str, sql: str, measures: list[str], feature: str = "''", grp: str = "''") -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, CAST({feature} AS VARCHAR) AS feature, CAST({grp} AS VARCHAR) AS grp, '{m}' AS measure, "
                              f"round(CAST({m} AS DOUBLE), 6) AS value FROM ({sql})" for m in measures)


def _box_sql(c):
    return (f"SELECT s.label, '{c}' AS feature, q1, median, q3, min(CASE WHEN {c} >= q1 - 1.5 * (q3 - q1) THEN {c} END) AS whisker_low, "
            f"max(CASE WHEN {c} <= q3 + 1.5 * (q3 - q1) THEN {c} END) AS whisker_high FROM {S} s JOIN (SELECT label, quantile_cont({c}, 0.25) AS q1, "
            f"quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM {S} GROUP BY label) q ON s.label = q.label GROUP BY s.label, q1, median, q3")


def _report_sql() -> str:
    sql = {n: REGISTRY[n][1] for n in ("agg_a3_summary_statistics", "agg_a10_welch_t", "agg_a12_outliers_3iqr", "agg_a13_correlation_matrix")}
    missing = _union([f"SELECT '{c}' AS feature, sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS missing FROM {S}" for c in FEAT + ["peak_rank", "wks_on_chart", "explicit"]])
    decade = "CAST(floor(year / 10) * 10 AS INTEGER)"
    both = f"concat_ws('/', {decade}, label)"
    parts = [
        _unpivot("balance", f"SELECT label, count(*) AS rows, count(*) / sum(count(*)) OVER () AS share FROM {S} GROUP BY label", ["rows", "share"], grp="label"),
        _unpivot("summary", sql["agg_a3_summary_statistics"], ["count", "mean", "std", "min", "p25", "p50", "p75", "max"], "feature"),
        _unpivot("missing", f"SELECT * FROM ({missing}) WHERE missing > 0", ["missing"], "feature"),
        _unpivot("decades", f"SELECT {both} AS g, count(*) AS rows FROM {S} GROUP BY 1", ["rows"], grp="g"),
        _unpivot("trends", _union([f"SELECT '{c}' AS feature, {both} AS g, avg({c}) AS mean FROM {S} GROUP BY 2" for c in _TREND]), ["mean"], "feature", "g"),
        _unpivot("label_means", f"SELECT 'is_explicit' AS feature, label, avg(coalesce(CAST(explicit AS INTEGER), 0)) AS mean FROM {S} GROUP BY label UNION ALL "
                 f"SELECT 'duration_min', label, avg(duration_ms / 60000.0) FROM {S} GROUP BY label", ["mean"], "feature", "label"),
        _unpivot("welch", sql["agg_a10_welch_t"], ["mean_hits", "mean_non_hits", "difference", "t", "dof"], "feature"),
        _unpivot("outliers", sql["agg_a12_outliers_3iqr"], ["q1", "q3", "iqr", "outliers", "pct_rows"], "feature"),
        *[_unpivot("histograms", _hist_sql(c, 40, "label", S), ["count", "bin_start", "density"], f"'{c}'", "concat_ws('/', label, bin)") for c in FEAT],
        _unpivot("boxes", _union([_box_sql(c) for c in _BOX]), ["q1", "median", "q3", "whisker_low", "whisker_high"], "feature", "label"),
        _unpivot("rank_buckets", f"SELECT bucket, n AS rows FROM ({REGISTRY['agg_a18_rank_buckets'][1]}) WHERE n > 0", ["rows"], grp="bucket"),
        _unpivot("correlations", sql["agg_a13_correlation_matrix"], ["r"], "f1", "f2"),
    ]
    return _union(parts)


_BOX = ["energy", "danceability"]


@register("pipe_c9_eda_report", _report_sql())
def pipe_c9(spark, sf_dir):
    """The report without the two columns that SQL has no function for (Welch p-values)."""
    out = eda_report(_songs(spark, sf_dir), FEAT, _TREND, _BOX)
    return out.where(~F.col("measure").isin("p_value", "significant")).withColumn("value", F.round("value", 6))
