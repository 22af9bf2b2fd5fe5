"""The whole exploratory report from two scans of the songs.

Scan one counts (decade, label, feature, value); every univariate table of the report (A1-A8, A10-A12, A15-A18) is
arithmetic on these counts. Scan two is the co-moment matrix of the correlations (A13, A14). The report is long: one row
for each number as (section, feature, grp, measure, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as PC
from ..operators import stats as ST
from ..operators.ordered import quantiles_of_counts, value_counts_long
from ..session import materialize

ROWS = "_rows"  # a feature that is 1 in every row: its counts are row counts


def _long(df: DataFrame, section: str, measures: Sequence[str], feature: Column | None = None, grp: Column | None = None) -> DataFrame:
    of = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    return df.select(F.lit(section).alias("section"), (F.lit("") if feature is None else feature).cast("string").alias("feature"),
                     (F.lit("") if grp is None else grp).cast("string").alias("grp"), F.explode(of).alias("_m")).select("section", "feature", "grp", "_m.*")


def _means(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))


def welch_of_counts(by_label: DataFrame, label: str = "label") -> DataFrame:
    """A10 from (label, feature, value, n): class means, difference, t and degrees of freedom of each feature."""
    means = _means(by_label, [label, "feature"])
    square = (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")) * F.col("n")
    both = by_label.join(means.withColumnRenamed("n", "total"), [label, "feature"])
    var = both.groupBy("feature", label, "total", "mean").agg((F.sum(square) / (F.col("total") - 1)).alias("var"))
    pick = lambda c, k: F.max(F.when(F.col(label) == k, F.col(c)))
    g = var.groupBy("feature").agg(*[pick(c, k).alias(f"{c}{k}") for c in ("total", "mean", "var") for k in (1, 0)])
    a, b = F.col("var1") / F.col("total1"), F.col("var0") / F.col("total0")
    return g.select("feature", F.col("mean1").alias("mean_hits"), F.col("mean0").alias("mean_non_hits"), (F.col("mean1") - F.col("mean0")).alias("difference"),
                    ((F.col("mean1") - F.col("mean0")) / F.sqrt(a + b)).alias("t"),
                    ((a + b) * (a + b) / (a * a / (F.col("total1") - 1) + b * b / (F.col("total0") - 1))).alias("dof"))


def histogram_of_counts(counts: DataFrame, bins: int, by: Sequence[str]) -> DataFrame:
    """A15 for all features at once: equal-width bins over each group's own range, the last bin closed."""
    rng = counts.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total"))
    flat = F.col("hi") == F.col("lo")
    rng = rng.select(*by, "total", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = F.least(F.floor((F.col("value") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    out = counts.join(rng, list(by)).groupBy(*by, place.alias("bin"), "lo", "hi", "total").agg(F.sum("n").alias("count"))
    return out.select(*by, "bin", "count", (F.col("lo") + F.col("bin") * width).alias("bin_start"), (F.col("count") / (F.col("total") * width)).alias("density"))


def eda_report(songs: DataFrame, features: Sequence[str], trend: Sequence[str], box: Sequence[str], bins: int = 40) -> DataFrame:
    """The report over songs with label, year, duration_ms, explicit, peak_rank, wks_on_chart and audio features."""
    features = list(features)
    d = songs.select("label", PC.decade("year").alias("decade"), *features, "peak_rank", "wks_on_chart", F.col("explicit").cast("double").alias("explicit"),
                     PC.is_explicit("explicit").alias("is_explicit"), PC.minutes("duration_ms").alias("duration_min"), F.lit(1.0).alias(ROWS))
    columns = [*features, "peak_rank", "wks_on_chart", "explicit", "is_explicit", "duration_min", ROWS]
    cells = materialize(value_counts_long(d, columns, ["decade", "label"]), "report_cells")
    by_label = materialize(cells.groupBy("label", "feature", "value").agg(F.sum("n").alias("n")), "report_by_label")
    overall = materialize(by_label.groupBy("feature", "value").agg(F.sum("n").alias("n")), "report_overall")
    of = lambda df, names: df.where(F.col("feature").isin(list(names)))
    rows = overall.where(F.col("feature") == ROWS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    label, eda = F.col("label"), of(by_label, features)

    parts = [
        _long(of(by_label, [ROWS]).groupBy("label").agg(F.sum("n").alias("rows"), (F.sum("n") / F.lit(rows)).alias("share")), "balance", ["rows", "share"], grp=label),
        _long(ST.summary_of_counts(of(overall, features), features), "summary", ["count", "mean", "std", "min", "p25", "p50", "p75", "max"], F.col("feature")),
        _long(_missing(overall, rows, [*features, "peak_rank", "wks_on_chart", "explicit"]), "missing", ["missing"], F.col("feature")),
        _long(of(cells, [ROWS]).groupBy("decade", "label").agg(F.sum("n").alias("rows")), "decades", ["rows"], grp=F.concat_ws("/", "decade", "label")),
        _long(_means(of(cells, trend), ["decade", "label", "feature"]), "trends", ["mean"], F.col("feature"), F.concat_ws("/", "decade", "label")),
        _long(_means(of(by_label, ["is_explicit", "duration_min"]), ["label", "feature"]), "label_means", ["mean"], F.col("feature"), label),
        _long(ST.with_p_values(welch_of_counts(eda)), "welch", ["mean_hits", "mean_non_hits", "difference", "t", "dof", "p_value", "significant"], F.col("feature")),
        _long(ST.outliers_of_counts(of(overall, features), features, rows), "outliers", ["q1", "q3", "iqr", "outliers", "pct_rows"], F.col("feature")),
        _long(histogram_of_counts(eda, bins, ["feature", "label"]), "histograms", ["count", "bin_start", "density"], F.col("feature"), F.concat_ws("/", "label", "bin")),
        _long(_boxes(of(by_label, box)), "boxes", ["q1", "median", "q3", "whisker_low", "whisker_high"], F.col("feature"), label),
        _long(of(by_label, ["peak_rank"]).where(label == 1).groupBy(PC.rank_bucket("value").alias("bucket")).agg(F.sum("n").alias("rows")).where("bucket IS NOT NULL"),
              "rank_buckets", ["rows"], grp=F.col("bucket")),
        _long(ST.correlations(songs, [*features, "duration_ms"]), "correlations", ["r"], F.col("f1"), F.col("f2")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _missing(overall: DataFrame, rows: int, names: Sequence[str]) -> DataFrame:
    have = overall.groupBy("feature").agg(F.sum("n").alias("n"))
    of = overall.sparkSession.createDataFrame([(c,) for c in names], "feature string")
    return of.join(have, "feature", "left").select("feature", (F.lit(rows) - F.coalesce("n", F.lit(0))).alias("missing")).where("missing > 0")


def _boxes(by_label: DataFrame, whisker: float = 1.5) -> DataFrame:
    q = quantiles_of_counts(by_label, [0.25, 0.5, 0.75], ["label"])
    q = q.select(F.col("label").alias("_l"), F.col("feature").alias("_f"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr, x = F.col("q3") - F.col("q1"), F.col("value")
    return (by_label.join(q, F.col("label").eqNullSafe(F.col("_l")) & (F.col("feature") == F.col("_f"))).groupBy("label", "feature", "q1", "median", "q3")
            .agg(F.min(F.when(x >= F.col("q1") - whisker * iqr, x)).alias("whisker_low"), F.max(F.when(x <= F.col("q3") + whisker * iqr, x)).alias("whisker_high")))
