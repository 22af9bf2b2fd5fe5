"""The registered query set: one Spark plan per operator of the inventory, each
with its DuckDB oracle SQL (or none, for model fits and other non-SQL work).

Every query reads the driver's tables (through ``fixtures``) in full; none uses
id subsets, modulo filters or row caps to stay cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as FX
from . import oracle_sql as OS
from .pipelines import expanded_dataset, dataset_profile
from .registry import REGISTRY, r6, register  # noqa: F401


AUDIO = FX.AUDIO_COLS
_DS_COLS = ["label", "year", "title", "artist", "peak_rank", "peak_pos", "wks_on_chart", "spotify_id",
            "popularity", "explicit", "duration_ms", "release_date"]
_DS_TAIL = ["audio_features_available", "features_imputed", "match_pass"]


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded_dataset(FX.catalog(spark, sf_dir), FX.weekly_chart(spark, sf_dir))


# --- pipelines ---------------------------------------------------------------

@register("pipe_c4_expanded_dataset",
          f"WITH {OS.expanded_ctes()} SELECT {', '.join(_DS_COLS)}, "
          + ", ".join(f"round({c}, 6) AS {c}" for c in AUDIO)
          + f", {', '.join(_DS_TAIL)} FROM ds")
def pipe_c4(spark, sf_dir):
    ds = expanded(spark, sf_dir)
    return ds.select(*_DS_COLS, *[r6(c) for c in AUDIO], *_DS_TAIL)


@register("agg_a19_dataset_profile",
          f"WITH {OS.expanded_ctes()} SELECT count(*) AS total, "
          "CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives, "
          "CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives, "
          "round(avg(CASE WHEN label = 1 THEN 100.0 ELSE 0.0 END), 6) AS pct_positive, "
          "min(year) AS year_min, max(year) AS year_max, "
          "CAST(sum(CASE WHEN NOT features_imputed THEN 1 ELSE 0 END) AS BIGINT) AS real_features, "
          "CAST(sum(CASE WHEN features_imputed THEN 1 ELSE 0 END) AS BIGINT) AS imputed_features FROM ds")
def agg_a19(spark, sf_dir):
    return dataset_profile(expanded(spark, sf_dir))


@register("agg_a20_linkage_report",
          f"WITH {OS.catalog_ctes()},{OS.chart_ctes()},{OS.linked_cte()} "
          "SELECT match_pass, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct "
          "FROM linked GROUP BY match_pass")
def agg_a20(spark, sf_dir):
    from .pipelines import link_hits, prepare_catalog, prepare_chart
    linked = link_hits(prepare_chart(FX.weekly_chart(spark, sf_dir)), prepare_catalog(FX.catalog(spark, sf_dir)))
    counts = linked.groupBy("match_pass").agg(F.count(F.lit(1)).alias("n"))
    total = linked.select(F.count(F.lit(1))).scalar()
    return counts.select("match_pass", "n", F.round(F.col("n") * 100.0 / total, 6).alias("pct"))


# Query families live in their own modules; importing them registers them.
from . import q_text  # noqa: E402,F401
from . import q_rows  # noqa: E402,F401
from . import q_link  # noqa: E402,F401
from . import q_stats  # noqa: E402,F401
from . import q_rank  # noqa: E402,F401
from . import q_ml  # noqa: E402,F401
from . import q_src  # noqa: E402,F401
from . import q_csv  # noqa: E402,F401
