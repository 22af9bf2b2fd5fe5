"""CSV in and out (S1-S6, S10, S13) and casts (P13, P19): a table is written as CSV under the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as PC
from ..sources import io as IO
from ..session import checkpoint_dir
from . import fixtures as FX
from .registry import register

_CHART = FX.sql_weekly_chart()
_YE = FX.sql_yearend_chart()
_CHART_COLS = "chart_week, current_week, title, performer, peak_pos, wks_on_chart"


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"


@register("src_s1_s5_csv_round_trip", f"SELECT {_CHART_COLS} FROM {_CHART}")
def src_s1(spark, sf_dir):
    """S5 then S1: the weekly chart written and read with its fixed schema."""
    path = _folder(spark)
    IO.write_table(FX.weekly_chart(spark, sf_dir).select(*_CHART_COLS.split(", ")), path, "csv")
    return IO.read_csv(spark, path, IO.WEEKLY_CHART)


@register("src_s2_all_string_csv", "SELECT CAST(year AS VARCHAR) AS year, CAST(rank AS VARCHAR) AS rank, title, artist "
          f"FROM {_YE}")
def src_s2(spark, sf_dir):
    """Every column as text; titles with quotes, doubled quotes and pipes come back as they were."""
    path = _folder(spark)
    IO.write_table(FX.yearend_chart(spark, sf_dir).select("year", "rank", "title", "artist"), path, "csv")
    return IO.read_csv(spark, path, IO.all_strings(IO.YEAR_END_RAW))


@register("src_s3_p13_typed_casts",
          "SELECT TRY_CAST(o_orderpriority[1:1] AS INT) AS priority, TRY_CAST(o_orderstatus AS INT) AS status, "
          "TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS price, o_orderkey AS id FROM orders")
def src_s3(spark, sf_dir):
    """A lazy scan with casts; text that is no number becomes NULL."""
    o = FX.table(spark, sf_dir, "orders")
    return o.select(F.substring("o_orderpriority", 1, 1).try_cast("int").alias("priority"), F.col("o_orderstatus").try_cast("int").alias("status"),
                    F.col("o_totalprice").cast("string").try_cast("double").alias("price"), F.col("o_orderkey").alias("id"))


@register("src_s4_optional_source", f"SELECT {_CHART_COLS} FROM {_CHART}")
def src_s4(spark, sf_dir):
    """One source that exists and one that does not."""
    path = _folder(spark)
    IO.write_table(FX.weekly_chart(spark, sf_dir).select(*_CHART_COLS.split(", ")), path)
    return IO.read_optional(spark, path, IO.WEEKLY_CHART).unionByName(IO.read_optional(spark, f"{path}-missing", IO.WEEKLY_CHART))


@register("src_s6_versioned_enrichment", f"SELECT year, rank, title, CAST(floor(year / 10) * 10 AS INT) AS decade FROM {_YE}")
def src_s6(spark, sf_dir):
    """Version 1 is read and version 2, with a further column, written next to it."""
    base = _folder(spark)
    IO.write_table(FX.yearend_chart(spark, sf_dir).select("year", "rank", "title"), IO.next_version(base, 0))
    first = spark.read.parquet(IO.next_version(base, 0))
    IO.write_table(first.withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int")), IO.next_version(base, 1))
    return spark.read.parquet(IO.next_version(base, 1))


@register("src_s10_exact_headers", f"SELECT title, artist, year, rank, src_line AS line FROM {_YE}")
def src_s10(spark, sf_dir):
    """Whole header names in any case stand for the columns."""
    raw = FX.yearend_chart(spark, sf_dir).select(F.col("title").alias(" Song_Title"), F.col("artist").alias("Artist_Name"),
                                                 F.col("year").alias("Year"), F.col("rank").alias("RANK"), F.col("src_line").alias("line"))
    return IO.rename_exact(raw).select("title", "artist", "year", "rank", "line")


@register("src_s13_year_files", f"SELECT year, rank, title, artist FROM {_YE}")
def src_s13(spark, sf_dir):
    """One CSV folder per year, read together."""
    path = _folder(spark)
    chart = FX.yearend_chart(spark, sf_dir).select("year", "rank", "title", "artist")
    IO.write_table(chart.withColumn("file_year", F.col("year")), path, "csv", partition_by=["file_year"])
    years = [r.year for r in chart.select("year").distinct().orderBy("year").collect()]
    frames = [IO.read_csv(spark, f"{path}/file_year={y}", IO.YEAR_END_RAW) for y in years]
    return IO.union_years(frames).select(F.col("year").cast("int").alias("year"), F.col("rank").cast("int").alias("rank"), "title", "artist")


@register("proj_p19_half_even_rounding",
          "SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(CAST(l_quantity AS INT) AS DECIMAL(12,4)) / 8, 2) AS DOUBLE) AS eighths "
          "FROM lineitem")
def proj_p19(spark, sf_dir):
    """Halves go to the even neighbour."""
    x = F.col("l_quantity").cast("int").cast("decimal(12,4)") / F.lit(8).cast("decimal(2,0)")
    return FX.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", PC.round_half_even(x.cast("decimal(16,6)"), 2).cast("double").alias("eighths"))
