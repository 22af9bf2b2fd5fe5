"""Readers and writers (S1-S6, S10, S13) with explicit schemas.

CSV is read with a fixed schema (no inference) and ``escape='"'`` so doubled
quotes inside quoted fields decode (without it a title stored with doubled
quote characters keeps three quotes on each side).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIO = ["danceability", "energy", "key", "loudness", "mode", "speechiness", "acousticness",
         "instrumentalness", "liveness", "valence", "tempo"]

WEEKLY_CHART = T.StructType([
    T.StructField("chart_week", T.StringType()), T.StructField("current_week", T.IntegerType()),
    T.StructField("title", T.StringType()), T.StructField("performer", T.StringType()),
    T.StructField("peak_pos", T.IntegerType()), T.StructField("wks_on_chart", T.IntegerType())])

CATALOG = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("artists", T.StringType()), T.StructField("year", T.StringType()),
    T.StructField("popularity", T.IntegerType()), T.StructField("explicit", T.IntegerType()),
    T.StructField("duration_ms", T.LongType()), T.StructField("release_date", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in AUDIO])

YEAR_END_RAW = T.StructType([
    T.StructField("year", T.StringType()), T.StructField("rank", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("artist", T.StringType())])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Header CSV with a fixed schema; several paths read as one frame."""
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("mode", "PERMISSIVE").csv(path if isinstance(path, str) else list(path)))


def all_strings(schema: T.StructType) -> T.StructType:
    """The same columns, every one as text."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def read_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A missing path gives an empty frame; any other read error fails."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else reader.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> bool:
    """Overwrite through the commit protocol (tasks write to a temporary
    location, the job commit publishes), so readers never see half a table. A
    frame without rows writes nothing, so it does not replace an earlier good
    output; the result says whether a table was written."""
    if df.isEmpty():
        return False
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)
    return True


def next_version(base: str, version: int) -> str:
    """In-place enrichment writes version n+1 next to version n (a path being
    read cannot be overwritten)."""
    return f"{base.rstrip('/')}/v{version + 1}"


# Header names (in lower case, stripped) and the columns they stand for.
EXACT_HEADER_ALIASES = {"title": "title", "song": "title", "song_title": "title", "single": "title",
                        "title_clean": "title_clean", "artist": "artist", "artist_name": "artist",
                        "primary_artist": "primary_artist", "year": "year", "rank": "rank"}


def rename_exact(df: DataFrame, aliases: dict | None = None) -> DataFrame:
    """Rename columns whose whole (lowercased, stripped) name is an alias."""
    aliases = aliases or EXACT_HEADER_ALIASES
    m = {c: aliases[c.strip().lower()] for c in df.columns
         if c.strip().lower() in aliases and aliases[c.strip().lower()] not in df.columns}
    return df.withColumnsRenamed(m) if m else df


def union_years(frames: Sequence[DataFrame]) -> DataFrame:
    """Combine per-year frames; fails when there is none."""
    if not frames:
        raise ValueError("no per-year frames to combine")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
