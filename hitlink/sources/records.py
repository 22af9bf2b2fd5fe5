"""Nested records (S11, S12): JSON track objects and feature records parsed
with ``from_json`` against a fixed schema and flattened with column paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("popularity", T.IntegerType()), T.StructField("explicit", T.BooleanType()),
    T.StructField("duration_ms", T.LongType()), T.StructField("disc_number", T.IntegerType()),
    T.StructField("track_number", T.IntegerType()), T.StructField("preview_url", T.StringType()),
    T.StructField("album", T.StructType([
        T.StructField("name", T.StringType()), T.StructField("album_type", T.StringType()),
        T.StructField("release_date", T.StringType()), T.StructField("release_date_precision", T.StringType())])),
    T.StructField("artists", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    T.StructField("external_ids", T.StructType([T.StructField("isrc", T.StringType())])),
    T.StructField("external_urls", T.StructType([T.StructField("spotify", T.StringType())]))])

FEATURE_KEYS = ["danceability", "energy", "key", "loudness", "mode", "speechiness", "acousticness",
                "instrumentalness", "liveness", "valence", "tempo", "time_signature"]


def flatten_track(json_col: str | Column, label: int | None = None) -> list[Column]:
    """Track JSON -> flat columns; artist names joined by ", "."""
    t = F.from_json(json_col, TRACK)
    cols = [t["id"].alias("spotify_id"), t["name"].alias("spotify_title"),
            F.array_join(F.transform(t["artists"], lambda a: a["name"]), ", ").alias("spotify_artist"),
            t["album"]["name"].alias("spotify_album"), t["album"]["album_type"].alias("album_type"),
            t["album"]["release_date"].alias("release_date"),
            t["album"]["release_date_precision"].alias("release_date_precision"),
            t["popularity"].alias("popularity"), t["explicit"].alias("explicit"),
            t["duration_ms"].alias("duration_ms"), t["disc_number"].alias("disc_number"),
            t["track_number"].alias("track_number"), t["external_ids"]["isrc"].alias("isrc"),
            t["external_urls"]["spotify"].alias("spotify_url"), t["preview_url"].alias("preview_url")]
    if label is not None:
        cols.append(F.lit(label).alias("label"))
    return cols


def feature_record(json_col: str | Column, keys=FEATURE_KEYS) -> list[Column]:
    """The feature keys as doubles, all NULL when the record is missing, plus
    ``audio_features_available``."""
    schema = T.StructType([T.StructField(k, T.DoubleType()) for k in keys] + [T.StructField("id", T.StringType())])
    r = F.from_json(json_col, schema)
    present = r.isNotNull() & r["id"].isNotNull()
    return [F.when(present, r[k]).alias(k) for k in keys] + [present.alias("audio_features_available")]
