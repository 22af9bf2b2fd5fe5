"""Composite pipelines (C1-C11), each a function DataFrame(s) -> DataFrame.

The flagship is ``expanded_dataset`` (C4): prepare the catalog and the weekly
chart, link hits to the catalog in two passes, draw as many non-hits as hits
from the catalog rows that match no hit key, and fill the missing audio
features with per-year medians. It is one lazy plan: two scans, two dedup
aggregates (partial on the map side), two lookup joins, one anti-join, a
bucketed exact-n sample and one median aggregate joined back by year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as PC
from ..functions import text as TX
from ..operators import dedup as U
from ..operators import linkage as L
from ..operators.impute import group_median_impute
from ..operators.sampling import exact_sample
from ..session import materialize
from .fixtures import AUDIO_COLS

TRACK_PAYLOAD = ["spotify_id", "popularity", "explicit", "duration_ms", "release_date"] + AUDIO_COLS


# --- C1: year-end chart ------------------------------------------------------

CHART_INPUT_ORDER = ("src_order", "src_line", "partkey", "src_supp")


def clean_chart(raw: DataFrame, order=CHART_INPUT_ORDER, reference: bool = False) -> DataFrame:
    """Names, numeric year/rank, stripped text, cleaned title and credit, lead
    artist; rows whose cleaned title or credit is empty are dropped; exact
    duplicates on (year, rank, title_clean, artist_clean) keep the first row in
    ``order`` (input order)."""
    d = PC.standardise_names(raw)
    d = (d.withColumn("year", PC.to_int("year")).withColumn("rank", PC.to_int("rank"))
          .withColumn("title", TX.strip(F.col("title").cast("string")))
          .withColumn("artist", TX.strip(F.col("artist").cast("string"))))
    d = (d.withColumn("title_clean", TX.clean_title_v1("title", reference=reference))
          .withColumn("artist_clean", TX.clean_artist("artist"))
          .withColumn("primary_artist", TX.lead_artist("artist_clean", reference=reference)))
    best = U.keep_best(d, ["year", "rank", "title_clean", "artist_clean"], [U.asc(c) for c in order])
    # Dropping empty rows after the dedup gives the same rows (an empty key's
    # group holds only empty rows) and keeps the filter above the aggregate:
    # before it, Catalyst would push it under the projection and evaluate the
    # cleaning expressions twice.
    return best.filter((F.length("title_clean") > 0) & (F.length("artist_clean") > 0))


# --- C2: catalog -------------------------------------------------------------

def prepare_catalog(raw: DataFrame, reference: bool = False) -> DataFrame:
    """Rename, lead artist from the stringified list, numeric year, keys,
    then the most popular row per (title key, artist key)."""
    cat = (raw.withColumnRenamed("id", "spotify_id").withColumnRenamed("name", "title")
              .withColumn("primary_artist", TX.first_list_item("artists"))
              .withColumn("year", PC.to_int("year"))
              .withColumn("nt", TX.norm("title", role="title", reference=reference))
              .withColumn("ntb", TX.norm_base("title", role="title", reference=reference))
              .withColumn("na", TX.norm("primary_artist", role="artist", reference=reference)))
    return U.keep_best(cat, ["nt", "na"], [U.desc("popularity"), U.asc("spotify_id")],
                       isolate_empty=not reference)


def base_lookup(catalog: DataFrame) -> DataFrame:
    """The catalog's most popular row per (base title key, artist key)."""
    return L.unique_lookup(catalog, ["ntb", "na"], [U.desc("popularity"), U.asc("spotify_id")])


def catalog_by_id(catalog: DataFrame) -> DataFrame:
    """One catalog row per id; on a repeated id the last row in
    popularity-descending order wins (missing popularity sorts last there)."""
    return L.unique_lookup(catalog, ["spotify_id"],
                           [U.asc("popularity", nulls_last=False), U.asc("nt"), U.asc("na")])


def enrich_three_pass(df: DataFrame, catalog: DataFrame, features=tuple(AUDIO_COLS),
                      flag: str = "audio_features_available") -> DataFrame:
    """Rows already flagged are left alone; the others are looked up by id,
    then by exact key, then by base key (title falls back to ``title`` when
    ``spotify_title`` is missing, D7) and take the matched row's features."""
    features = [c for c in features]
    done = df.filter(F.col(flag)).withColumn("match_pass", F.lit("already"))
    todo = df.filter(~F.coalesce(F.col(flag), F.lit(False)))
    title = F.coalesce(F.col("spotify_title"), F.col("title"))
    artist = F.coalesce(F.col("primary_artist"), F.col("artist"))
    keyed = (todo.withColumn("_kt", TX.norm(title, role="title"))
                 .withColumn("_ktb", TX.norm_base(title, role="title"))
                 .withColumn("_ka", TX.norm(artist, role="artist")))
    linked = L.link(keyed, [L.Pass("id", catalog_by_id(catalog), ["spotify_id"], ["spotify_id"]),
                            L.Pass("exact", catalog, ["_kt", "_ka"], ["nt", "na"]),
                            L.Pass("base", base_lookup(catalog), ["_ktb", "_ka"], ["ntb", "na"])],
                    payload=features, prefix="_new_")
    hit = F.col("match_pass") != "none"
    filled = linked.withColumns({c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in features
                                 if c in df.columns})
    filled = filled.withColumn(flag, hit)
    return done.unionByName(filled.select(*df.columns, "match_pass"))


# --- C3: weekly chart ---------------------------------------------------------

def prepare_chart(raw: DataFrame, reference: bool = False) -> DataFrame:
    """Chart year, best-peak row per (title, performer), keys.

    ``peak_rank`` is the weekly position of the kept row (the reference's name for
    it); ``peak_pos`` is kept alongside, as it is the true peak (D3).
    """
    d = raw.withColumn("year", PC.year_of("chart_week"))
    d = U.keep_best(d, ["title", "performer"],
                    [U.asc("peak_pos"), U.asc("chart_week"), U.asc("entry_order"), U.asc("entry_line"),
                     U.asc("entry_part"), U.asc("entry_supp")])
    d = d.withColumnRenamed("current_week", "peak_rank").withColumnRenamed("performer", "artist")
    return (d.withColumn("nt", TX.norm("title", role="title", reference=reference))
             .withColumn("ntb", TX.norm_base("title", role="title", reference=reference))
             .withColumn("na", TX.norm("artist", role="artist", reference=reference)))


# --- C4: expanded labelled dataset --------------------------------------------

def link_hits(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Exact key, else base key, else unmatched; adds the catalog payload."""
    return L.link(hits, [L.Pass("exact", catalog, ["nt", "na"], ["nt", "na"]),
                         L.Pass("base", base_lookup(catalog), ["ntb", "na"], ["ntb", "na"])],
                  payload=TRACK_PAYLOAD)


def non_hits(catalog: DataFrame, hits: DataFrame, use_base: bool = True) -> DataFrame:
    """Catalog rows whose key matches no hit's exact or base key. With
    ``use_base`` (default) the catalog row's base key is tested too, so a remix of
    a hit is not a non-hit (D4)."""
    keys = L.key_union((hits, ["nt", "na"]), (hits, ["ntb", "na"]), names=["k1", "k2"])
    out = L.anti_join(catalog, keys, ["nt", "na"], ["k1", "k2"])
    if use_base:
        out = L.anti_join(out, keys, ["ntb", "na"], ["k1", "k2"])
    return out


def expanded_dataset(catalog_raw: DataFrame, chart_raw: DataFrame, seed: int = 42,
                     reference: bool = False) -> DataFrame:
    """C4: positives (linked hits) + as many sampled non-hits, year-median imputed."""
    # The prepared catalog and hits are each read three or four times below.
    catalog = materialize(prepare_catalog(catalog_raw, reference=reference), "catalog")
    hits = materialize(prepare_chart(chart_raw, reference=reference), "hits")
    linked = link_hits(hits, catalog)
    positives = linked.select(
        F.lit(1).alias("label"), "year", "title", "artist", "peak_rank", "peak_pos", "wks_on_chart",
        *TRACK_PAYLOAD, (F.col("match_pass") != "none").alias("audio_features_available"), "match_pass")
    n_hits = hits.count()
    sampled = exact_sample(non_hits(catalog, hits, use_base=not reference), n_hits,
                           key="spotify_id", seed=seed)
    negatives = sampled.select(
        F.lit(0).alias("label"), "year", "title", F.col("primary_artist").alias("artist"),
        F.lit(None).cast("int").alias("peak_rank"), F.lit(None).cast("int").alias("peak_pos"),
        F.lit(None).cast("int").alias("wks_on_chart"), *TRACK_PAYLOAD,
        F.lit(True).alias("audio_features_available"), F.lit(None).cast("string").alias("match_pass"))
    # Read twice by the imputation (medians, then the fill).
    both = materialize(positives.unionByName(negatives), "labelled")
    return group_median_impute(both, "year", AUDIO_COLS, "audio_features_available")


def dataset_profile(ds: DataFrame) -> DataFrame:
    """Totals, per-label counts and shares, year range, real/imputed counts
    (real = not imputed, D6)."""
    n = F.count(F.lit(1))
    return ds.agg(
        n.alias("total"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("positives"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("negatives"),
        F.round(F.avg(F.when(F.col("label") == 1, 100.0).otherwise(0.0)), 6).alias("pct_positive"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        F.sum(F.when(~F.col("features_imputed"), 1).otherwise(0)).cast("long").alias("real_features"),
        F.sum(F.when(F.col("features_imputed"), 1).otherwise(0)).cast("long").alias("imputed_features"),
    )
