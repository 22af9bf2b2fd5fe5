"""Source (S7, S11, S12), incremental (I1-I4) and merge (C5) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as PC
from ..functions import text as TX
from ..operators import dedup as U
from ..operators import linkage as L
from ..operators import setops as O
from ..sources import html_tables as HT
from ..session import materialize
from ..sources import records as RC
from ..streaming import incremental as INC
from . import cascade as CS
from . import fixtures as FX
from . import oracle_text as OT
from .pipelines import CHART_INPUT_ORDER, clean_chart
from .q_link import _c1, _sql_pool
from .q_rows import sql_c1
from .registry import r6, register

_CAT = FX.sql_catalog()
_YE = FX.sql_yearend_chart()


# --- S7: HTML tables -------------------------------------------------------------

@register("src_s7_page_table_counts",
          "SELECT page_id, CAST(len(regexp_extract_all(lower(html), '<table[\\s>]')) AS BIGINT) AS n_tables, "
          "CAST(0 AS BIGINT) AS n_chart_rows FROM pages")
def src_s7_counts(spark, sf_dir):
    """Tables found per page, and chart rows extracted (the stored pages carry no
    ``<table>``: every page takes the zero-table branch)."""
    pages = FX.table(spark, sf_dir, "pages")
    tables = materialize(HT.page_table_rows(pages), "page_tables")
    n_tables = tables.groupBy("page_id").agg(F.countDistinct("table_no").alias("n_tables"))
    chart = HT.chart_rows(pages, tables=tables).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_chart_rows"))
    return (pages.select("page_id").join(n_tables, "page_id", "left").join(chart, "page_id", "left")
                 .select("page_id", F.coalesce("n_tables", F.lit(0)).cast("long").alias("n_tables"),
                         F.coalesce("n_chart_rows", F.lit(0)).cast("long").alias("n_chart_rows")))


@register("src_s7_s9_chart_rows", None)
def src_s7_rows(spark, sf_dir):
    return HT.chart_rows(FX.table(spark, sf_dir, "pages"))


@register("src_s7_s9_generated_chart_rows",
          f"WITH {FX.sql_chart_page_rows()} SELECT page_id, row_no, rank, title, artist, year FROM chart")
def src_s9_generated(spark, sf_dir):
    """Chart rows of pages with decoy tables, spans, nesting and several header wordings (S8), with the page's year."""
    pages = materialize(FX.chart_pages(spark, sf_dir), "chart_pages")
    return HT.chart_rows(pages, year_col="year").select("page_id", "row_no", "rank", "title", "artist", "year")


@register("src_s7_generated_table_counts",
          f"WITH {FX.sql_chart_page_rows()}, s AS (SELECT page_id, max(n) AS n FROM p GROUP BY page_id), "
          "r AS (SELECT page_id, count(*) AS n_chart_rows FROM chart GROUP BY page_id) SELECT s.page_id, "
          "CAST(2 + CASE WHEN s.page_id % 4 = 2 THEN 1 ELSE 0 END + CASE WHEN s.page_id % 5 = 1 AND n >= 2 THEN 1 ELSE 0 END AS BIGINT) AS n_tables, "
          "n + 1 + CASE WHEN s.page_id % 5 = 1 AND n >= 2 THEN 1 ELSE 0 END + CASE WHEN s.page_id % 4 = 2 THEN 61 ELSE 0 END + 1 AS n_rows, "
          "coalesce(r.n_chart_rows, 0) AS n_chart_rows FROM s LEFT JOIN r ON s.page_id = r.page_id")
def src_s7_generated(spark, sf_dir):
    """Tables and rows found on each generated page, and how many chart rows came of it."""
    pages = FX.chart_pages(spark, sf_dir)
    tables = materialize(HT.page_table_rows(pages), "page_tables")
    found = tables.groupBy("page_id").agg(F.countDistinct("table_no").alias("n_tables"), F.sum("n_rows").alias("n_rows"))
    chart = HT.chart_rows(pages, tables=tables).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_chart_rows"))
    return found.join(chart, "page_id", "left").select("page_id", "n_tables", "n_rows", F.coalesce("n_chart_rows", F.lit(0)).alias("n_chart_rows"))


# --- S11, S12: nested records ----------------------------------------------------

def _track_json(c):
    names = TX.list_items("artists")
    precision = (F.when(F.length("release_date") == 4, "year").when(F.length("release_date") == 7, "month")
                  .otherwise("day"))
    return F.to_json(F.struct(
        F.col("id"), F.col("name"), F.col("popularity"), F.col("explicit"), F.col("duration_ms"),
        F.lit(1).alias("disc_number"), (F.substring("id", 2, 9).cast("int") % 12 + 1).alias("track_number"),
        F.struct(F.concat(F.col("name"), F.lit(" (album)")).alias("name"), F.lit("album").alias("album_type"),
                 F.col("release_date").alias("release_date"), precision.alias("release_date_precision")).alias("album"),
        F.transform(names, lambda x: F.struct(x.alias("name"))).alias("artists"),
        F.struct(F.concat(F.lit("US"), F.col("id")).alias("isrc")).alias("external_ids"),
        F.struct(F.concat(F.lit("https://tracks.example/"), F.col("id")).alias("spotify")).alias("external_urls")))


@register("src_s11_flatten_tracks",
          f"SELECT id AS spotify_id, name AS spotify_title, array_to_string({OT.list_items('artists')}, ', ') "
          "AS spotify_artist, name || ' (album)' AS spotify_album, 'album' AS album_type, release_date, "
          "CASE WHEN length(release_date) = 4 THEN 'year' WHEN length(release_date) = 7 THEN 'month' ELSE 'day' END "
          "AS release_date_precision, popularity, explicit, duration_ms, 1 AS disc_number, "
          "CAST(substring(id, 2, 9) AS INTEGER) % 12 + 1 AS track_number, 'US' || id AS isrc, "
          f"'https://tracks.example/' || id AS spotify_url, CAST(NULL AS VARCHAR) AS preview_url, 1 AS label FROM {_CAT}")
def src_s11(spark, sf_dir):
    j = FX.catalog(spark, sf_dir).select(_track_json(None).alias("track"))
    return j.select(*RC.flatten_track("track", label=1))


_FEAT_JSON_KEYS = RC.FEATURE_KEYS


@register("src_s12_feature_records",
          "SELECT id, " + ", ".join(
              f"CASE WHEN popularity IS NOT NULL THEN {'CAST(NULL AS DOUBLE)' if c == 'time_signature' else c} END AS {c}"
              for c in _FEAT_JSON_KEYS) + f", popularity IS NOT NULL AS audio_features_available FROM {_CAT}")
def src_s12(spark, sf_dir):
    c = FX.catalog(spark, sf_dir)
    rec = F.when(F.col("popularity").isNotNull(),
                 F.to_json(F.struct(F.col("id"), *[F.col(k) for k in FX.AUDIO_COLS])))
    return c.select("id", *RC.feature_record(rec))


# --- I1-I4: incremental runs --------------------------------------------------------

def _key_cols(df):
    k = TX.identity_key("year", "rank", "title_clean", "title", "primary_artist", "artist")
    return df.withColumn("_k", k).select("*", "_k.*").drop("_k")


_SQL_KEYED = ("(SELECT *, " + OT.canonical_number_text("year") + " AS k_year, " + OT.canonical_number_text("rank")
              + " AS k_rank, lower(" + OT.strip("coalesce(title_clean, title)") + ") AS k_title, lower("
              + OT.strip("coalesce(primary_artist, artist)") + f") AS k_artist FROM {sql_c1()})")
_KEYS = ["k_year", "k_rank", "k_title", "k_artist"]


@register("incr_i1_skip_processed_keys",
          f"WITH c AS {_SQL_KEYED}, done AS (SELECT * FROM c WHERE year < 2000) "
          "SELECT year, rank, title_clean, primary_artist FROM c x WHERE NOT EXISTS (SELECT 1 FROM done d WHERE "
          "d.k_year = x.k_year AND d.k_rank = x.k_rank AND d.k_title = x.k_title AND d.k_artist = x.k_artist)")
def incr_i1(spark, sf_dir):
    c = _key_cols(_c1(spark, sf_dir))
    prev = c.filter(F.col("year") < 2000)
    matched, unmatched = prev.filter(F.col("src_line") % 2 == 1), prev.filter(F.col("src_line") % 2 == 0)
    return INC.pending(c, [matched, unmatched], _KEYS).select("year", "rank", "title_clean", "primary_artist")


@register("incr_i2_skip_processed_year_rank",
          f"WITH c AS {sql_c1()} SELECT year, rank, title_clean FROM c x WHERE NOT EXISTS "
          "(SELECT 1 FROM c d WHERE d.year < 2005 AND d.year = x.year AND d.rank = x.rank)")
def incr_i2(spark, sf_dir):
    c = _c1(spark, sf_dir)
    return INC.pending(c, [c.filter(F.col("year") < 2005)], ["year", "rank"]).select("year", "rank", "title_clean")


@register("incr_i3_skip_processed_years",
          f"WITH {_sql_pool()}, c AS (SELECT * FROM c1) SELECT year, rank, title_clean FROM c WHERE year NOT IN "
          "(SELECT DISTINCT target_year FROM sampled WHERE target_year < 1999)")
def incr_i3(spark, sf_dir):
    c = _c1(spark, sf_dir)
    done = CS.sample_per_year(CS.negative_pool(FX.catalog(spark, sf_dir), c)).filter(F.col("target_year") < 1999)
    return INC.pending_groups(c, done.withColumnRenamed("target_year", "year"), "year") \
        .select("year", "rank", "title_clean")


@register("incr_i4_streaming_id_link",
          f"SELECT y.src_order, y.src_line, y.partkey, y.src_supp, c.id AS spotify_id, c.popularity FROM {_YE} y "
          f"LEFT JOIN {_CAT} c ON c.id = 't' || CAST(y.partkey AS VARCHAR)")
def incr_i4(spark, sf_dir):
    """Micro-batches over the line-item file: each batch becomes year-end chart
    rows, is linked to the catalog by id and appended under its row key."""
    part = FX.table(spark, sf_dir, "part")
    by_id = L.unique_lookup(FX.catalog(spark, sf_dir).withColumnRenamed("id", "spotify_id"), ["spotify_id"],
                            [U.desc("popularity"), U.asc("name")])
    schema = FX.table(spark, sf_dir, "lineitem").schema

    def transform(batch):
        y = FX.yearend_from(batch, part).withColumn("sid", F.concat(F.lit("t"), F.col("partkey").cast("string")))
        out = L.link(y, [L.Pass("id", by_id, ["sid"], ["spotify_id"])], payload=["spotify_id", "popularity"])
        return out.select("src_order", "src_line", "partkey", "src_supp", "spotify_id", "popularity")

    sink = INC.run_incremental(spark, sf_dir, schema, transform, keys=["src_order", "src_line", "partkey", "src_supp"],
                               file_filter="lineitem.parquet")
    return INC.read_sink(spark, sink)


# --- C5: merge positives and negatives ------------------------------------------------

# The merged set's columns in their order.
KEEP_COLS = ["label", "year", "rank", "title", "artist", "title_clean", "artist_clean", "primary_artist",
             "spotify_id", "spotify_title", "spotify_artist", "spotify_album", "album_type", "release_date",
             "release_year", "popularity", "explicit", "duration_ms", "isrc"] + FX.AUDIO_COLS + [
             "time_signature", "audio_features_available"]


def merge_sets(pos, neg):
    """Release year derived where absent (P12, P3), pipeline columns dropped
    (P11), union aligned by name (O1), the kept columns in order (P10), one row
    per track id: earliest year, hits first (U4)."""
    pos = PC.with_if_absent(pos, "release_year", PC.year_of("release_date"))
    pos = PC.drop_if_present(pos, ["second_pass_label", "billboard_year"])
    neg = PC.drop_if_present(neg, ["billboard_year"])
    both = PC.select_existing(O.union_aligned(pos, neg), KEEP_COLS)
    return U.keep_best(both, ["spotify_id"], [U.asc("year"), U.desc("label"), U.asc("rank"), U.asc("title"),
                                              U.asc("artist")], isolate_empty=True)


_C5_COLS = ["label", "year", "rank", "title", "artist", "spotify_id", "spotify_title", "release_date",
            "release_year", "popularity"]


@register("pipe_c5_merge_datasets",
          f"WITH {_sql_pool()}, "
          "pos AS (SELECT 1 AS label, c.year, c.rank, c.title, c.artist, k.id AS spotify_id, k.name AS spotify_title, "
          "k.release_date, CAST(year(coalesce(try_strptime(k.release_date, '%Y-%m-%d'), try_strptime(k.release_date, "
          "'%Y-%m'), try_strptime(k.release_date, '%Y'))) AS INTEGER) AS release_year, k.popularity "
          "FROM c1 c JOIN cat_raw k ON k.id = 't' || CAST(c.partkey AS VARCHAR)), "
          "neg AS (SELECT 0 AS label, target_year AS year, CAST(NULL AS INTEGER) AS rank, title, CAST(NULL AS VARCHAR) "
          "AS artist, spotify_id, CAST(NULL AS VARCHAR) AS spotify_title, release_date, release_year, popularity "
          "FROM sampled), u AS (SELECT * FROM pos UNION ALL SELECT * FROM neg) "
          f"SELECT {', '.join(_C5_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY spotify_id ORDER BY "
          "year ASC NULLS LAST, label DESC, rank ASC NULLS LAST, title ASC NULLS LAST, artist ASC NULLS LAST) AS rn "
          "FROM u) WHERE rn = 1")
def pipe_c5(spark, sf_dir):
    c1 = _c1(spark, sf_dir)
    cat = FX.catalog(spark, sf_dir).select(F.col("id").alias("spotify_id"), F.col("name").alias("spotify_title"),
                                           "release_date", "popularity")
    pos = (c1.withColumn("spotify_id", F.concat(F.lit("t"), F.col("partkey").cast("string")))
             .join(cat, "spotify_id").withColumn("label", F.lit(1)))
    pool = CS.negative_pool(FX.catalog(spark, sf_dir), c1)
    neg = (CS.sample_per_year(pool).withColumn("year", F.col("target_year"))
             .withColumnRenamed("target_year", "billboard_year").withColumn("label", F.lit(0))
             .drop("title_clean", "primary_artist"))
    return merge_sets(pos, neg).select(*_C5_COLS)
