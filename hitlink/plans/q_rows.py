"""Projection (P*), deduplication (U*) and set-operation (O*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as PC
from ..functions import text as TX
from ..operators import dedup as U
from ..operators import linkage as L
from ..operators import setops as O
from . import fixtures as FX
from . import oracle_sql as OS
from . import oracle_text as OT
from .pipelines import clean_chart, prepare_catalog, prepare_chart
from .registry import r6, register

_SONGS = FX.sql_songs()
_CAT = FX.sql_catalog()
_YE = FX.sql_yearend_chart()
_WK = FX.sql_weekly_chart()


def _num(x):  # P2 in SQL: through double, truncating like a Spark cast
    return f"TRY_CAST(trunc(TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE)) AS BIGINT)"


# --- projections ----------------------------------------------------------------

@register("proj_p2_numeric_coercion",
          f"SELECT id, {_num('release_date')} AS release_num, {_num('popularity')} AS popularity_num FROM {_CAT}")
def proj_p2(spark, sf_dir):
    c = FX.catalog(spark, sf_dir)
    return c.select("id", PC.to_long("release_date").alias("release_num"),
                    PC.to_long("popularity").alias("popularity_num"))


@register("proj_p3_year_of_date",
          f"SELECT entry_order, entry_line, CAST(year(TRY_CAST(chart_week AS TIMESTAMP)) AS INTEGER) AS year FROM {_WK}")
def proj_p3(spark, sf_dir):
    w = FX.weekly_chart(spark, sf_dir)
    return w.select("entry_order", "entry_line", PC.year_of("chart_week").alias("year"))


@register("proj_p4_year_prefix",
          f"SELECT id, TRY_CAST(substring(release_date, 1, 4) AS INTEGER) AS release_year FROM {_CAT}")
def proj_p4(spark, sf_dir):
    return FX.catalog(spark, sf_dir).select("id", PC.year_prefix("release_date").alias("release_year"))


@register("proj_p5_to_p9_derived",
          "SELECT id, CAST(floor(year / 10) * 10 AS INTEGER) AS decade, "
          "coalesce(CAST(explicit AS INTEGER), 0) AS is_explicit, "
          "CASE WHEN label = 1 THEN 'Billboard Hit' WHEN label = 0 THEN 'Non-hit' END AS label_str, "
          "round(duration_ms / 60000.0, 6) AS duration_min, danceability IS NOT NULL AS has_features "
          f"FROM {_SONGS}")
def proj_p5_p9(spark, sf_dir):
    s = FX.songs(spark, sf_dir)
    return s.select("id", PC.decade("year").alias("decade"), PC.is_explicit("explicit").alias("is_explicit"),
                    PC.label_name("label").alias("label_str"),
                    F.round(PC.minutes("duration_ms"), 6).alias("duration_min"),
                    PC.present("danceability").alias("has_features"))


@register("proj_p14_non_empty_keys",
          f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND length({OT.strip(OT.light_clean('text'))}) > 0")
def proj_p14(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents")
    return d.filter(PC.non_empty(TX.light_clean("text"))).select("doc_id")


@register("proj_p15_trailing_year_window",
          f"SELECT y.src_order, y.src_line, y.year AS chart_year, c.year AS release_year FROM {_YE} y "
          f"JOIN {_CAT} c ON c.id = 't' || CAST(y.partkey AS VARCHAR) WHERE c.year BETWEEN y.year - 2 AND y.year")
def proj_p15(spark, sf_dir):
    y = FX.yearend_chart(spark, sf_dir).withColumn("cid", F.concat(F.lit("t"), F.col("partkey").cast("string")))
    c = FX.catalog(spark, sf_dir).select(F.col("id").alias("cid"), F.col("year").alias("release_year"))
    j = y.join(c, "cid")
    return j.filter(PC.in_trailing_window("release_year", "year")).select(
        "src_order", "src_line", F.col("year").alias("chart_year"), "release_year")


@register("proj_p17_not_equal_keeps_null",
          f"SELECT entry_order, entry_line, year FROM (SELECT entry_order, entry_line, "
          f"CAST(year(TRY_CAST(chart_week AS TIMESTAMP)) AS INTEGER) AS year FROM {_WK}) "
          "WHERE year IS DISTINCT FROM 1996")
def proj_p17(spark, sf_dir):
    w = FX.weekly_chart(spark, sf_dir).select("entry_order", "entry_line", PC.year_of("chart_week").alias("year"))
    return w.filter(PC.not_equal_keep_null("year", 1996))


@register("proj_p18_rank_bucket",
          "SELECT id, peak_rank, CASE WHEN peak_rank > 0 AND peak_rank <= 10 THEN 'Top 10' "
          "WHEN peak_rank > 10 AND peak_rank <= 50 THEN '11-50' WHEN peak_rank > 50 AND peak_rank <= 100 "
          f"THEN '51-100' END AS bucket FROM {_SONGS}")
def proj_p18(spark, sf_dir):
    s = FX.songs(spark, sf_dir)
    return s.select("id", "peak_rank", PC.rank_bucket("peak_rank").alias("bucket"))


# --- deduplication --------------------------------------------------------------

@register("dedup_u1_most_popular",
          f"WITH {OS.catalog_ctes()} SELECT spotify_id, nt, na, popularity FROM cat_d")
def dedup_u1(spark, sf_dir):
    return prepare_catalog(FX.catalog(spark, sf_dir)).select("spotify_id", "nt", "na", "popularity")


@register("dedup_u2_best_peak",
          f"WITH {OS.chart_ctes()} SELECT title, artist, year, peak_rank, peak_pos, wks_on_chart FROM hk")
def dedup_u2(spark, sf_dir):
    h = prepare_chart(FX.weekly_chart(spark, sf_dir))
    return h.select("title", "artist", "year", "peak_rank", "peak_pos", "wks_on_chart")


def _sql_clean_chart() -> str:
    return (f"(SELECT year, rank, title, artist, src_order, src_line, partkey, src_supp, "
            f"{OT.clean_title_v1('title')} AS title_clean, "
            f"{OT.clean_artist('artist')} AS artist_clean FROM (SELECT year, rank, {OT.strip('title')} AS title, "
            f"{OT.strip('artist')} AS artist, src_order, src_line, partkey, src_supp FROM {_YE}))")


def sql_c1() -> str:
    """C1 in SQL: clean, lead artist, drop empty, first row per (year, rank, title, artist)."""
    return (f"(SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY year, rank, title_clean, "
            "artist_clean ORDER BY src_order, src_line, partkey, src_supp) AS _rn FROM (SELECT *, "
            f"{OT.lead_artist('artist_clean')} AS primary_artist FROM {_sql_clean_chart()}) "
            "WHERE length(title_clean) > 0 AND length(artist_clean) > 0) WHERE _rn = 1)")


@register("dedup_u3_exact_duplicates",
          f"SELECT year, rank, title_clean, artist_clean, primary_artist, src_order, src_line FROM {sql_c1()}")
def dedup_u3(spark, sf_dir):
    c = clean_chart(FX.yearend_chart(spark, sf_dir))
    return c.select("year", "rank", "title_clean", "artist_clean", "primary_artist", "src_order", "src_line")


_U4_SRC = (f"(SELECT 't' || CAST(partkey AS VARCHAR) AS spotify_id, year, 1 AS label, src_order AS o1, src_line AS o2, "
           f"src_supp AS o3 FROM {_YE} UNION ALL SELECT id, year, 0, 0, 0, 0 FROM {_CAT})")


@register("dedup_u4_by_id_year_label",
          "SELECT spotify_id, year, label, o1, o2 FROM (SELECT *, row_number() OVER (PARTITION BY spotify_id "
          f"ORDER BY year ASC NULLS LAST, label DESC, o1, o2, o3) AS _rn FROM {_U4_SRC}) WHERE _rn = 1")
def dedup_u4(spark, sf_dir):
    y = FX.yearend_chart(spark, sf_dir).select(
        F.concat(F.lit("t"), F.col("partkey").cast("string")).alias("spotify_id"), "year",
        F.lit(1).alias("label"), F.col("src_order").alias("o1"), F.col("src_line").alias("o2"),
        F.col("src_supp").alias("o3"))
    c = FX.catalog(spark, sf_dir).select(F.col("id").alias("spotify_id"), "year", F.lit(0).alias("label"),
                                         F.lit(0).cast("bigint").alias("o1"), F.lit(0).alias("o2"),
                                         F.lit(0).cast("bigint").alias("o3"))
    both = y.unionByName(c)
    best = U.keep_best(both, ["spotify_id"], [U.asc("year"), U.desc("label"), U.asc("o1"), U.asc("o2"), U.asc("o3")])
    return best.drop("o3")


_U5_SRC = (f"(SELECT 't' || CAST(partkey AS VARCHAR) AS spotify_id, {OT.light_clean('title')} AS title_clean, "
           f"{OT.strip(OT.lead_artist(OT.light_clean('artist')))} AS primary_artist, src_order, src_line, partkey, "
           f"src_supp FROM {_YE})")


@register("dedup_u5_two_stage",
          "WITH a AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY spotify_id "
          f"ORDER BY src_order, src_line, partkey, src_supp) AS _rn FROM {_U5_SRC}) WHERE _rn = 1) "
          "SELECT spotify_id, title_clean, primary_artist, src_order, src_line FROM (SELECT *, row_number() OVER "
          "(PARTITION BY title_clean, primary_artist ORDER BY src_order, src_line, partkey, src_supp) AS _rn FROM a) "
          "WHERE _rn = 1")
def dedup_u5(spark, sf_dir):
    y = FX.yearend_chart(spark, sf_dir).select(
        F.concat(F.lit("t"), F.col("partkey").cast("string")).alias("spotify_id"),
        TX.light_clean("title").alias("title_clean"),
        TX.strip(TX.lead_artist(TX.light_clean("artist"))).alias("primary_artist"), "src_order", "src_line",
        "partkey", "src_supp")
    order = [U.asc(c) for c in ("src_order", "src_line", "partkey", "src_supp")]
    a = U.keep_best(y, ["spotify_id"], order)
    b = U.keep_best(a, ["title_clean", "primary_artist"], order)
    return b.select("spotify_id", "title_clean", "primary_artist", "src_order", "src_line")


@register("dedup_u6_first_seen_across_groups",
          "SELECT partkey, year, src_line, rank, src_order FROM (SELECT *, row_number() OVER (PARTITION BY partkey "
          f"ORDER BY year, src_line, rank, src_order, src_supp) AS _rn FROM {_YE}) WHERE _rn = 1 AND src_line <> 4")
def dedup_u6(spark, sf_dir):
    """An id is collected at its first (year, query, offset, position) even if that
    row is then filtered out (here: query 4 is filtered after the dedup)."""
    y = FX.yearend_chart(spark, sf_dir).select("partkey", "year", "src_line", "rank", "src_order", "src_supp")
    first = U.first_seen(y, "partkey", [U.asc("year"), U.asc("src_line"), U.asc("rank"), U.asc("src_order"),
                                        U.asc("src_supp")])
    return first.filter(F.col("src_line") != 4).drop("src_supp")


# --- set operations --------------------------------------------------------------

@register("set_o1_union_by_name",
          f"SELECT year, rank, title, artist, NULL::VARCHAR AS spotify_id, NULL::INTEGER AS popularity, 1 AS label "
          f"FROM {_YE} UNION ALL BY NAME SELECT year, id AS spotify_id, name AS title, popularity, 0 AS label FROM {_CAT}")
def set_o1(spark, sf_dir):
    pos = FX.yearend_chart(spark, sf_dir).select("year", "rank", "title", "artist", F.lit(1).alias("label"))
    neg = FX.catalog(spark, sf_dir).select("year", F.col("id").alias("spotify_id"), F.col("name").alias("title"),
                                           "popularity", F.lit(0).alias("label"))
    return O.union_aligned(pos, neg)


@register("set_o2_union_all",
          f"SELECT title, performer AS artist, 'weekly' AS source FROM {_WK} "
          f"UNION ALL SELECT name, artists, 'catalog' FROM {_CAT}")
def set_o2(spark, sf_dir):
    w = FX.weekly_chart(spark, sf_dir).select("title", F.col("performer").alias("artist"), F.lit("weekly").alias("source"))
    c = FX.catalog(spark, sf_dir).select(F.col("name").alias("title"), F.col("artists").alias("artist"),
                                         F.lit("catalog").alias("source"))
    return w.unionByName(c)


@register("set_o3_idempotent_append",
          f"WITH prev AS (SELECT year, rank, title, artist FROM {_YE} WHERE year < 2005), "
          f"batch AS (SELECT year, rank, title, artist FROM {_YE} WHERE year >= 2003), "
          "once AS (SELECT * FROM prev UNION ALL SELECT * FROM batch b WHERE NOT EXISTS "
          "(SELECT 1 FROM prev p WHERE p.year = b.year AND p.rank = b.rank)) "
          "SELECT * FROM once UNION ALL SELECT * FROM batch b WHERE NOT EXISTS "
          "(SELECT 1 FROM once p WHERE p.year = b.year AND p.rank = b.rank)")
def set_o3(spark, sf_dir):
    """Appending a batch twice equals appending it once: the second append adds nothing."""
    y = FX.yearend_chart(spark, sf_dir).select("year", "rank", "title", "artist")
    prev = y.filter(F.col("year") < 2005)
    batch = y.filter(F.col("year") >= 2003)
    once = O.append_new(prev, batch, ["year", "rank"])
    return O.append_new(once, batch, ["year", "rank"])


@register("set_o4_key_union",
          f"WITH {OS.chart_ctes()} SELECT NULLIF(nt, '') AS k1, NULLIF(na, '') AS k2 FROM hk "
          "UNION SELECT NULLIF(ntb, ''), NULLIF(na, '') FROM hk")
def set_o4(spark, sf_dir):
    h = prepare_chart(FX.weekly_chart(spark, sf_dir))
    h = h.select(L.joinable(F.col("nt")).alias("nt"), L.joinable(F.col("ntb")).alias("ntb"),
                 L.joinable(F.col("na")).alias("na"))
    return L.key_union((h, ["nt", "na"]), (h, ["ntb", "na"]), names=["k1", "k2"])


def _ws(x):
    return OT.word_set(x, alnum=True)


@register("set_o5_word_set_ops",
          "SELECT a.conv_id, a.turn, "
          f"array_to_string(list_sort(list_intersect({_ws('a.text')}, {_ws('b.text')})), ' ') AS common, "
          f"array_to_string(list_sort(list_distinct(list_concat({_ws('a.text')}, {_ws('b.text')}))), ' ') AS either, "
          f"array_to_string(list_sort(list_filter({_ws('a.text')}, lambda w: NOT list_contains({_ws('b.text')}, w))), ' ') AS only_first "
          "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def set_o5(spark, sf_dir):
    c = FX.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    wa, wb = TX.word_set(F.col("a.text"), alnum=True), TX.word_set(F.col("b.text"), alnum=True)
    return j.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"),
                    F.array_join(F.array_sort(F.array_intersect(wa, wb)), " ").alias("common"),
                    F.array_join(F.array_sort(F.array_union(wa, wb)), " ").alias("either"),
                    F.array_join(F.array_sort(F.array_except(wa, wb)), " ").alias("only_first"))


@register("pipe_c1_clean_chart",
          f"SELECT year, rank, title, artist, title_clean, artist_clean, primary_artist FROM {sql_c1()}")
def pipe_c1(spark, sf_dir):
    """C1 over the whole chart."""
    return clean_chart(FX.yearend_chart(spark, sf_dir)).select(
        "year", "rank", "title", "artist", "title_clean", "artist_clean", "primary_artist")


@register("proj_p16_optional_range",
          f"SELECT year, rank, title, artist FROM {sql_c1()} WHERE year >= 1995")
def proj_p16(spark, sf_dir):
    """The optional year range of the sampler (start 1995, no end)."""
    c = clean_chart(FX.yearend_chart(spark, sf_dir))
    return c.filter(PC.optional_range("year", 1995, 0)).select("year", "rank", "title", "artist")
