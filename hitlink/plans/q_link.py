"""Linkage queries (J1-J14) and the pipelines built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import dedup as U
from ..operators import linkage as L
from . import cascade as CS
from . import fixtures as FX
from . import oracle_sql as OS
from . import oracle_text as OT
from .pipelines import (base_lookup, clean_chart, enrich_three_pass, link_hits, non_hits, prepare_catalog,
                        prepare_chart)
from .q_rows import sql_c1
from .registry import r6, register
from ..session import materialize

_CAT = FX.sql_catalog()
_YE = FX.sql_yearend_chart()


def _c1(spark, sf_dir):
    """The cleaned year-end chart, written once: the queries below read it more
    than once (years, keys, songs), and its regex cleaning is the costly part."""
    return materialize(clean_chart(FX.yearend_chart(spark, sf_dir)), "chart_clean")


# --- J1-J3, J6: lookups on the weekly chart ---------------------------------------

@register("link_j1_exact_lookup",
          f"WITH {OS.catalog_ctes()},{OS.chart_ctes()} SELECT h.title, h.artist, e.spotify_id FROM hk h "
          "LEFT JOIN cat_d e ON NULLIF(h.nt, '') = e.nt AND NULLIF(h.na, '') = e.na")
def link_j1(spark, sf_dir):
    hits = prepare_chart(FX.weekly_chart(spark, sf_dir))
    cat = prepare_catalog(FX.catalog(spark, sf_dir))
    out = L.link(hits, [L.Pass("exact", cat, ["nt", "na"], ["nt", "na"])], payload=["spotify_id"])
    return out.select("title", "artist", "spotify_id")


@register("link_j2_base_lookup",
          f"WITH {OS.catalog_ctes()},{OS.chart_ctes()} SELECT h.title, h.artist, b.spotify_id, b.popularity FROM hk h "
          "LEFT JOIN cat_b b ON NULLIF(h.ntb, '') = b.ntb AND NULLIF(h.na, '') = b.na")
def link_j2(spark, sf_dir):
    hits = prepare_chart(FX.weekly_chart(spark, sf_dir))
    cat = base_lookup(prepare_catalog(FX.catalog(spark, sf_dir)))
    out = L.link(hits, [L.Pass("base", cat, ["ntb", "na"], ["ntb", "na"])], payload=["spotify_id", "popularity"])
    return out.select("title", "artist", "spotify_id", "popularity")


@register("link_j3_two_pass",
          f"WITH {OS.catalog_ctes()},{OS.chart_ctes()},{OS.linked_cte()} "
          "SELECT title, artist, year, spotify_id, match_pass, round(danceability, 6) AS danceability FROM linked")
def link_j3(spark, sf_dir):
    linked = link_hits(prepare_chart(FX.weekly_chart(spark, sf_dir)), prepare_catalog(FX.catalog(spark, sf_dir)))
    return linked.select("title", "artist", "year", "spotify_id", "match_pass", r6("danceability"))


@register("link_j6_non_hits",
          f"WITH {OS.catalog_ctes()},{OS.chart_ctes()}, "
          "hitkeys AS (SELECT DISTINCT NULLIF(nt, '') AS k1, NULLIF(na, '') AS k2 FROM hk "
          "UNION SELECT DISTINCT NULLIF(ntb, ''), NULLIF(na, '') FROM hk) "
          "SELECT spotify_id, title, primary_artist FROM cat_d c "
          "WHERE NOT EXISTS (SELECT 1 FROM hitkeys k WHERE k.k1 = c.nt AND k.k2 = c.na) "
          "AND NOT EXISTS (SELECT 1 FROM hitkeys k WHERE k.k1 = c.ntb AND k.k2 = c.na)")
def link_j6(spark, sf_dir):
    cat = prepare_catalog(FX.catalog(spark, sf_dir))
    hits = prepare_chart(FX.weekly_chart(spark, sf_dir))
    return non_hits(cat, hits).select("spotify_id", "title", "primary_artist")


# --- J4, J5 (C6), J8: id lookups on a modeling set --------------------------------

_BY_ID = ("(SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY spotify_id ORDER BY "
          "popularity ASC NULLS FIRST, nt, na) AS _rn FROM cat_d) WHERE _rn = 1)")


@register("link_j4_id_lookup",
          f"WITH {OS.catalog_ctes()}, byid AS {_BY_ID} SELECT y.src_order, y.src_line, b.spotify_id, b.popularity, "
          f"round(b.danceability, 6) AS danceability FROM {_YE} y "
          "LEFT JOIN byid b ON b.spotify_id = 't' || CAST(y.partkey AS VARCHAR)")
def link_j4(spark, sf_dir):
    from .pipelines import catalog_by_id
    y = FX.yearend_chart(spark, sf_dir).withColumn("sid", F.concat(F.lit("t"), F.col("partkey").cast("string")))
    byid = catalog_by_id(prepare_catalog(FX.catalog(spark, sf_dir)))
    out = L.link(y, [L.Pass("id", byid, ["sid"], ["spotify_id"])], payload=["spotify_id", "popularity", "danceability"])
    return out.select("src_order", "src_line", "spotify_id", "popularity", r6("danceability"))


def _sql_modeling() -> str:
    return ("(SELECT src_order, src_line, year, rank, title, artist, primary_artist, "
            "CASE WHEN src_line = 4 AND src_order % 8 = 0 THEN 't' || CAST(partkey AS VARCHAR) END AS spotify_id, "
            "CAST(NULL AS VARCHAR) AS spotify_title, src_line = 7 AS audio_features_available, "
            "CASE WHEN src_line = 7 THEN 0.5 END AS danceability "
            f"FROM {sql_c1()})")


def _modeling(spark, sf_dir):
    c = _c1(spark, sf_dir)
    return c.select("src_order", "src_line", "year", "rank", "title", "artist", "primary_artist",
                    F.when((F.col("src_line") == 4) & (F.col("src_order") % 8 == 0), F.concat(F.lit("t"), F.col("partkey").cast("string")))
                    .alias("spotify_id"),
                    F.lit(None).cast("string").alias("spotify_title"),
                    (F.col("src_line") == 7).alias("audio_features_available"),
                    F.when(F.col("src_line") == 7, F.lit(0.5)).alias("danceability"))


@register("pipe_c6_three_pass_enrichment",
          f"WITH {OS.catalog_ctes()}, byid AS {_BY_ID}, m AS {_sql_modeling()}, "
          "mk AS (SELECT *, NULLIF(" + OT.norm("coalesce(spotify_title, title)", role="title") + ", '') AS k_t, "
          "NULLIF(" + OT.norm_base("coalesce(spotify_title, title)", role="title") + ", '') AS k_tb, "
          "NULLIF(" + OT.norm("coalesce(primary_artist, artist)") + ", '') AS k_a FROM m) "
          "SELECT mk.src_order, mk.src_line, "
          "CASE WHEN mk.audio_features_available THEN 'already' WHEN i.spotify_id IS NOT NULL THEN 'id' "
          "WHEN e.nt IS NOT NULL THEN 'exact' WHEN b.ntb IS NOT NULL THEN 'base' ELSE 'none' END AS match_pass, "
          "round(CASE WHEN mk.audio_features_available THEN mk.danceability WHEN i.spotify_id IS NOT NULL "
          "THEN i.danceability WHEN e.nt IS NOT NULL THEN e.danceability WHEN b.ntb IS NOT NULL THEN b.danceability END, 6) "
          "AS danceability, "
          "(mk.audio_features_available OR i.spotify_id IS NOT NULL OR e.nt IS NOT NULL OR b.ntb IS NOT NULL) "
          "AS audio_features_available "
          "FROM mk LEFT JOIN byid i ON NOT mk.audio_features_available AND i.spotify_id = NULLIF(mk.spotify_id, '') "
          "LEFT JOIN cat_d e ON NOT mk.audio_features_available AND e.nt = mk.k_t AND e.na = mk.k_a "
          "LEFT JOIN cat_b b ON NOT mk.audio_features_available AND b.ntb = mk.k_tb AND b.na = mk.k_a")
def pipe_c6(spark, sf_dir):
    out = enrich_three_pass(_modeling(spark, sf_dir), prepare_catalog(FX.catalog(spark, sf_dir)))
    return out.select("src_order", "src_line", "match_pass", r6("danceability"), "audio_features_available")


@register("link_j8_anti_by_id",
          f"SELECT id FROM {_CAT} c WHERE NOT EXISTS (SELECT 1 FROM {_sql_modeling()} m "
          "WHERE m.spotify_id IS NOT NULL AND m.spotify_id = c.id)")
def link_j8(spark, sf_dir):
    m = _modeling(spark, sf_dir).filter(F.col("spotify_id").isNotNull())
    return L.anti_join(FX.catalog(spark, sf_dir), m, ["id"], ["spotify_id"]).select("id")


# --- J9-J13 (C8): search cascades ------------------------------------------------

def _sql_results(name: str, keys: list[str], k: int) -> str:
    ks = ", ".join(keys)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    return (f"{name} AS (SELECT * FROM (SELECT {ks}, spotify_id, popularity, track_artists, row_number() OVER "
            f"(PARTITION BY {ks} ORDER BY popularity DESC NULLS LAST, spotify_id) AS cand_pos FROM idx WHERE {nn}) "
            f"WHERE cand_pos <= {k})")


def _sql_cascade_base() -> str:
    first = f"{OT.list_items('artists')}[1]"
    return f"""
cat_raw AS {_CAT},
idx AS (SELECT id AS spotify_id, name AS track_title, popularity, year,
        array_to_string({OT.list_items('artists')}, ' ') AS track_artists,
        NULLIF({OT.norm_base('name')}, '') AS tk, NULLIF({OT.norm(first)}, '') AS ak,
        NULLIF({OT.norm(OT.short_artist(first))}, '') AS sk FROM cat_raw),
c1 AS {sql_c1()},
songs AS (SELECT concat_ws(chr(1), coalesce(CAST(year AS VARCHAR), ''), coalesce(CAST(rank AS VARCHAR), ''),
          coalesce(title_clean, ''), coalesce(artist_clean, '')) AS song_id, year, rank, title, artist, title_clean, primary_artist,
          NULLIF({OT.norm_base('title_clean')}, '') AS tk, NULLIF({OT.norm('primary_artist')}, '') AS ak FROM c1),
{_sql_results('r1', ['tk', 'ak', 'year'], 5)},
{_sql_results('r2', ['tk', 'ak'], 5)},
w1 AS (SELECT song_id, {OT.word_set('primary_artist')} AS words FROM songs),
w3 AS (SELECT spotify_id, {OT.word_set('track_artists')} AS words FROM idx),
found AS (
  SELECT s.song_id, s.primary_artist, r.spotify_id, r.popularity, r.track_artists, r.cand_pos, 1 AS stage
    FROM songs s JOIN r1 r ON s.tk = r.tk AND s.ak = r.ak AND s.year = r.year
  UNION ALL SELECT s.song_id, s.primary_artist, r.spotify_id, r.popularity, r.track_artists, r.cand_pos, 2
    FROM songs s JOIN r2 r ON s.tk = r.tk AND s.ak = r.ak
  UNION ALL SELECT s.song_id, s.primary_artist, r.spotify_id, r.popularity, r.track_artists,
    row_number() OVER (PARTITION BY s.song_id ORDER BY r.popularity DESC NULLS LAST, r.spotify_id), 3
    FROM songs s JOIN w1 ON w1.song_id = s.song_id JOIN idx r ON s.tk = r.tk JOIN w3 ON w3.spotify_id = r.spotify_id
    WHERE list_has_any(w1.words, w3.words)),
fs AS (SELECT song_id, min(stage) AS stage FROM found GROUP BY song_id),
used AS (SELECT f.*, {OT.jaccard(OT.word_set('f.primary_artist'), OT.word_set('f.track_artists'))} AS score
         FROM found f JOIN fs ON f.song_id = fs.song_id AND f.stage = fs.stage),
best AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC,
         coalesce(popularity, 0) DESC, cand_pos) AS _rn FROM used WHERE score >= 0.5) WHERE _rn = 1),
fp AS (SELECT s.song_id, coalesce(fs.stage, 0) AS stage, b.spotify_id, b.score FROM songs s
       LEFT JOIN fs ON s.song_id = fs.song_id LEFT JOIN best b ON s.song_id = b.song_id)"""


def _first_pass(spark, sf_dir, with_index: bool = False):
    songs, index = CS.cascade_inputs(FX.catalog(spark, sf_dir), _c1(spark, sf_dir))
    fp = CS.first_pass(songs, index)
    return (songs, fp, index) if with_index else (songs, fp)


@register("link_j9_j11_first_pass",
          f"WITH {_sql_cascade_base()} SELECT song_id, stage, spotify_id, round(score, 6) AS score FROM fp")
def link_j9_j11(spark, sf_dir):
    _, fp = _first_pass(spark, sf_dir)
    return fp.select("song_id", "stage", "spotify_id", r6("score"))


@register("link_j13_matched_split",
          f"WITH {_sql_cascade_base()} SELECT CASE WHEN spotify_id IS NULL THEN 'unmatched' ELSE 'matched' END "
          "AS status, count(*) AS n FROM fp GROUP BY 1")
def link_j13(spark, sf_dir):
    songs, fp = _first_pass(spark, sf_dir)
    return L.matched_split_counts(fp, songs, "spotify_id")


def _sql_second_pass() -> str:
    def best(name, src, res, on, expected):
        return (f"{name} AS (SELECT song_id, spotify_id FROM (SELECT s.song_id, r.spotify_id, row_number() OVER "
                f"(PARTITION BY s.song_id ORDER BY {OT.jaccard(OT.word_set(expected, True), OT.word_set('r.track_artists', True))} DESC, "
                f"coalesce(r.popularity, 0) DESC, r.cand_pos) AS _rn FROM {src} s JOIN {res} r ON {on} "
                f"WHERE {OT.jaccard(OT.word_set(expected, True), OT.word_set('r.track_artists', True))} >= 0.3) WHERE _rn = 1)")

    def popular(name, src, res, on):
        return (f"{name} AS (SELECT song_id, spotify_id FROM (SELECT s.song_id, r.spotify_id, row_number() OVER "
                f"(PARTITION BY s.song_id ORDER BY coalesce(r.popularity, 0) DESC, r.cand_pos) AS _rn "
                f"FROM {src} s JOIN {res} r ON {on} WHERE coalesce(r.popularity, 0) >= 10) WHERE _rn = 1)")

    return f"""{_sql_cascade_base()},
unm AS (SELECT s.* FROM songs s JOIN fp ON s.song_id = fp.song_id WHERE fp.spotify_id IS NULL),
s2 AS (SELECT song_id, year, NULLIF({OT.norm_base(OT.clean_title_v2('title'))}, '') AS tk,
       {OT.lead_artist_v2('artist')} AS lead FROM unm),
s2b AS (SELECT *, {OT.short_artist('lead')} AS short FROM s2),
s2c AS (SELECT *, NULLIF({OT.norm('lead')}, '') AS ak, NULLIF({OT.norm('short')}, '') AS sk FROM s2b),
{_sql_results('ra', ['tk', 'ak'], 5)},
{_sql_results('rb', ['tk', 'sk'], 5)},
{_sql_results('rc', ['tk', 'year'], 10)},
{_sql_results('rd', ['tk'], 10)},
{best('pa', 's2c', 'ra', 's.tk = r.tk AND s.ak = r.ak', 's.lead')},
rem_a AS (SELECT * FROM s2c WHERE song_id NOT IN (SELECT song_id FROM pa)),
{best('pb', "(SELECT * FROM rem_a WHERE short <> lead)", 'rb', 's.tk = r.tk AND s.sk = r.sk', 's.short')},
rem_b AS (SELECT * FROM rem_a WHERE song_id NOT IN (SELECT song_id FROM pb)),
{popular('pc', 'rem_b', 'rc', 's.tk = r.tk AND s.year = r.year')},
rem_c AS (SELECT * FROM rem_b WHERE song_id NOT IN (SELECT song_id FROM pc)),
{popular('pd', 'rem_c', 'rd', 's.tk = r.tk')},
rem_d AS (SELECT * FROM rem_c WHERE song_id NOT IN (SELECT song_id FROM pd)),
sp AS (SELECT song_id, spotify_id, 'A' AS pass FROM pa UNION ALL SELECT song_id, spotify_id, 'B' FROM pb
       UNION ALL SELECT song_id, spotify_id, 'C' FROM pc UNION ALL SELECT song_id, spotify_id, 'D' FROM pd
       UNION ALL SELECT song_id, CAST(NULL AS VARCHAR), 'none' FROM rem_d)"""


@register("link_j10_j12_second_pass", f"WITH {_sql_second_pass()} SELECT song_id, spotify_id, pass FROM sp")
def link_j10_j12(spark, sf_dir):
    songs, fp, index = _first_pass(spark, sf_dir, with_index=True)
    return CS.second_pass(CS.unmatched_songs(songs, fp), index)


@register("agg_a20_cascade_report",
          f"WITH {_sql_second_pass()} SELECT pass, count(*) AS n FROM (SELECT 'first' AS pass FROM fp "
          "WHERE spotify_id IS NOT NULL UNION ALL SELECT pass FROM sp) GROUP BY pass")
def agg_a20_cascade(spark, sf_dir):
    songs, fp, index = _first_pass(spark, sf_dir, with_index=True)
    fp = materialize(fp, "first_pass")
    sp = CS.second_pass(CS.unmatched_songs(songs, fp), index)
    both = fp.filter(F.col("spotify_id").isNotNull()).select(F.lit("first").alias("pass")) \
        .unionByName(sp.select("pass"))
    return both.groupBy("pass").agg(F.count(F.lit(1)).alias("n"))


# --- J14, J7, C7: per-year negative sampling ----------------------------------------

_TERMS = "[" + ", ".join(OT.lit(t) for t in CS.P.SEARCH_TERMS) + "]"


@register("link_j14_query_year_expansion",
          f"WITH c1 AS {sql_c1()}, y AS (SELECT DISTINCT year FROM c1 WHERE year IS NOT NULL), "
          "g AS (SELECT unnest([0, 1, 2]) AS year_no), "
          f"t AS (SELECT unnest({_TERMS}) AS term, unnest(range(10)) AS term_no) "
          "SELECT y.year AS target_year, y.year - g.year_no AS release_year, t.term, "
          "CAST(g.year_no * 10 + t.term_no AS INTEGER) AS query_no, "
          "t.term || ' year:' || CAST(y.year - g.year_no AS VARCHAR) AS query FROM y, g, t")
def link_j14(spark, sf_dir):
    return CS.query_plan(_c1(spark, sf_dir))


def _sql_pool() -> str:
    strip_l = lambda x: f"lower({OT.strip(x)})"
    ne = lambda x: f"({x} IS NOT NULL AND length({OT.strip(x)}) > 0)"
    return f"""
cat_raw AS {_CAT},
c1 AS {sql_c1()},
cand AS (SELECT id AS spotify_id, name AS title, popularity, release_date,
         {OT.light_clean('name')} AS title_clean,
         {OT.strip(OT.lead_artist(OT.light_clean("array_to_string(" + OT.list_items('artists') + ", ', ')")))} AS primary_artist,
         TRY_CAST(substring(release_date, 1, 4) AS INTEGER) AS release_year FROM cat_raw),
ex AS (SELECT *, unnest(generate_series(release_year, release_year + 2)) AS target_year FROM cand),
yrs AS (SELECT DISTINCT year AS target_year FROM c1 WHERE year IS NOT NULL),
ex2 AS (SELECT ex.*, ex.target_year - ex.release_year AS query_no FROM ex JOIN yrs ON ex.target_year = yrs.target_year),
u6 AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY spotify_id ORDER BY target_year,
       query_no, popularity DESC NULLS LAST, spotify_id) AS _rn FROM ex2) WHERE _rn = 1),
p15 AS (SELECT * FROM u6 WHERE {ne('spotify_id')} AND {ne('title_clean')} AND {ne('primary_artist')}
        AND release_year BETWEEN target_year - 2 AND target_year),
u5 AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY target_year, title_clean, primary_artist
       ORDER BY query_no, popularity DESC NULLS LAST, spotify_id) AS _rn FROM p15) WHERE _rn = 1),
pool AS (SELECT * FROM u5 c WHERE NOT EXISTS (SELECT 1 FROM c1 k WHERE k.year = c.target_year
         AND NULLIF({strip_l('k.title_clean')}, '') = {strip_l('c.title_clean')}
         AND NULLIF({strip_l('k.primary_artist')}, '') = {strip_l('c.primary_artist')})),
sampled AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY target_year ORDER BY
          md5(spotify_id || '|42'), spotify_id) AS _rn FROM pool) WHERE _rn <= 400)"""


def _pool(spark, sf_dir):
    return CS.negative_pool(FX.catalog(spark, sf_dir), _c1(spark, sf_dir))


@register("link_j7_year_scoped_anti_join",
          f"WITH {_sql_pool()} SELECT target_year, spotify_id, title_clean, primary_artist FROM pool")
def link_j7(spark, sf_dir):
    return _pool(spark, sf_dir).select("target_year", "spotify_id", "title_clean", "primary_artist")


@register("pipe_c7_negatives_by_year",
          f"WITH {_sql_pool()} SELECT target_year, spotify_id, title, release_year, popularity FROM sampled")
def pipe_c7(spark, sf_dir):
    s = CS.sample_per_year(_pool(spark, sf_dir))
    return s.select("target_year", "spotify_id", "title", "release_year", "popularity")


@register("agg_a23_min_per_year",
          f"WITH {_sql_pool()} SELECT target_year, count(*) AS n, CASE WHEN count(*) >= 400 THEN 'ok' "
          "WHEN count(*) >= 350 THEN 'below_target' ELSE 'below_minimum' END AS status FROM sampled GROUP BY 1")
def agg_a23(spark, sf_dir):
    return CS.year_status(CS.sample_per_year(_pool(spark, sf_dir)))


@register("agg_a21_per_year_report",
          f"WITH {_sql_pool()}, a AS (SELECT target_year, count(*) AS pool_n FROM pool GROUP BY ROLLUP (target_year)), "
          "b AS (SELECT target_year, count(*) AS sampled_n FROM sampled GROUP BY ROLLUP (target_year)) "
          "SELECT a.target_year, a.pool_n, coalesce(b.sampled_n, 0) AS sampled_n FROM a LEFT JOIN b "
          "ON a.target_year IS NOT DISTINCT FROM b.target_year")
def agg_a21(spark, sf_dir):
    from ..operators.stats import per_group_report
    pool = _pool(spark, sf_dir)
    return per_group_report({"pool_n": pool, "sampled_n": CS.sample_per_year(pool)}, "target_year")
