"""Role tables derived from the driver's test tables (the reference's own data is
not available). Each role is one SELECT list of plain SQL expressions that Spark
(``selectExpr``) and DuckDB (oracle) both evaluate, so the two sides start from
identical inputs. All work grows with the underlying tables: nothing is sampled
or capped here.

  catalog        <- part                      (F2: tracks with audio features)
  weekly_chart   <- lineitem x orders x part  (F1: weekly chart entries)
  yearend_chart  <- lineitem x part           (F3: raw year-end chart rows)
  labelled       <- lineitem x orders         (labelled feature rows for stats/ML)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

AUDIO_COLS = ["danceability", "energy", "key", "loudness", "mode", "speechiness",
              "acousticness", "instrumentalness", "liveness", "valence", "tempo"]
# The nine features the EDA compares (no key, no mode).
EDA_FEATURES = ["danceability", "energy", "loudness", "speechiness", "acousticness",
                "instrumentalness", "liveness", "valence", "tempo"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the session's parallelism when its file has
    fewer splits than that (the test files are single row groups)."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


_NULL_FEATURES = "p_partkey % 11 = 0"
_FEATURE_EXPRS = {
    "danceability": f"{_d('p_size')} / 50",
    "energy": f"{_d('p_partkey % 97')} / 97",
    "key": _d("p_partkey % 12"),
    "loudness": f"{_d('p_size % 20')} * 1.5 - 30",
    "mode": _d("p_partkey % 2"),
    "speechiness": f"{_d('p_partkey % 17')} / 100",
    "acousticness": f"{_d('p_partkey % 23')} / 23",
    "instrumentalness": f"{_d('p_size % 5')} / 10",
    "liveness": f"{_d('p_partkey % 9')} / 18",
    "valence": f"{_d('(p_partkey * 7) % 31')} / 31",
    "tempo": f"60 + {_d('p_size')} * 2.5",
}


def catalog_exprs() -> list[str]:
    """F2 catalog from ``part``. Titles carry decorations that exercise the keys;
    every ninth track has a title that no chart lists (non-hits); one release year
    holds more tracks than a year's sample takes."""
    name = ("CASE WHEN p_partkey % 9 = 4 THEN 'Unreleased ' ELSE '' END || p_name || CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' (Remix)' "
            "WHEN 2 THEN ' - Live' WHEN 3 THEN ' feat. X' WHEN 4 THEN ' [2009]' "
            "ELSE ' radio edit' END")
    artists = ("CASE p_partkey % 4 WHEN 0 THEN '[''' || p_brand || ''']' "
               "WHEN 1 THEN '[''' || p_brand || ''', ''Guest ' || CAST(p_partkey % 5 AS STRING) || ''']' "
               "WHEN 2 THEN '[\"' || p_brand || '\"]' ELSE p_brand END")
    year = "CAST(CASE WHEN p_partkey % 2 = 0 THEN 1998 ELSE 1995 + p_partkey % 7 END AS INT)"
    exprs = [
        "'t' || CAST(p_partkey AS STRING) AS id",
        f"{name} AS name",
        f"{artists} AS artists",
        f"{year} AS year",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size AS INT) END AS popularity",
        "(p_partkey % 3 = 0) AS explicit",
        "CAST(120000 + p_size * 3000 AS BIGINT) AS duration_ms",
        (f"CASE p_partkey % 3 WHEN 0 THEN CAST({year} AS STRING) "
         f"WHEN 1 THEN CAST({year} AS STRING) || '-0' || CAST(1 + p_partkey % 9 AS STRING) "
         f"ELSE CAST({year} AS STRING) || '-1' || CAST(p_partkey % 3 AS STRING) || '-1' "
         f"|| CAST(p_partkey % 10 AS STRING) END AS release_date"),
    ]
    for c in AUDIO_COLS:
        exprs.append(f"CASE WHEN {_NULL_FEATURES} THEN NULL ELSE {_FEATURE_EXPRS[c]} END AS {c}")
    return exprs


def weekly_chart_exprs(engine: str) -> list[str]:
    """F1 weekly chart from lineitem x orders x part; one row per chart entry."""
    week = ("date_format(o_orderdate, 'yyyy-MM-dd')" if engine == "spark"
            else "strftime(o_orderdate, '%Y-%m-%d')")
    return [
        f"CASE WHEN l_orderkey % 50 = 0 THEN 'unknown' ELSE {week} END AS chart_week",
        "l_linenumber AS current_week",
        ("p_name || CASE l_linenumber % 4 WHEN 1 THEN ' (Live)' WHEN 2 THEN ' - Radio Edit' "
         "WHEN 3 THEN ' Remix' ELSE '' END AS title"),
        ("CASE l_linenumber % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' Featuring Guest' "
         "ELSE p_brand || ' & Co' END AS performer"),
        "CAST(l_quantity AS INT) AS peak_pos",
        "CAST(l_linenumber + CAST(l_quantity AS INT) % 10 AS INT) AS wks_on_chart",
        "l_orderkey AS entry_order",
        "l_linenumber AS entry_line",
        "l_partkey AS entry_part",
        "l_suppkey AS entry_supp",
    ]


def yearend_chart_exprs() -> list[str]:
    """F3 raw year-end chart rows from lineitem x part: quoted titles, footnotes,
    repeated punctuation, pipes and featuring credits."""
    title = ("CASE l_linenumber WHEN 1 THEN '\"' || p_name || '\"' "
             "WHEN 2 THEN '“' || p_name || '”[1]' "
             "WHEN 3 THEN '\"\"\"' || p_name || '\"\"\"' "
             "WHEN 4 THEN p_name || '!!' "
             "WHEN 5 THEN p_name || '... |' "
             "WHEN 6 THEN '“' || p_name || '”' "
             "WHEN 7 THEN CASE WHEN l_orderkey % 5 = 4 THEN 'Lost Tape ' ELSE '' END || p_name || ' (feat. Guest)' "
             "ELSE p_name END")
    # By line: the lead artist alone, featuring credits, "&", lists; a longer stage name (found by its first word only) and
    # credits that name nobody of the track (found by title only).
    artist = ("CASE WHEN l_orderkey % 5 = 3 AND l_linenumber % 4 = 0 THEN p_brand || ' Ensemble of Old Town' "
              "WHEN l_orderkey % 5 = 4 AND l_linenumber % 4 = 0 THEN 'Various Voices ' || p_type ELSE "
              "CASE l_linenumber % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || CASE WHEN l_partkey % 2 = 0 "
              "THEN ' featuring ' || p_type ELSE ' [ft. ' || p_type || ']' END "
              "WHEN 2 THEN p_brand || ' & ' || p_type ELSE p_brand || ', ' || p_type || ' and Band' END END")
    return [
        "CAST(1990 + l_orderkey % 30 AS INT) AS year",
        "CAST(1 + (l_orderkey * 7 + l_linenumber) % 100 AS INT) AS rank",
        f"{title} AS title",
        f"{artist} AS artist",
        "l_orderkey AS src_order",
        "l_linenumber AS src_line",
        "l_partkey AS partkey",
        "l_suppkey AS src_supp",
    ]


_SONG_NULL = "l_orderkey % 7 = 0"
_SONG_FEATURES = {
    "danceability": "l_discount * 10",
    "energy": "l_tax * 12",
    "key": _d("l_partkey % 12"),
    "loudness": "l_quantity - 60",
    "mode": _d("l_suppkey % 2"),
    "speechiness": "l_discount + l_tax",
    "acousticness": "l_quantity / 50",
    "instrumentalness": "CASE WHEN l_linenumber > 5 THEN l_discount ELSE 0.0 END",
    "liveness": "l_tax * 5",
    "valence": f"{_d('l_partkey % 100')} / 100",
    "tempo": "60 + l_quantity * 2",
}


def songs_exprs(engine: str) -> list[str]:
    """F10-shaped labelled rows from lineitem x orders: one song per line item.
    label 1 = returned ('R'); year of the order date; features derived from
    quantity, discount and tax; every seventh order has no features."""
    yr = "year(o_orderdate)" if engine == "spark" else "year(o_orderdate)"
    exprs = [
        # (order, line, part, supplier) is the line item's unique key in the test data.
        ("CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || "
         "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS id"),
        # The song behind a row: several rows can be of one song, so a row labelled 0 can be a hit by its key.
        "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS song_key",
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label",
        f"CAST({yr} AS INT) AS year",
        "CASE WHEN l_returnflag = 'R' THEN CAST(1 + (l_orderkey * 3 + l_linenumber) % 100 AS INT) END AS peak_rank",
        "CASE WHEN l_returnflag = 'R' THEN CAST(1 + l_partkey % 40 AS INT) END AS wks_on_chart",
        "CAST(l_quantity * 2 AS INT) AS popularity",
        "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_tax > 0.04 END AS explicit",
        "CAST(floor(l_extendedprice * 3) AS BIGINT) AS duration_ms",
        f"NOT ({_SONG_NULL}) AS audio_features_available",
    ]
    for c in AUDIO_COLS:
        exprs.append(f"CASE WHEN {_SONG_NULL} THEN NULL ELSE {_SONG_FEATURES[c]} END AS {c}")
    return exprs


# A fixed score standing in for a model's class-1 probability (ranking and
# evaluation queries are checked by SQL on it).
SCORE_EXPR = ("coalesce(danceability, CAST(0 AS DOUBLE)) * CAST(0.5 AS DOUBLE) + "
              "coalesce(energy, CAST(0 AS DOUBLE)) * CAST(0.3 AS DOUBLE) + "
              "(CAST(1 AS DOUBLE) - coalesce(acousticness, CAST(0 AS DOUBLE))) * CAST(0.2 AS DOUBLE)")


def scored_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return songs(spark, sf_dir).selectExpr("*", f"{SCORE_EXPR} AS score")


def sql_scored_songs() -> str:
    return f"(SELECT *, {SCORE_EXPR} AS score FROM {sql_songs()})"


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).selectExpr(*songs_exprs("spark"))


def sql_songs() -> str:
    return (f"(SELECT {', '.join(songs_exprs('duckdb'))} FROM lineitem "
            "JOIN orders ON l_orderkey = o_orderkey)")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*catalog_exprs())


def weekly_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                 "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.selectExpr(*weekly_chart_exprs("spark"))


def yearend_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yearend_from(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


def yearend_from(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    p = part.select("p_partkey", "p_name", "p_brand", "p_type")
    return li.join(p, li.l_partkey == p.p_partkey).selectExpr(*yearend_chart_exprs())


# --- the same roles as DuckDB subqueries -------------------------------------

def sql_catalog() -> str:
    return f"(SELECT {', '.join(catalog_exprs())} FROM part)"


def sql_weekly_chart() -> str:
    return (f"(SELECT {', '.join(weekly_chart_exprs('duckdb'))} FROM lineitem "
            "JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)")


def sql_yearend_chart() -> str:
    return (f"(SELECT {', '.join(yearend_chart_exprs())} FROM lineitem "
            "JOIN part ON l_partkey = p_partkey)")


# --- chart pages ---------------------------------------------------------------
# Pages of some 40 orders each, as HTML, from lineitem x part: a small table before the chart, on some pages a long one
# without chart words; headers in several wordings; cells that span two rows; a table inside a cell; ranks that are no
# numbers; pages whose chart names no artist. What a page holds is said by the same row numbers, so expected rows are SQL.

_PAGE = "CAST(floor(l_orderkey / 40) AS BIGINT)"
_PAGE_ROWS = (f"SELECT {_PAGE} AS page_id, row_number() OVER (PARTITION BY {_PAGE} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn, "
              f"count(*) OVER (PARTITION BY {_PAGE}) AS n, p_name, p_brand, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey")
_ROW_HTML = ("'<tr><td>' || CASE WHEN l_linenumber = 5 THEN 'Tie' ELSE CAST(rn AS STRING) END || '</td><td>\"' || p_name || '\"' || "
             "CASE WHEN page_id % 5 = 1 AND rn = 2 THEN '<table><tr><td>see</td><td>note</td></tr></table>' ELSE '' END || '</td>' || "
             "CASE WHEN page_id % 3 = 0 AND rn % 2 = 0 THEN '' WHEN page_id % 3 = 0 AND rn < n THEN '<td rowspan=\"2\">' || p_brand || ' &amp; Co' "
             "ELSE '<td>' || p_brand || ' &amp; Co' END")
_HEAD_HTML = ("'<html><body><table class=\"infobox\"><tr><th>Year</th><td>' || CAST(1990 + page_id % 30 AS STRING) || '</td></tr></table>' || "
              "CASE WHEN page_id % 4 = 2 THEN '<table><tr><th>Week</th><th>Date</th></tr>' || repeat('<tr><td>w</td><td>d</td></tr>', 60) || '</table>' ELSE '' END || "
              "'<table class=\"wikitable sortable\"><tr><th>' || CASE page_id % 4 WHEN 0 THEN 'No.' WHEN 1 THEN '#' WHEN 2 THEN 'Rank' ELSE 'Pos' END || '</th><th>' || "
              "CASE page_id % 3 WHEN 0 THEN 'Title' WHEN 1 THEN 'Song' ELSE 'Single' END || '</th><th>' || "
              "CASE WHEN page_id % 7 = 3 THEN 'Label' WHEN page_id % 3 = 0 THEN 'Artist(s)' WHEN page_id % 3 = 1 THEN 'Act' ELSE 'Performer' END || '</th></tr>'")


def chart_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, year, html): a page is an aggregate over its own rows, some 160."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    rows = spark.sql(_PAGE_ROWS.replace("lineitem", "{lineitem}").replace("part ON", "{part} ON"), lineitem=li, part=part)
    pages = rows.selectExpr("page_id", "rn", f"{_ROW_HTML} AS html").groupBy("page_id").agg(F.expr("listagg(html, '') WITHIN GROUP (ORDER BY rn)").alias("body"))
    return pages.selectExpr("page_id", "CAST(1990 + page_id % 30 AS INT) AS year", f"{_HEAD_HTML} || body || '</table></body></html>' AS html")


def sql_chart_page_rows() -> str:
    """CTEs p (rows of the pages) and chart (the rows that are to be found)."""
    return (f"p AS ({_PAGE_ROWS}), a AS (SELECT *, CASE WHEN page_id % 3 = 0 AND rn % 2 = 0 THEN lag(p_brand) OVER (PARTITION BY page_id ORDER BY rn) ELSE p_brand END AS lead FROM p), "
            "chart AS (SELECT page_id, CAST(rn AS INTEGER) AS row_no, CAST(rn AS INTEGER) AS rank, '\"' || p_name || '\"' AS title, lead || ' & Co' AS artist, "
            "CAST(1990 + page_id % 30 AS INTEGER) AS year FROM a WHERE l_linenumber <> 5 AND page_id % 7 <> 3 AND (n >= 50 OR page_id % 4 <> 2))")
