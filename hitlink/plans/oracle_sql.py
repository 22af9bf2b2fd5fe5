"""Shared DuckDB CTE text for the oracle queries (the same roles and keys as the
Spark plans, written independently as SQL window/aggregate queries)."""

from __future__ import annotations

from . import fixtures as FX
from . import oracle_text as OT

AUDIO = FX.AUDIO_COLS
A_LIST = ", ".join(AUDIO)


def _dedup(src: str, part: str, order: str) -> str:
    return (f"(SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY {part} "
            f"ORDER BY {order}) AS _rn FROM {src}) WHERE _rn = 1)")


def catalog_ctes() -> str:
    """cat_k: keyed catalog; cat_d: deduplicated (empty keys isolated); cat_b: base lookup."""
    empty = "(nt IS NULL OR nt = '' OR na IS NULL OR na = '')"
    return f"""
cat_raw AS {FX.sql_catalog()},
cat AS (SELECT id AS spotify_id, name AS title, artists,
               CAST(TRY_CAST(TRY_CAST(CAST(year AS VARCHAR) AS DOUBLE) AS INTEGER) AS INTEGER) AS year,
               popularity, explicit, duration_ms, release_date, {A_LIST},
               {OT.first_list_item('artists')} AS primary_artist FROM cat_raw),
cat_k AS (SELECT *, {OT.norm('title', role='title')} AS nt, {OT.norm_base('title', role='title')} AS ntb,
                 {OT.norm('primary_artist', role='artist')} AS na FROM cat),
cat_d AS ({_dedup(f"(SELECT * FROM cat_k WHERE NOT {empty})", "nt, na",
                   "popularity DESC NULLS LAST, spotify_id")}
          UNION ALL SELECT * FROM cat_k WHERE {empty}),
cat_b AS {_dedup("cat_d", "ntb, na", "popularity DESC NULLS LAST, spotify_id")}"""


def chart_ctes() -> str:
    """hk: deduplicated, keyed weekly chart (the hits)."""
    return f"""
wk AS {FX.sql_weekly_chart()},
wk_d AS {_dedup("wk", "title, performer",
                "peak_pos ASC NULLS LAST, chart_week ASC NULLS LAST, entry_order, entry_line, entry_part, entry_supp")},
hk AS (SELECT CAST(year(TRY_CAST(chart_week AS TIMESTAMP)) AS INTEGER) AS year, chart_week,
              current_week AS peak_rank, title, performer AS artist, peak_pos, wks_on_chart,
              entry_order, entry_line,
              {OT.norm('title', role='title')} AS nt, {OT.norm_base('title', role='title')} AS ntb,
              {OT.norm('performer', role='artist')} AS na FROM wk_d)"""


PAYLOAD = ["spotify_id", "popularity", "explicit", "duration_ms", "release_date"] + AUDIO


def linked_cte() -> str:
    pay = ",\n       ".join(f"CASE WHEN e.nt IS NOT NULL THEN e.{c} ELSE b.{c} END AS {c}" for c in PAYLOAD)
    return f"""
linked AS (
SELECT h.*, {pay},
       CASE WHEN e.nt IS NOT NULL THEN 'exact' WHEN b.ntb IS NOT NULL THEN 'base' ELSE 'none' END AS match_pass
FROM hk h
LEFT JOIN cat_d e ON NULLIF(h.nt, '') = e.nt AND NULLIF(h.na, '') = e.na
LEFT JOIN cat_b b ON NULLIF(h.ntb, '') = b.ntb AND NULLIF(h.na, '') = b.na)"""


def expanded_ctes(seed: int = 42) -> str:
    """ds: the imputed expanded dataset (C4)."""
    pay = ", ".join(PAYLOAD)
    med = ", ".join(f"median({c}) AS m_{c}" for c in AUDIO)
    fill = ",\n  ".join(
        f"CASE WHEN NOT u.audio_features_available THEN (CASE WHEN ym.year IS NOT NULL THEN ym.m_{c} "
        f"ELSE gm.m_{c} END) ELSE u.{c} END AS {c}" for c in AUDIO)
    return f"""{catalog_ctes()},{chart_ctes()},{linked_cte()},
hitkeys AS (SELECT DISTINCT NULLIF(nt, '') AS k1, NULLIF(na, '') AS k2 FROM hk
            UNION SELECT DISTINCT NULLIF(ntb, ''), NULLIF(na, '') FROM hk),
nonhits AS (SELECT * FROM cat_d c
            WHERE NOT EXISTS (SELECT 1 FROM hitkeys k WHERE k.k1 = c.nt AND k.k2 = c.na)
              AND NOT EXISTS (SELECT 1 FROM hitkeys k WHERE k.k1 = c.ntb AND k.k2 = c.na)),
neg AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (ORDER BY md5(spotify_id || '|{seed}'), spotify_id) AS _rn
        FROM nonhits) WHERE _rn <= (SELECT count(*) FROM hk)),
u AS (
  SELECT 1 AS label, year, title, artist, peak_rank, peak_pos, wks_on_chart, {pay},
         match_pass <> 'none' AS audio_features_available, match_pass FROM linked
  UNION ALL
  SELECT 0, year, title, primary_artist, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER),
         {pay}, TRUE, CAST(NULL AS VARCHAR) FROM neg),
ym AS (SELECT year, {med} FROM u WHERE audio_features_available AND year IS NOT NULL GROUP BY year),
gm AS (SELECT {med} FROM u WHERE audio_features_available),
ds AS (
SELECT u.label, u.year, u.title, u.artist, u.peak_rank, u.peak_pos, u.wks_on_chart, u.spotify_id, u.popularity,
  u.explicit, u.duration_ms, u.release_date,
  {fill},
  TRUE AS audio_features_available, NOT u.audio_features_available AS features_imputed, u.match_pass
FROM u LEFT JOIN ym ON u.year = ym.year CROSS JOIN gm)"""
