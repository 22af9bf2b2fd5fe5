"""Search cascades (C8: J9-J13) and per-year negative sampling (C7: J7, J14, U5,
U6, W8, A21, A23), re-aimed from live search calls to joins on a catalog table.

A strict "search" for a song is the top-k catalog rows of the song's block key
(the reference's result lists hold 5 or 10 tracks). Candidate lists are built
once per block key, not per song, so a popular key costs one ranking, and the
song side joins k rows per key (AQE splits a hot key on the song side). The
loose search by title and artist words scores every track that shares a word
before anything is cut (``artist_search``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as PC
from ..functions import patterns as P
from ..functions import text as TX
from ..operators import dedup as U
from ..operators import linkage as L
from ..operators.sampling import exact_sample
from ..session import materialize

POP_ORDER = [U.desc("popularity"), U.asc("spotify_id")]


def search_index(catalog_raw: DataFrame) -> DataFrame:
    """Catalog tracks with the fields a search matches on: loose title key, lead
    artist key, short artist key, all artist names as text."""
    names = TX.list_items("artists")
    first = F.element_at(names, 1)
    artists = F.array_join(names, " ")
    return catalog_raw.select(
        F.col("id").alias("spotify_id"), F.col("name").alias("track_title"), "popularity",
        PC.to_int("year").alias("year"),
        artists.alias("track_artists"),
        # Word sets once per track, not once per (song, candidate) pair.
        TX.word_set(artists).alias("track_words"), TX.word_set(artists, alnum=True).alias("track_words_an"),
        L.joinable(TX.norm_base("name")).alias("tk"),
        L.joinable(TX.norm(first)).alias("ak"),
        L.joinable(TX.norm(TX.short_artist(first))).alias("sk"))


def song_key(*cols) -> "F.Column":
    """The cleaned chart's unique key (year, rank, title, credit) as one text id."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def songs_to_match(clean: DataFrame) -> DataFrame:
    """Cleaned chart rows (C1) with a song id and their search keys."""
    return clean.select(
        song_key("year", "rank", "title_clean", "artist_clean").alias("song_id"), "year", "rank", "title", "artist",
        "title_clean", "primary_artist", TX.word_set("primary_artist").alias("artist_words"),
        L.joinable(TX.norm_base("title_clean")).alias("tk"),
        L.joinable(TX.norm("primary_artist")).alias("ak"))


def cascade_inputs(catalog_raw: DataFrame, chart_clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Songs and search index written once: every search stage reads them."""
    return (materialize(songs_to_match(chart_clean), "songs"),
            materialize(search_index(catalog_raw), "search_index"))


def unmatched_songs(songs: DataFrame, first: DataFrame) -> DataFrame:
    """Songs the first pass did not match (input of the second pass)."""
    return songs.join(first.filter(F.col("spotify_id").isNull()).select("song_id"), "song_id")


def _results(index: DataFrame, keys, k: int) -> DataFrame:
    cols = list(keys) + ["spotify_id", "popularity", "track_words", "track_words_an"]
    idx = index.select(*cols)
    for c in keys:
        idx = idx.filter(F.col(c).isNotNull())
    return L.top_k_per_key(idx, list(keys), POP_ORDER, k, salt_col="spotify_id")


def artist_search(songs: DataFrame, index: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The loose third search (title and artist words): tracks of a song's title key that share an artist word with it, scored
    by the words of all their artists. One row per song with such a track: song_id, and the best track by (score,
    popularity, id) as ``best`` (spotify_id, score), NULL where none reaches ``threshold``.

    The index is inverted, (title key, artist word) -> track, and no list is cut before scoring. Words are ordered from
    rare to frequent inside a title key; a pair that reaches the threshold shares one of the first |a| - ceil(t |a|) + 1 words of
    either side, so only these are joined, and the very frequent words of a title seldom are. Songs with one title key and one
    set of words are one search; of the tracks with the same title key and words only the most popular can win and is kept.
    """
    # Word lists are sorted, so equal sets are equal texts.
    as_text = lambda c: F.array_join(c, " ")
    asked = songs.where(F.col("tk").isNotNull() & (F.size("artist_words") > 0)).select("song_id", "tk", "artist_words", as_text("artist_words").alias("wkey"))
    searches = asked.select("tk", "artist_words", "wkey").distinct()
    tracks = index.where(F.col("tk").isNotNull() & (F.size("track_words") > 0)).select("tk", "spotify_id", "popularity", "track_words", as_text("track_words").alias("tkey"))
    tracks = U.keep_best(tracks, ["tk", "tkey"], POP_ORDER)
    words = tracks.select("tk", F.explode("track_words").alias("word"))
    frequency = words.groupBy("tk", "word").agg(F.count(F.lit(1)).alias("df"))

    def prefix(df: DataFrame, side: str, own: list[str]) -> DataFrame:
        long = df.select("tk", *own, F.col(side).alias("words"), F.explode(side).alias("word")).join(frequency, ["tk", "word"], "left")
        ranked = long.groupBy("tk", *own).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("of"), F.first("words").alias(side))
        n = F.size(side)
        # Words no track has come first: they cannot be shared, and still count as places of the prefix.
        keep = n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int") + 1
        return ranked.select("tk", *own, side, F.explode(F.slice("of", 1, keep)).alias("_w")).select("tk", *own, side, F.col("_w.word").alias("word"))

    left = prefix(searches, "artist_words", ["wkey"])
    right = prefix(tracks.select("tk", "tkey", "track_words", "spotify_id", "popularity"), "track_words", ["tkey", "spotify_id", "popularity"])
    pairs = left.join(right, ["tk", "word"])
    score = TX.jaccard(F.col("artist_words"), F.col("track_words"))
    pop = F.coalesce(F.col("popularity").cast("double"), F.lit(0.0))
    order = F.struct((-F.col("score")).alias("s"), (-pop).alias("p"), F.col("popularity").isNull().alias("n"), F.col("spotify_id").alias("i"))
    best = (pairs.withColumn("score", score).where(F.col("score") >= F.lit(threshold)).groupBy("tk", "wkey")
            .agg(F.min_by(F.struct("spotify_id", "score"), order).alias("best")))
    # Any shared word makes a result list, whether or not a track passes.
    listed = searches.select("tk", "wkey", F.explode("artist_words").alias("word")).join(frequency, ["tk", "word"], "left_semi").select("tk", "wkey").distinct()
    return asked.join(listed, ["tk", "wkey"]).join(best, ["tk", "wkey"], "left").select("song_id", "best")


def first_pass(songs: DataFrame, index: DataFrame, threshold: float = 0.5, k: int = 5) -> DataFrame:
    """J11 + J9: three searches of decreasing strictness (title+artist+year,
    title+artist, loose title and artist words); the first non-empty result list
    is used even if none of it passes the artist check. One row per song: stage
    used (0 = no results), chosen track (NULL if none qualified) and its score."""
    found = None
    for i, keys in enumerate([["tk", "ak", "year"], ["tk", "ak"]], 1):
        c = songs.select("song_id", "artist_words", *keys).join(_results(index, keys, k), on=keys)
        c = c.select("song_id", "artist_words", "spotify_id", "popularity", "track_words", "cand_pos",
                     F.lit(i).alias("stage"))
        found = c if found is None else found.unionByName(c)
    # A song has at most 2 * k candidate rows. Stage first in the order: the best row is of the first non-empty list.
    scored = found.withColumn("score", TX.jaccard(F.col("artist_words"), F.col("track_words")))
    ok = F.col("score") >= F.lit(threshold)
    pop = F.coalesce(F.col("popularity").cast("double"), F.lit(0.0))
    order = F.struct("stage", (~ok).alias("miss"), (-F.col("score")).alias("s"), (-pop).alias("p"), F.col("cand_pos").alias("pos"))
    strict = scored.groupBy("song_id").agg(
        F.min("stage").alias("stage"),
        F.min_by(F.when(ok, F.struct("spotify_id", "score")), order).alias("best"))
    strict = materialize(strict, "strict_searches")  # read for its songs and for the rest
    rest = songs.join(strict.select("song_id"), "song_id", "left_anti")
    loose = artist_search(rest, index, threshold).select("song_id", F.lit(3).alias("stage"), "best")
    out = songs.select("song_id").join(strict.unionByName(loose), "song_id", "left")
    return out.select("song_id", F.coalesce("stage", F.lit(0)).alias("stage"), F.col("best.spotify_id").alias("spotify_id"),
                      F.col("best.score").alias("score"))


def second_pass(songs: DataFrame, index: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Four passes, each over the songs no earlier pass matched.
    A: title + lead artist (scored, 0.3); B: title + short artist, only when it
    differs from the lead artist; C: title + year, most popular of 10 with
    popularity >= 10; D: title only, same rule. Label "none" otherwise."""
    s = songs.select(
        "song_id", "year",
        L.joinable(TX.norm_base(TX.clean_title_v2("title"))).alias("tk"),
        TX.lead_artist_v2("artist").alias("lead"))
    s = s.withColumn("short", TX.short_artist("lead"))
    s = s.withColumn("ak", L.joinable(TX.norm("lead"))).withColumn("sk", L.joinable(TX.norm("short")))
    s = (s.withColumn("lead_words", TX.word_set("lead", alnum=True))
          .withColumn("short_words", TX.word_set("short", alnum=True)))
    s = materialize(s, "second_pass_songs")  # read by all four passes

    def scored(rem, keys, expected, k):
        c = rem.join(_results(index, keys, k), on=keys)
        c = c.withColumn("score", TX.jaccard(F.col(f"{expected}_words"), F.col("track_words_an")))
        return L.best_candidate(c, "song_id", "score", threshold, "popularity", "cand_pos")

    def popular(rem, keys, k):
        c = rem.join(_results(index, keys, k), on=keys)
        return L.most_popular_candidate(c, "song_id", "popularity", "cand_pos", 10)

    # Each pass's choice for a song does not depend on the earlier passes (they
    # only decide whether the song is still open), so every pass runs over all
    # songs and one aggregate keeps the first pass that matched. No pass is
    # re-evaluated inside the next one's anti-join.
    a = scored(s, ["tk", "ak"], "lead", 5).select("song_id", "spotify_id", F.lit(1).alias("pass_no"))
    b = scored(s.filter(F.col("short") != F.col("lead")), ["tk", "sk"], "short", 5) \
        .select("song_id", "spotify_id", F.lit(2).alias("pass_no"))
    c = popular(s, ["tk", "year"], 10).select("song_id", "spotify_id", F.lit(3).alias("pass_no"))
    d = popular(s, ["tk"], 10).select("song_id", "spotify_id", F.lit(4).alias("pass_no"))
    first = (a.unionByName(b).unionByName(c).unionByName(d).groupBy("song_id")
              .agg(F.min("pass_no").alias("pass_no"), F.min_by("spotify_id", "pass_no").alias("spotify_id")))
    # Not element_at: on the left join's missing pass number its generated code gives the last label.
    label = F.when(F.col("pass_no") == 1, PASS_LABELS[0])
    for i, name in enumerate(PASS_LABELS[1:], 2):
        label = label.when(F.col("pass_no") == i, name)
    out = s.select("song_id").join(first, "song_id", "left")
    return out.select("song_id", "spotify_id", F.coalesce(label, F.lit("none")).alias("pass"))


PASS_LABELS = ["A", "B", "C", "D"]


def query_plan(target_years: DataFrame, year_col: str = "year") -> DataFrame:
    """Per target year, each search term for release years Y, Y-1, Y-2
    (30 queries per year, in the reference's order)."""
    terms = F.array(*[F.lit(t) for t in P.SEARCH_TERMS])
    y = target_years.select(F.col(year_col).alias("target_year")).distinct()
    y = y.select("target_year", F.posexplode(F.sequence(F.col("target_year"), F.col("target_year") - 2, F.lit(-1)))
                 .alias("year_no", "release_year"))
    y = y.select("target_year", "release_year", "year_no", F.posexplode(terms).alias("term_no", "term"))
    return y.select("target_year", "release_year", "term",
                    (F.col("year_no") * len(P.SEARCH_TERMS) + F.col("term_no")).alias("query_no"),
                    F.concat(F.col("term"), F.lit(" year:"), F.col("release_year").cast("string")).alias("query"))


def negative_pool(catalog_raw: DataFrame, chart_clean: DataFrame) -> DataFrame:
    """C7 up to the overlap removal: each catalog track is a candidate for the
    chart years its release year falls in (Y-2..Y), collected at its first target
    year only (U6, before cleaning), cleaned (P14, P4, P15), deduplicated by id
    then by (title, lead artist) (U5), and removed when it is on that year's
    chart (J7)."""
    years = chart_clean.select(F.col("year").alias("target_year")).filter(F.col("target_year").isNotNull()).distinct()
    c = catalog_raw.select(
        F.col("id").alias("spotify_id"), F.col("name").alias("title"), "popularity", "release_date",
        TX.light_clean("name").alias("title_clean"),
        TX.strip(TX.lead_artist(TX.light_clean(F.array_join(TX.list_items("artists"), ", ")))).alias("primary_artist"),
        PC.year_prefix("release_date").alias("release_year"))
    c = c.withColumn("target_year", F.explode(F.sequence(F.col("release_year"), F.col("release_year") + 2)))
    # Chart years are one row per year: a bounded broadcast.
    c = c.join(F.broadcast(years), "target_year")
    c = c.withColumn("query_no", F.col("target_year") - F.col("release_year"))
    c = U.first_seen(c, "spotify_id", [U.asc("target_year"), U.asc("query_no"), U.desc("popularity"),
                                       U.asc("spotify_id")])
    c = c.filter(PC.non_empty("spotify_id") & PC.non_empty("title_clean") & PC.non_empty("primary_artist"))
    c = c.filter(PC.in_trailing_window("release_year", "target_year"))
    c = U.keep_best(c, ["target_year", "title_clean", "primary_artist"], [U.asc("query_no"), U.desc("popularity"),
                                                                          U.asc("spotify_id")])
    chart_keys = chart_clean.select(F.col("year").alias("target_year"),
                                    F.lower(TX.strip("title_clean")).alias("k1"),
                                    F.lower(TX.strip("primary_artist")).alias("k2"))
    out = L.anti_join(c, chart_keys, ["target_year", F.lower(TX.strip("title_clean")), F.lower(TX.strip("primary_artist"))],
                      ["target_year", "k1", "k2"])
    return materialize(out, "negative_pool")  # sampling reads it for its counts and for its rows


def sample_per_year(pool: DataFrame, n: int = 400, seed: int = 42) -> DataFrame:
    """Up to n negatives per target year, repeatable."""
    return exact_sample(pool, n, key="spotify_id", seed=seed, by=["target_year"], few_groups=True)


def year_status(sampled: DataFrame, target: int = 400, minimum: int = 350) -> DataFrame:
    """Per-year count and status against the target and minimum."""
    n = sampled.groupBy("target_year").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("status", F.when(F.col("n") >= target, "ok")
                        .when(F.col("n") >= minimum, "below_target").otherwise("below_minimum"))
