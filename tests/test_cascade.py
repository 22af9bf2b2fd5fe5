"""The loose third search and the cascades' labels."""

import random

import pytest

from hitlink.operators import linkage as L
from hitlink.plans import cascade as CS

SONGS = "song_id string, year int, rank int, title string, artist string, title_clean string, primary_artist string, artist_words array<string>, tk string, ak string"
INDEX = ("spotify_id string, track_title string, popularity int, year int, track_artists string, track_words array<string>, track_words_an array<string>, "
         "tk string, ak string, sk string")


def song(i, tk, artist, ak=None, year=2000):
    words = sorted(set(artist.split()))
    return (i, year, 1, tk, artist, tk, artist, words, tk, ak or artist.replace(" ", ""))


def track(i, tk, artists, pop, ak="other", year=1990):
    words = sorted(set(artists.split()))
    return (i, tk, pop, year, artists, words, words, tk, ak, ak)


def test_the_sixth_most_popular_namesake_is_found(spark):
    """Twenty tracks of the title are more popular than the right one; only its artist matches."""
    index = spark.createDataFrame([track(f"p{k}", "hello", f"singer{k} star", 90 - k) for k in range(20)] + [track("right", "hello", "adele band", 3)], INDEX)
    songs = spark.createDataFrame([song("s", "hello", "adele"), song("t", "hello", "nobody"), song("u", "unheard", "adele"), song("v", "hello", "star unknown one")], SONGS)
    got = {r.song_id: (r.stage, r.spotify_id, r.score) for r in CS.first_pass(songs, index).collect()}
    assert got == {"s": (3, "right", 0.5), "t": (0, None, None), "u": (0, None, None), "v": (3, None, None)}


def plain_loose(songs, index, threshold):
    out = {}
    for s in songs:
        near = [t for t in index if t[7] == s[8] and set(t[5]) & set(s[7])]
        if near:
            score = lambda t: len(set(t[5]) & set(s[7])) / len(set(t[5]) | set(s[7]))
            best = min(near, key=lambda t: (-score(t), -(t[2] or 0), t[2] is None, t[0]))
            out[s[0]] = (best[0], round(score(best), 9)) if score(best) >= threshold else None
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_loose_search_is_exact(spark, threshold):
    """Against every pair, with a title that holds most rows and a word that nearly all artists have."""
    rng = random.Random(7)
    words = ["band"] + [f"w{k}" for k in range(12)]
    pick = lambda: " ".join(rng.sample(words, rng.randrange(1, 5)) + (["band"] if rng.random() < 0.7 else []))
    title = lambda: rng.choice(["hot", "hot", "hot", "cold", "mild"])
    index = [track(f"t{k:03}", title(), pick(), rng.choice([None, 0, 5, 50])) for k in range(250)]
    songs = [song(f"s{k:03}", title(), pick()) for k in range(150)] + [song("none", "hot", "zz"), ("null", 1, 1, None, None, None, None, [], None, None)]
    rows = CS.artist_search(spark.createDataFrame(songs, SONGS).repartition(3), spark.createDataFrame(index, INDEX).repartition(3), threshold).collect()
    got = {r.song_id: None if r.best is None else (r.best.spotify_id, round(r.best.score, 9)) for r in rows}
    assert got == plain_loose(songs, index, threshold)


def test_strict_lists_come_first_even_without_a_match(spark):
    index = spark.createDataFrame([track("strict", "hello", "wrong people", 5, ak="adele"), track("loose", "hello", "adele", 90)], INDEX)
    got = CS.first_pass(spark.createDataFrame([song("s", "hello", "adele")], SONGS), index).first()
    assert (got.stage, got.spotify_id) == (2, None)


def test_matched_split_counts_evaluates_the_link_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    source = spark.range(10)
    linked = source.mapInArrow(note, "id long").selectExpr("id", "CASE WHEN id < 3 THEN id END AS hit")
    got = {r.status: r.n for r in L.matched_split_counts(linked, source, "hit").collect()}
    assert got == {"matched": 3, "unmatched": 7} and seen.value == 10
    with pytest.raises(AssertionError):
        L.matched_split_counts(linked.where("id > 0"), source, "hit")
