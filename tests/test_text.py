"""Table-driven checks of the text functions (default and reference modes)."""

import pytest
from pyspark.sql import functions as F

from hitlink.functions import text as TX

NBSP, LS = " ", " "


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_strip_unicode_whitespace(spark):
    assert run(spark, TX.strip, [f"{NBSP} a b {LS}", "\t\r\nx\x1c", "", None]) == ["a b", "x", "", None]


def test_strip_quotes_v1_keeps_apostrophes(spark):
    got = run(spark, TX.strip_quotes_v1, ['"Tik Tok"', "“Blinding Lights”", "'Hello'", '"""Replay"""'])
    assert got == ["Tik Tok", "Blinding Lights", "'Hello'", "Replay"]


def test_strip_quotes_v2_all_five(spark):
    assert run(spark, TX.strip_quotes_v2, ["’x‘", '"“y”"']) == ["x", "y"]


def test_punctuation_noise(spark):
    got = run(spark, TX.punctuation_noise, ["wait... a$$ ok!!", "Song[1] | x", "a [note 2]b", "--x--"])
    assert got == ["wait. a$ ok!", "Song  x", "a b", "-x-"]


def test_clean_title_footnote_order(spark):
    # Ours removes the footnote first; the reference strips quotes first and keeps one.
    assert run(spark, TX.clean_title_v1, ["“Hello”[1]"]) == ["hello"]
    assert run(spark, lambda c: TX.clean_title_v1(c, reference=True), ["“Hello”[1]"]) == ["hello”"]


@pytest.mark.parametrize("credit,ours,ref", [
    ("daft punk featuring x", "daft punk", "da"),
    ("taylor swift featuring y", "taylor swift", "taylor swi"),
    ("swift ft. y", "swift", "swi"),
    ("a & b", "a", "a"),
    ("soft kiss", "soft kiss", "so"),
    ("solo", "solo", "solo"),
])
def test_lead_artist_word_boundary(spark, credit, ours, ref):
    assert run(spark, TX.lead_artist, [credit]) == [ours]
    assert run(spark, lambda c: TX.lead_artist(c, reference=True), [credit]) == [ref]


def test_lead_artist_v2_and_short(spark):
    got = run(spark, TX.lead_artist_v2, ["Macklemore & Ryan Lewis", "A, B and C", "X feat. Y"])
    assert got == ["macklemore", "a", "x"]
    assert run(spark, TX.short_artist, ["dj khaled", "mike will made-it", "one", ""]) == ["dj khaled", "mike", "one", ""]


def test_norm_keys(spark):
    vals = ["Stay With Me", "Song (Live) [2009]", "Name - Radio Edit", "x-y", "Song Remix", "Club",
            "live live", "Café Olé", "你好", None]
    assert run(spark, lambda c: TX.norm(c, role="title"), vals) == [
        "stay with me", "song live 2009", "name  radio edit", "xy", "song remix", "club", "live live", "caf ol",
        "", None]
    assert run(spark, TX.norm_base, vals) == [
        "stay with me", "song", "name", "xy", "song", "club", "live", "caf ol", "", None]
    # The reference cuts titles at "with".
    assert run(spark, lambda c: TX.norm(c, role="title", reference=True), ["Stay With Me"]) == ["stay"]


def test_first_list_item(spark):
    vals = ["['Ann Lee', 'Bo']", '["O\'Neil"]', "[]", "not a list", "['It\\'s']", None]
    assert run(spark, TX.first_list_item, vals) == ["Ann Lee", "O'Neil", "[]", "not a list", "It's", None]


def test_word_set_and_jaccard(spark):
    df = spark.createDataFrame([("The Weeknd feat. Daft Punk", "weeknd daft punk"), ("", "x"),
                                ("2 chainz", "2 chainz")], "a string, b string")
    rows = df.select(TX.artist_similarity("a", "b").alias("j"),
                     TX.artist_similarity("a", "b", alnum=True).alias("j2")).collect()
    assert [r.j for r in rows] == [1.0, 0.0, 1.0]
    assert [r.j2 for r in rows] == [1.0, 0.0, 1.0]
    assert run(spark, lambda c: F.array_join(TX.word_set(c), " "), ["The A-Team of Rock"]) == ["rock team"]


def test_identity_key_canonical_numbers(spark):
    df = spark.createDataFrame([("21.0", "5", " T ", None, "Ann", None)], "y string, r string, tc string, t string, pa string, a string")
    k = df.select(TX.identity_key("y", "r", "tc", "t", "pa", "a").alias("k")).first().k
    assert (k.k_year, k.k_rank, k.k_title, k.k_artist) == ("21", "5", "t", "ann")


@pytest.mark.parametrize("text,title_key,lead", [
    ("Umbrella (feat. Jay-Z)", "umbrella", "umbrella"), ("Umbrella [ft. Jay-Z]", "umbrella", "umbrella"),
    ("Umbrella (with Jay-Z)", "umbrella", "umbrella"), ("x ft. y", "x", "x"), ("soft kiss", "soft kiss", "soft kiss"),
    ("stay with me", "stay with me", "stay"), ("Daft Punk featuring X", "daft punk", "daft punk"), ("feature film", "feature film", "feature film")])
def test_featuring_clause_literal_values(spark, text, title_key, lead):
    row = spark.createDataFrame([(text,)], "t string").select(
        TX.norm("t", role="title").alias("key"), F.lower(TX.lead_artist("t")).alias("lead"), TX.lead_artist_v2("t").alias("lead2")).first()
    assert (row.key, row.lead, row.lead2) == (title_key, lead, lead)


def test_quotes_and_noise_without_regex_passes(spark):
    """T2 trims character sets and T4 drops footnotes and pipes in one pass: same texts as by the patterns one after another."""
    import random

    from hitlink.functions import patterns as P
    rng, parts = random.Random(1), ['"', "\u201c", "\u2018", "\u201d", "\u2019", "\n", " ", "a", "|", "[1]", "[", "x]", "!", "!!", "\xa0"]
    df = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randrange(9))),) for _ in range(3000)] + [(None,)], "t string")
    quotes = TX.strip(F.regexp_replace("t", f"^{P.quote_class(P.QUOTES_LEAD_V1)}+|{P.quote_class(P.QUOTES_TRAIL_V1)}+{P.END}", ""))
    noise = F.regexp_replace(F.regexp_replace("t", P.FOOTNOTE, ""), P.PIPE, "")
    noise = TX.strip(F.regexp_replace(noise, f"({P.NOT_WORD_NOT_SPACE})\\1+", "$1"))
    out = df.select("t", quotes.alias("a"), TX.strip_quotes_v1("t").alias("b"), noise.alias("c"), TX.punctuation_noise("t").alias("d"))
    assert out.where("NOT (a <=> b AND c <=> d)").count() == 0
    plan = out.select("b", "d")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2
