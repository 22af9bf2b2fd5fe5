"""Text-function queries (T1-T17). Free text comes from ``documents.text`` (whole
documents, four languages) and ``conversations.text``; chart-shaped text from the
year-end chart and catalog roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from . import fixtures as FX
from . import oracle_text as OT
from .registry import register


def _docs(spark, sf_dir):
    return FX.table(spark, sf_dir, "documents").select("doc_id", "text")


def _doc_query(name: str, fn, sql_fn):
    @register(name, f"SELECT doc_id, {sql_fn('text')} AS out FROM documents")
    def q(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", fn(F.col("text")).alias("out"))
    return q


_YE = FX.sql_yearend_chart()


def _chart_query(name: str, col: str, fn, sql_fn):
    @register(name, f"SELECT src_order, src_line, {col}, {sql_fn(col)} AS out FROM {_YE}")
    def q(spark, sf_dir):
        return FX.yearend_chart(spark, sf_dir).select("src_order", "src_line", col, fn(F.col(col)).alias("out"))
    return q


_doc_query("text_t1_strip", TX.strip, OT.strip)
_chart_query("text_t2_strip_quotes_v1", "title", TX.strip_quotes_v1, OT.strip_quotes_v1)
_doc_query("text_t2_strip_quotes_v1_docs", TX.strip_quotes_v1, OT.strip_quotes_v1)
_chart_query("text_t3_strip_quotes_v2", "title", TX.strip_quotes_v2, OT.strip_quotes_v2)
_doc_query("text_t4_punctuation_noise", TX.punctuation_noise, OT.punctuation_noise)
_chart_query("text_t4_punctuation_noise_titles", "title", TX.punctuation_noise, OT.punctuation_noise)
_chart_query("text_t5_clean_title", "title", TX.clean_title_v1, OT.clean_title_v1)
_chart_query("text_t5_clean_title_reference", "title",
             lambda c: TX.clean_title_v1(c, reference=True), lambda x: OT.clean_title_v1(x, reference=True))
_chart_query("text_t6_clean_title_v2", "title", TX.clean_title_v2, OT.clean_title_v2)
_chart_query("text_t7_clean_artist", "artist", TX.clean_artist, OT.clean_artist)
_doc_query("text_t8_light_clean", TX.light_clean, OT.light_clean)
_chart_query("text_t9_lead_artist", "artist", lambda c: TX.lead_artist(TX.clean_artist(c)),
             lambda x: OT.lead_artist(OT.clean_artist(x)))
_chart_query("text_t9_lead_artist_reference", "artist",
             lambda c: TX.lead_artist(TX.clean_artist(c), reference=True),
             lambda x: OT.lead_artist(OT.clean_artist(x), reference=True))
_doc_query("text_t9_lead_artist_docs", TX.lead_artist, OT.lead_artist)
_chart_query("text_t10_lead_artist_v2", "artist", TX.lead_artist_v2, OT.lead_artist_v2)
_chart_query("text_t11_short_artist", "artist", lambda c: TX.short_artist(TX.lead_artist_v2(c)),
             lambda x: OT.short_artist(OT.lead_artist_v2(x)))
_doc_query("text_t11_short_artist_docs", TX.short_artist, OT.short_artist)
_doc_query("text_t12_norm", TX.norm, OT.norm)
_doc_query("text_t12_norm_reference", lambda c: TX.norm(c, reference=True), lambda x: OT.norm(x, reference=True))
_doc_query("text_t13_norm_base", TX.norm_base, OT.norm_base)
_chart_query("text_t13_norm_base_titles", "title", TX.norm_base, OT.norm_base)


@register("text_t14_first_list_item",
          f"SELECT id, artists, {OT.first_list_item('artists')} AS out FROM {FX.sql_catalog()}")
def text_t14(spark, sf_dir):
    return FX.catalog(spark, sf_dir).select("id", "artists", TX.first_list_item("artists").alias("out"))


@register("text_t15_word_set",
          f"SELECT doc_id, array_to_string({OT.word_set('text')}, ' ') AS words, "
          f"len({OT.word_set('text')}) AS n_words, array_to_string({OT.word_set('text', alnum=True)}, ' ') AS words_alnum "
          "FROM documents")
def text_t15(spark, sf_dir):
    d = _docs(spark, sf_dir)
    ws = TX.word_set("text")
    return d.select("doc_id", F.array_join(ws, " ").alias("words"), F.size(ws).alias("n_words"),
                    F.array_join(TX.word_set("text", alnum=True), " ").alias("words_alnum"))


@register("text_t16_jaccard_turns",
          "SELECT a.conv_id, a.turn, round(" + OT.jaccard(OT.word_set("a.text"), OT.word_set("b.text")) + ", 6) AS sim, "
          "round(" + OT.jaccard(OT.word_set("a.text", True), OT.word_set("b.text", True)) + ", 6) AS sim_alnum "
          "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def text_t16(spark, sf_dir):
    c = FX.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return j.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"),
                    F.round(TX.artist_similarity(F.col("a.text"), F.col("b.text")), 6).alias("sim"),
                    F.round(TX.artist_similarity(F.col("a.text"), F.col("b.text"), alnum=True), 6).alias("sim_alnum"))


@register("text_t16_jaccard_artists",
          "SELECT src_order, src_line, round(" + OT.jaccard(OT.word_set(OT.lead_artist(OT.clean_artist("artist"))),
                                                            OT.word_set("artist")) + ", 6) AS sim "
          f"FROM {_YE}")
def text_t16b(spark, sf_dir):
    y = FX.yearend_chart(spark, sf_dir)
    return y.select("src_order", "src_line",
                    F.round(TX.artist_similarity(TX.lead_artist(TX.clean_artist("artist")), F.col("artist")), 6).alias("sim"))


@register("text_t17_identity_key",
          "SELECT src_order, src_line, " + OT.canonical_number_text("year") + " AS k_year, "
          + OT.canonical_number_text("rank") + " AS k_rank, "
          + f"lower({OT.strip('coalesce(' + OT.clean_title_v1('title') + ', title)')}) AS k_title, "
          + f"lower({OT.strip('coalesce(' + OT.lead_artist(OT.clean_artist('artist')) + ', artist)')}) AS k_artist "
          f"FROM {_YE}")
def text_t17(spark, sf_dir):
    y = FX.yearend_chart(spark, sf_dir)
    k = TX.identity_key("year", "rank", TX.clean_title_v1("title"), "title",
                        TX.lead_artist(TX.clean_artist("artist")), "artist")
    return y.select("src_order", "src_line", k.alias("k")).select("src_order", "src_line", "k.*")
