"""HTML tables, nested records, CSV escapes, incremental runs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from hitlink.sources import html_tables as HT
from hitlink.sources import io as IO
from hitlink.sources import records as RC
from hitlink.streaming import incremental as INC


def _table(n, header, cls="wikitable"):
    rows = "".join(f"<tr><td>{i}</td><td>\"Song {i}\"</td><td>Artist {i}</td></tr>" for i in range(1, n + 1))
    return f"<table class='{cls}'><tr>{''.join(f'<th>{h}</th>' for h in header)}</tr>{rows}</table>"


def test_html_table_choice_and_headers(spark):
    page1 = _table(3, ["a", "b", "c"], cls="other") + _table(60, ["No.", "Title", "Artist(s)"])
    page2 = _table(10, ["Pos", "Song", "Performer"])  # < 50 rows: the largest wikitable
    page3 = "<p>no tables</p>"
    pages = spark.createDataFrame([(1, page1), (2, page2), (3, page3)], "page_id long, html string")
    rows = HT.chart_rows(pages).collect()
    by_page = {}
    for r in rows:
        by_page.setdefault(r.page_id, []).append(r)
    assert len(by_page[1]) == 60 and len(by_page[2]) == 10 and 3 not in by_page
    first = sorted(by_page[1], key=lambda r: r.rank)[0]
    assert (first.rank, first.title, first.artist) == (1, '"Song 1"', "Artist 1")


def test_header_whole_word_first(spark):
    df = spark.createDataFrame([("Notes",), ("No.",), ("Artist(s)",)], "h string")
    ours = [r[0] for r in df.select(HT.map_header(F.col("h"))).collect()]
    ref = [r[0] for r in df.select(HT.map_header(F.col("h"), whole_word_first=False)).collect()]
    assert ref[0] == "rank" and ours[1] == "rank" and ours[2] == "artist"


def test_csv_doubled_quotes(spark):
    d = tempfile.mkdtemp(prefix="hitlink-test-")
    p = os.path.join(d, "f.csv")
    with open(p, "w") as f:
        f.write('year,rank,title,artist\n2015,1,"""Replay""",Iyaz\n')
    r = IO.read_csv(spark, p, IO.YEAR_END_RAW).first()
    assert r.title == '"Replay"'
    assert IO.read_optional(spark, os.path.join(d, "missing"), IO.YEAR_END_RAW, "csv").count() == 0


def test_track_flatten(spark):
    js = ('{"id":"t1","name":"N","popularity":5,"explicit":true,"album":{"name":"A","album_type":"single",'
          '"release_date":"2001-02","release_date_precision":"month"},"artists":[{"name":"X"},{"name":"Y"}],'
          '"external_ids":{"isrc":"I"},"external_urls":{"spotify":"u"}}')
    df = spark.createDataFrame([(js,)], "j string")
    r = df.select(*RC.flatten_track("j", label=0)).first()
    assert (r.spotify_id, r.spotify_artist, r.spotify_album, r.isrc, r.label) == ("t1", "X, Y", "A", "I", 0)
    f = spark.createDataFrame([('{"id":"t1","tempo":120.5}',), (None,)], "j string").select(*RC.feature_record("j"))
    rows = f.collect()
    assert rows[0].tempo == 120.5 and rows[0].audio_features_available and not rows[1].audio_features_available


def test_streaming_incremental_is_idempotent(spark):
    src = tempfile.mkdtemp(prefix="hitlink-src-")
    base = tempfile.mkdtemp(prefix="hitlink-out-")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    sink, ckpt = os.path.join(base, "sink"), os.path.join(base, "ckpt")

    def run():
        return INC.run_incremental(spark, src, schema, lambda b: b, ["k"], sink=sink, checkpoint=ckpt)

    run()
    assert spark.read.parquet(sink).count() == 2
    spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string").write.mode("append").parquet(src)
    run()
    got = sorted(r.k for r in spark.read.parquet(sink).collect())
    assert got == [1, 2, 3]
    # A replayed batch adds nothing.
    INC.append_new_keys(spark, spark.createDataFrame([(3, "c")], "k int, v string"), sink, ["k"])
    assert spark.read.parquet(sink).count() == 3


@pytest.mark.parametrize("html,rows", [
    ("<table><tr><th>No.<th>Title<tr><td>1<td>A <b>b</b><tr><td>2<td>C</table>", [["No.", "Title"], ["1", "A b"], ["2", "C"]]),
    ("<table><tr><td>1<table><tr><td>in</table></td><td>x</td></tr></table>", [["in"], ["1", "x"]]),
    ("<table><tr><td rowspan=2>1</td><td>a</td></tr><tr><td>b</td></tr><tr><td colspan=2>c</td></tr></table>", [["1", "a"], ["1", "b"], ["c", "c"]]),
    ("<table><tr><td>a</td><td rowspan='3'>z<tr><td>b<tr><td>c", [["a", "z"], ["b", "z"], ["c", "z"]]),
    ("<p>none</p>", []), (None, [])])
def test_tables_with_nesting_spans_and_implied_ends(html, rows):
    assert [r[4] for r in HT.page_tables(html)] == rows


def test_chart_rows_with_a_year(spark):
    body = "".join(f"<tr><td>{k}<td>Song {k}<td>Artist {k}" for k in range(1, 61))
    page = f"<table class=nav><tr><td>x</table><table class='wikitable sortable'><tr><th>No.<th>Title<th>Artist{body}</table>"
    pages = spark.createDataFrame([(7, page, 1999)], "page_id long, html string, y int")
    out = HT.chart_rows(pages, "y").collect()
    assert len(out) == 60 and {r.year for r in out} == {1999} and ("Song 3", "Artist 3") in {(r.title, r.artist) for r in out}


def test_tables_are_chosen_without_their_bodies(spark):
    """A page's table is one row, and the choice reads counts and headers alone, each header mapped once a table."""
    page = "<table><tr><th>Week</th></tr><tr><td>1</td></tr></table>" + _table(60, ["No.", "Title", "Artist(s)"]) + "<table></table>"
    page += "<table class='wikitable'><tr><td>x<table><tr><td>in</table></td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, _table(3, ["Pos", "Song", "Act"]))], "page_id long, html string")
    tables = HT.materialize(HT.page_table_rows(pages), "page_tables")
    got = {(r.page_id, r.table_no): (r.n_data, r.n_rows, r.header, r.head) for r in tables.collect()}
    assert got == {(1, 0): (1, 2, "Week", ["Week"]), (1, 1): (60, 61, "No. Title Artist(s)", ["No.", "Title", "Artist(s)"]), (1, 3): (1, 1, None, None),
                   (1, 4): (1, 1, None, None), (3, 0): (3, 4, "Pos Song Act", ["Pos", "Song", "Act"])}
    choice = HT.choose_tables(tables)
    assert {(r.page_id, r.table_no) for r in choice.collect()} == {(1, 1), (3, 0)}
    assert "body" not in choice._jdf.queryExecution().executedPlan().toString()
    rows = HT.chart_rows(pages, tables=tables).collect()
    assert len(rows) == 63 and {(r.page_id, r.row_no, r.rank) for r in rows} == {(1, k, k) for k in range(1, 61)} | {(3, k, k) for k in range(1, 4)}


def test_plain_tags_are_read_as_the_standard_parser_reads_them():
    import random
    rng = random.Random(5)
    pieces = ["<table>", "<TABLE class='wikitable x'>", "</table>", "<tr>", "</tr >", "<td>", "<th>", "</td>", "</th\n>", "<td colspan=2>", '<td rowspan="3" id=x>',
              "<td colspan='2' COLSPAN=1>", "<td colspan=2/>", "<td/>", "<br>", "<br/>", "<br />", "<b>", "</b>", "a &amp; b", "&lt", "&#65;", "&", " x ", "<", ">", "< td>", "</ td>", "<td", "<!-- <td>no -->",
              "<!doctype html>", "<!>", "<!--->", "<?php <td> ?>", "<script>if (a<b) '<td>'</script>", "<style>", "</style>", "<title>a<td></title>", "<textarea><tr>", "</textarea>", "<td title='a>b'>",
              "<td title=\"&quot;\" rowspan=2>", "<td rowspan = 2>", "</td x=1>", "<a href=/x?a=1&b=2>", "<td class>", "<thead>", "</tbody>", "<td\tcolspan=3\n>", "<td a='1'b='2'>", "é\xa0ﬁ", "<é>", "<td-x>", "<p/ >"]
    for _ in range(6000):
        html = "<table><tr><td>" * rng.randrange(2) + "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        whole = HT._Tables()
        whole.feed(html)
        whole.close()
        assert HT.page_tables(html) == whole.rows, html
