"""The driver contract, and a sample of queries against DuckDB at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry_profile(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0].total == rows[0].positives + rows[0].negatives


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 100


@pytest.mark.parametrize("name", ["pipe_c4_expanded_dataset", "link_j9_j11_first_pass", "text_t13_norm_base",
                                  "agg_a13_correlation_matrix", "sample_w8_exact_n_per_group", "eval_m14_roc_points",
                                  "pipe_c7_negatives_by_year", "rank_w2_global_rank"])
def test_query_matches_oracle(spark, small_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    df = E.queries()[name](spark, small_dir)
    got = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in
                  df.select(*sorted(df.columns)).collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    want = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in
                   con.sql(f"SELECT {', '.join(sorted(rel.columns))} FROM ({E.oracle_sql()[name]})").fetchall()),
                  key=repr)
    assert got == want
