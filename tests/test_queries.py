"""Registered queries run on the smallest tables and, where SQL exists, agree with it."""
import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

SAMPLE = ["a1_moments", "a13_best_of", "f3_anisotropy", "w13_sign_run_entropy", "w26_running_best", "r2_dct_bands", "o2_to_float16", "j2_feature_diff",
          "j8_rank_join", "n4_gap_matched", "n6_bootstrap_ci", "m4_combined_predict", "m12_disjoint_matrix", "l1_binned_mi", "l7_reconcile", "k4_contrast_table",
          "d3_matched_rules", "s9_append_check", "v2_superposition_err", "g6_score_catalogue", "t1_stream_running_best", "t6_stream_runs"]
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def test_registry():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 240


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert df.columns == [d[0] for d in cur.description]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(map(key, (tuple(r) for r in df.collect()))) == sorted(map(key, cur.fetchall()))
