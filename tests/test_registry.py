import os

import pytest

from plywise.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_check_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert len(catalog.queries()) > 120


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", ["participant_summary", "choice_rows", "pair_rows", "error_stats_capped", "capped_samples", "vote_report"])
def test_query_equals_check_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    want = sorted(str(tuple(r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]}) q").fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", ["participant_summary", "candidate_rows", "choice_rows", "pair_rows", "tactical_gate", "reward_samples"])
def test_plans_have_no_single_partition_or_cross_join(spark, name):
    plan = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
