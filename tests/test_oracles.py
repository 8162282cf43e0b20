"""Every registered query against its DuckDB oracle on the smallest test scale."""

import duckdb
import pytest

import __spark_entry__ as E
from rollframe.plans.tables import TABLES
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["data_source", "mean_score", "n_prompts"]


def test_accumulate_unreachable_target_raises(spark):
    from rollframe.operators.filters import accumulate_to_target
    from rollframe.plans.tables import rollouts

    with pytest.raises(RuntimeError, match="too many generation rounds"):
        accumulate_to_target(rollouts(spark, SF), 10**9, 10, round_col="step", metric_col="acc").collect()


def test_minibatch_size_must_divide(spark):
    from rollframe.operators.batch import minibatch_ids

    with pytest.raises(ValueError, match="must divide"):
        minibatch_ids(spark.range(10), 3, "id")
