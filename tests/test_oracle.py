"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from vocspark.plans.registry import ORACLE, QUERIES
from check_oracle import rows
from tests.conftest import SF_SMALL

# the library's own queries; those of the training-data package have their tests



@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0


def test_every_query_names_an_operator():
    from vocspark.plans.registry import OPERATOR_IDS
    assert set(OPERATOR_IDS) == set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["channel", "items", "net", "high_risk", "avg_intensity"]
    assert df.count() == 5
