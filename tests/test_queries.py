"""Every query with SQL gives the same rows; every other gives some over the whole small tables."""

import oracle
import pytest

import __spark_entry__ as entry
from lexdrift.plans import registry as R

D = f"{oracle.DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


@pytest.mark.parametrize("name", sorted(R.queries()))
def test_query(spark, con, name):
    df = R.queries()[name](spark, D)
    if name in R.oracle_sql():
        oracle.assert_same(df, con, R.oracle_sql()[name], name)
    else:
        assert df.count() > 0


def test_queries_without_sql_are_known():
    """Beside these, which are tested on small cases and against brute force, every query has its SQL."""
    assert set(R.queries()) - set(R.oracle_sql()) == {"linear_map", "huffman_codes", "embed_cotrained", "prediction_correlation", "explained_candidates", "explained_missed"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "word", "idx", "sim", "gcn", "bcn"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
