"""Every query with SQL gives the same rows; every other gives some over the whole small tables."""

import oracle
import pytest

from lexdrift.llm import queries as Q

D = f"{oracle.DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    df = Q.queries()[name](spark, D)
    if name in Q.oracle_sql():
        oracle.assert_same(df, con, Q.oracle_sql()[name], name)
    else:
        assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


COLUMNS = {
    "p1_found": "tbl string, row_id bigint, comment_ix bigint, kind string, start_pos bigint",
    "p2_found": "model string, idx_a bigint, idx_b bigint",
    "p3_found": "row_id_a bigint, row_id_b bigint",
    "p4_found": "tbl string, row_id bigint, comment_ix bigint, line_no bigint",
    "p5_found": "tbl string, row_id bigint, comment_ix bigint, start_pos bigint",
    "p6_found": "field_of string, term string, mark string",
    "p7_found": "tbl string, row_id bigint, comment_ix bigint, kind string, nth bigint",
    "p10_found": "doc_id bigint, level bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_no_repeats(spark, name):
    df = Q.queries()[name](spark, D)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    assert df.count() == df.distinct().count()
