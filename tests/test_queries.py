import os

import pytest

from arbora.queries import ORACLE_SQL, QUERIES
from oracle import oracle_rows, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_the_rows_of_its_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    names, want = oracle_rows(ORACLE_SQL[name], SF)
    assert sorted(df.columns) == names
    assert rows_of(df) == want
