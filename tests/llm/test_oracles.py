import os

import pytest

from arbora.llm.queries import ORACLE_SQL, QUERIES
from oracle import oracle_rows, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_gives_the_rows_of_its_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    names, want = oracle_rows(ORACLE_SQL[name], SF)
    assert sorted(df.columns) == names
    got = rows_of(df)
    assert len(got) == len(want)
    assert got == want
