"""The registered queries of the subpackage run over whole tables; those with SQL give its rows."""

import pytest

from blockloom.llm import queries as Q
from tests.oracle import by_sql, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    got = Q.queries()[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in Q.oracle_sql():
        assert rows(got) == by_sql(Q.oracle_sql()[name], FOLDER)


def test_the_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))
