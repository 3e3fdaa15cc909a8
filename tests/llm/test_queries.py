import pytest

from keytide.llm import queries as Q
from tests.compare import connect, same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    same(Q.queries()[name](spark, SF), connect(SF), Q.oracle_sql()[name])
