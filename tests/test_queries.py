import pytest

from keytide.plans import queries as Q
from tests.compare import connect, same

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_matches_sql(spark, con, name):
    same(Q.queries()[name](spark, SF), con, Q.oracle_sql()[name])
