"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from attestor.plans.catalogue import ORACLE_SQL, QUERIES, flagship

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        oracle.same(df, duck, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0
