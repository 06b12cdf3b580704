"""Every registered query of the library against its oracle over the smallest tables."""

import pytest

from quarry.plans import catalog
from tests.compare import difference, duck
from tests.conftest import SF

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0
