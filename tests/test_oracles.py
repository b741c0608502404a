"""Every operator that has SQL against that SQL, on the small tables."""

import pytest
from compare import same

from candlewick.plans import catalogue

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    same(catalogue.queries()[name](spark, sf), duck, ORACLES[name])
