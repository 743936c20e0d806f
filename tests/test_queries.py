import pytest

from tests.oracle import compare
from tidewatch.plans import reference_queries as q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, name):
    n = compare(q.QUERIES[name](spark, SF), q.ORACLES[name], SF)
    assert n > 0, "an empty result shows nothing"
