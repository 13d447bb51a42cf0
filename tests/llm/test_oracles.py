import pytest

from gaugeworks.llm import queries as q
from tests import oracle


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert oracle.check(spark, oracle.connect(sf_dir), sf_dir, q.queries()[name], q.oracle_sql()[name])
