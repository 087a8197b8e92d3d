import pytest
from shared import SF, same_rows

from wayforge.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    assert same_rows(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])
