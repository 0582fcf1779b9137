"""The queries of this subpackage that SQL can say equal it on whole tables."""

import pytest

from quarry.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, name, size):
    d = f"/root/testdata/{size}"
    compare(spark, connect(d), QUERIES[name], ORACLE_SQL[name], d)
