import oracle
import pytest

import __spark_entry__

MODULES = __spark_entry__.CORE
CASES = [(n, m) for m in MODULES for n in m.oracle_sql()]


@pytest.fixture(scope="module")
def con(data):
    return oracle.connection(data)


@pytest.mark.parametrize(("name", "module"), CASES, ids=[n for n, _ in CASES])
def test_query_as_sql(spark, data, con, name, module):
    oracle.assert_same(spark, con, data, module.queries()[name], module.oracle_sql()[name])


def test_every_sql_has_its_query():
    for m in MODULES:
        assert set(m.oracle_sql()) <= set(m.queries())
