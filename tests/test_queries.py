import pytest

from signalloom.plans import registry

from . import oracle


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLE:
        assert oracle.rows_of(df) == oracle.sql_rows(duck, registry.ORACLE[name])
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
