import pytest

from checks.compare import canonical, differences, duck
from tradewind.llm.queries import oracle_sql, queries


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, small, name):
    df = queries()[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    assert not differences(canonical(df.columns, rows), canonical(*duck(oracle_sql()[name], small)))
