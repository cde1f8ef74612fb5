import pytest
from compare import same

from assay.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    same(QUERIES[name](spark, sf), duck.execute(SQL[name]))


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["event_id", "event_type", "user_id", "flag", "memo", "pos"]
