import pytest

from presswork import plans, registry  # noqa: F401

from .conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_are_those_of_the_sql(spark, warehouse, name):
    same_rows(registry.QUERIES[name](spark, SMALL), warehouse, registry.ORACLES[name])


def test_every_query_has_a_twin_or_a_reason():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"entity_tags"}


def test_for_you_feed_sorts_no_pairs_of_readers_and_stories(spark):
    plan = registry.QUERIES["for_you_feed"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
