"""Every query that SQL can express against DuckDB, the others for their rows and schema."""

import pytest

from foliometry.plans import all as plans
from foliometry.plans import registry

from conftest import DATA
from helpers import same

plans.load()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    same(registry.run(name)(spark, DATA), duck, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, name):
    assert registry.run(name)(spark, DATA).count() > 0
