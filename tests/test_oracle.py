"""Every registered query with a SQL form agrees with it on the smallest scale."""

import pytest
from oracle import compare, duck

from gsx.plans import catalog

SF = "/root/testdata/sf0.001"
CATALOG = catalog()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# results that are empty at this scale but not at larger ones
MAY_BE_EMPTY = {"j3_join_rankings", "j8_run_pair_matches"}


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql])
def test_query_matches_sql(spark, con, name):
    problem = compare(spark, con, SF, CATALOG[name])
    assert not problem or (problem == "no rows" and name in MAY_BE_EMPTY), problem


def test_names_do_not_collide():
    assert len(CATALOG) > 140
