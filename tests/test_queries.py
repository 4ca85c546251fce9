"""Every registered query against its SQL, on the smallest tables."""

import pytest

from lodestrata.plans import QUERIES, SQL

from .oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], SQL[name])


def test_only_sequential_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == {"citation_matching", "site_clusters", "skeleton_lines", "tidal_fit"}
