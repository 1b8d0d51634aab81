"""Every registered query of the engine against its SQL, and the entry points."""

import importlib

import pytest
from oracle import rows_of, rows_of_sql

from clusterloom import registry

SQL = registry.oracle_sql()
#: queries over the same clustering as dbscan_labels; one of them is enough here
SAME = {"cluster_sizes", "noise_points", "dbscan_geo_labels", "core_points"}


@pytest.mark.parametrize("name", sorted(set(SQL) - SAME))
def test_query_equals_sql(spark, sf, name):
    assert rows_of(registry.queries()[name](spark, sf)) == rows_of_sql(sf, SQL[name])


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(registry.queries())


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    found = entry.entry(spark).select("cluster_id").collect()
    labels = [r.cluster_id for r in found]
    assert len(labels) == 150 and len(set(labels) - {-1}) == 10 and labels.count(-1) == 53
