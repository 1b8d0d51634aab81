"""Equal points are joined and clustered as one place, and nothing that grows is broadcast."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.functions.metrics import PythonMetric
from clusterloom.operators.components import connected_components
from clusterloom.operators.dbscan import dbscan, st_dbscan
from clusterloom.operators.joins import COPIES, core_points, near_counts, near_links, neighbor_count, range_join
from clusterloom.operators.mst import dense_prim, mst, with_core
from clusterloom.plans.scratch import Scratch


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    return [(float(rng.randrange(7)), float(rng.randrange(7)), rng.randrange(3)) for _ in range(60)] + [(2.0, 3.0, 1)] * (2 * COPIES + 40) + [(90.0, 0.0, 0), (-0.0, 0.0, 1), (0.0, -0.0, 1)]


@pytest.fixture(scope="module")
def given(spark, rows):
    return spark.createDataFrame([(i, *r, float(r[2])) for i, r in enumerate(rows)], "row_id long, x double, y double, t long, core double").repartition(3)


def test_pairs_of_copies(given, rows):
    near = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 1.0
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if near(a, b)}
    found = [(r.u, r.v) for r in range_join(given, 1.0).select("u", "v").collect()]
    assert len(found) == len(want) and set(found) == want
    half = [tuple(r) for r in range_join(given, 1.0, keep=["core"], both=False).select("u", "v", "u_core", "v_core").collect()]
    assert sorted(half) == sorted((i, j, float(rows[i][2]), float(rows[j][2])) for i, j in want if i < j)
    timed = {(r.u, r.v) for r in range_join(given, 1.0, time_eps=1).select("u", "v").collect()}
    assert timed == {(i, j) for i, j in want if abs(rows[i][2] - rows[j][2]) <= 1}
    pairs = range_join(given, 1.0)
    assert sorted(near_counts(given, 1.0).collect()) == sorted(neighbor_count(pairs).collect())
    assert near_counts(given, 1.0).where("n_neighbors >= 5").count() == core_points(pairs, 5).count()
    whole, few = connected_components(pairs.where("u < v").select("u", "v")), near_links(given, 1.0)
    assert few.count() < len(rows) * 8 and sorted(connected_components(few).collect()) == sorted(whole.collect())


def test_nothing_is_broadcast(given):
    """Small tables that many rows come out of were broadcast by their size in files, whatever their number of rows."""
    plan = range_join(given, 1.0, time_eps=1)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan.replace("BroadcastExchange ()", "")


def test_clusters_of_copies(spark):
    """20,000 copies each in three places: 1.2 billion pairs, of a metric in Python, are not written out."""
    crowd = spark.range(60_000).select(F.col("id").alias("row_id"), (F.col("id") % 3 * 2.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).cast("long").alias("t"))
    crowd = crowd.unionByName(spark.createDataFrame([(70_000, 4.5, 0.0, 9), (70_001, 9.0, 0.0, 0)], crowd.schema))
    began = time.time()
    own = PythonMetric(lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1]), triangle=True)
    sizes = lambda found: sorted(map(tuple, found.groupBy("cluster_id").count().collect()))
    assert sizes(dbscan(crowd, 1.0, 4, 2, metric=own)) == [(-1, 1), (0, 20_000), (1, 20_000), (2, 20_001)]
    assert sizes(st_dbscan(crowd, 1.0, 4, 2, 5, geo=False)) == [(-1, 2), (0, 20_000), (1, 20_000), (2, 20_000)]
    assert time.time() - began < 120


def test_tree_of_copies(spark):
    """Crowds in one place hang on their smallest point, whichever way the tree is found; a tree in order of insertion costs places, not points."""
    rng = random.Random(5)
    rows = [(float(rng.randrange(4)), float(rng.randrange(4))) for _ in range(70)] + [(9.0, 9.0), (9.0, 9.5), (30.0, 1.0)]
    scratch = Scratch(spark, "test")
    few = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, x double, y double")
    cored = with_core(few, 3, ["x", "y"], scratch)
    plan = sorted(dense_prim(*(np.array([r[c] for r in cored.orderBy("row_id").collect()]) if c != "xy" else np.array(rows) for c in ("row_id", "xy", "core"))))
    want = sorted((min(u, v), max(u, v), w) for u, v, w in plan)
    assert want == sorted(map(tuple, mst(cored, ["x", "y"]).collect())) == sorted(map(tuple, mst(cored, ["x", "y"], dense_points=0).collect()))
    crowd = spark.range(60_000).select(F.col("id").alias("row_id"), (F.col("id") % 30 * 1.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("core"))
    began = time.time()
    for tie_break in ("prim", "canonical"):
        found = mst(crowd, ["x", "y"], tie_break)
        assert sorted(map(tuple, found.groupBy("w").count().collect())) == [(0.0, 59_970), (1.5, 29)]
    assert time.time() - began < 60  # 60,000 points against each other take some minutes
