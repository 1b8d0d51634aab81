"""Label-exact fixtures, rules by brute force, and edge cases."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from clusterloom.functions.metrics import Euclidean, Haversine, PythonMetric
from clusterloom.operators.components import connected_components
from clusterloom.operators.dbscan import dbscan, st_dbscan
from clusterloom.operators.hdbscan import hdbscan
from clusterloom.operators.joins import knn_join, range_join
from clusterloom.operators import mst as trees
from clusterloom.operators.closest import least_edges
from clusterloom.operators.mst import grown, mst, with_core
from clusterloom.operators.project import auto_metric
from clusterloom.plans.scratch import Scratch


def points(spark, rows, *names):
    names = names or ("x", "y")
    fields = ", ".join(f"{n} {'long' if n == 't' else 'double'}" for n in names)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_id long, {fields}")


def labels(found):
    return [r.cluster_id for r in found.orderBy("row_id").collect()]


def brute(rows, near, min_pts, least):
    """The labels by the sequential rules: clusters grow from each core point in turn."""
    n = len(rows)
    reach = [[j for j in range(n) if near(rows[i], rows[j])] for i in range(n)]
    label = [-1] * n
    found = 0
    for i in range(n):
        if label[i] != -1 or len(reach[i]) < min_pts:
            continue
        queue = [i]
        label[i] = found
        while queue:
            p = queue.pop()
            if len(reach[p]) >= min_pts:
                for q in reach[p]:
                    if label[q] == -1:
                        label[q] = found
                        queue.append(q)
        found += 1
    kept = [c for c in range(found) if label.count(c) >= least]
    return [kept.index(c) if c in kept else -1 for c in label]


def test_fixed_radius(spark):
    rows = [(1000.0, 1000.0), (1000.1, 1000.1), (1000.2, 1000.2), (2000.0, 2000.0), (2000.1, 2000.1), (5000.0, 5000.0)]
    assert labels(dbscan(points(spark, rows), 1.5, 2, 2)) == [0, 0, 0, 1, 1, -1]


@pytest.mark.parametrize(
    ("rows", "time_eps", "wanted"),
    [
        ([(1000.0, 1000.0, 1000000), (1000.1, 1000.1, 1010000), (1000.2, 1000.0, 1020000), (1000.05, 1000.05, 1120000), (1000.15, 1000.15, 1130000), (9999.0, 9999.0, 1000000)], 60000, [0, 0, 0, -1, -1, -1]),
        ([(1000.0, 1000.0, 0), (1000.1, 1000.0, 600000), (1000.0, 1000.1, 1200000), (5000.0, 5000.0, 0), (5000.1, 5000.0, 300000), (5000.0, 5000.1, 900000)], 3600000, [0, 0, 0, 1, 1, 1]),
        ([(0.0, 0.0, 0), (0.1, 0.0, 10000), (0.0, 0.1, 20000)], 1000, [-1, -1, -1]),
        ([(1000.0, 1000.0, 0), (1000.1, 1000.0, 10000), (1000.0, 1000.1, 20000)], 1000, [-1, -1, -1]),
    ],
)
def test_radius_and_time(spark, rows, time_eps, wanted):
    assert labels(st_dbscan(points(spark, rows, "x", "y", "t"), 1.5, 3, 3, time_eps)) == wanted


def test_hierarchical(spark):
    rows = [(1.0, 1.0), (1.1, 1.1), (1.2, 1.2), (1.3, 1.3), (10.0, 10.0), (12.0, 12.0), (14.0, 14.0)]
    assert labels(hdbscan(points(spark, rows), 2, 2)) == [0, 0, 0, 0, 1, 1, 1]
    rows = [(0.0, 0.0)] * 3 + [(5.0, 5.0)] * 3 + [(9.0, 1.0)]
    assert labels(hdbscan(points(spark, rows), 2, 2, geo=False)) == [0, 0, 0, 1, 1, 1, 1]


def test_against_sequential_rules(spark):
    rng = random.Random(3)
    for trial in range(3):
        rows = [(rng.randrange(12) * 1.0 + 500, rng.randrange(12) * 1.0, rng.randrange(5)) for _ in range(60)]
        timed = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 2.0 * 2.0 and abs(a[2] - b[2]) <= 1
        plain = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 1.0
        p = points(spark, rows, "x", "y", "t").repartition(trial + 1)
        assert labels(st_dbscan(p, 2.0, 5, 4, 1)) == brute(rows, timed, 5, 4)
        assert labels(dbscan(p, 1.0, 4, 3)) == brute(rows, plain, 4, 3)


def test_edge_cases(spark):
    none = points(spark, [])
    assert labels(dbscan(none, 1.0, 2, 2)) == [] and labels(hdbscan(none, 2, 2)) == []
    one = points(spark, [(1.0, 1.0)])
    assert labels(dbscan(one, 1.0, 1, 1)) == [0]
    assert labels(hdbscan(one, 1, 1)) == [-1] and labels(hdbscan(points(spark, [(1.0, 1.0), (2.0, 2.0)]), 3, 2)) == [-1, -1]
    exact = points(spark, [(500.0, 0.0), (502.0, 0.0)])
    assert labels(dbscan(exact, 2.0, 2, 2)) == [0, 0] and labels(dbscan(exact, 1.999, 2, 2)) == [-1, -1]
    # a border point goes to the first cluster, even where that is too small to stay
    rows = [(500.0 + x, 0.0) for x in (0.0, 1.0, 2.0, 3.0, 4.0)]
    assert labels(dbscan(points(spark, rows), 1.0, 3, 6)) == [-1] * 5
    for bad in (dict(eps=0, min_pts=2), dict(eps=1, min_pts=0), dict(eps=1, min_pts=1, min_cluster_size=0)):
        with pytest.raises(ValueError):
            dbscan(one, **bad)
    with pytest.raises(ValueError, match="timeEps must be positive"):
        st_dbscan(one, 1.0, 1, 1, 0)


def test_three_dimensions_and_metrics(spark):
    rng = random.Random(5)
    rows = [tuple(rng.uniform(0, 5) for _ in range(3)) for _ in range(50)]
    got = {(r.u, r.v) for r in range_join(points(spark, rows, "x", "y", "z"), 1.0, ["x", "y", "z"]).collect()}
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if sum((p - q) ** 2 for p, q in zip(a, b)) <= 1.0}
    assert got == want
    flat = points(spark, [r[:2] for r in rows])
    own = PythonMetric(lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1]))
    got = {(r.u, r.v) for r in range_join(flat, 0.7, metric=own).collect()}
    assert got == {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if abs(a[0] - b[0]) + abs(a[1] - b[1]) <= 0.7}
    assert isinstance(auto_metric(flat, ["x", "y"]), Haversine) and not isinstance(auto_metric(points(spark, [(500.0, 0.0)]), ["x", "y"]), Haversine)
    # at 60 degrees north 0.015 degrees of longitude are within a kilometre
    north = points(spark, [(10.0, 60.0), (10.015, 60.0)])
    assert range_join(north, 1.0, metric=Haversine()).count() == 4
    with pytest.raises(ValueError, match="more than 10 points"):
        range_join(flat, 0.7, metric=PythonMetric(own.function, most_points=10))


@pytest.mark.parametrize("k", [1, 4, 100])
def test_nearest_neighbours(spark, k):
    rng = random.Random(k)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(60)] + [(1000.0, 1000.0), (0.0, 0.0), (0.0, 0.0)]
    got = {(r.row_id, r["rank"]): r.neighbor for r in knn_join(points(spark, rows), k).collect()}
    want = {}
    for i, a in enumerate(rows):
        order = sorted((((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5, j) for j, b in enumerate(rows))
        want |= {(i, n + 1): j for n, (_, j) in enumerate(order[:k])}
    assert got == want


def test_neighbours_of_equal_points(spark):
    """A million points in one place and a few elsewhere: k rows each, from k rows of the place; ties go by id."""
    crowd = spark.range(1_000_000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    rest = spark.createDataFrame([(2_000_000, 1.0, 3.0), (2_000_001, 1.0, 1.0), (2_000_002, -0.0, 0.0), (2_000_003, 0.0, 0.0)], "id long, x double, y double")
    given = crowd.unionByName(rest).withColumnRenamed("id", "row_id")
    began = time.time()
    found = knn_join(given, 3)
    per = found.groupBy("row_id").agg(F.count("*").alias("n"), F.sum("neighbor").alias("ids"), F.max("distance").alias("far"))
    crowded = per.where("row_id < 1000000").agg(F.count("*"), F.min("n"), F.max("n"), F.min("ids"), F.max("ids"), F.max("far")).first()
    assert tuple(crowded) == (1_000_000, 3, 3, 3, 3, 0.0)  # everyone's neighbours are 0, 1 and 2
    assert time.time() - began < 120
    others = {r.row_id: [] for r in rest.withColumnRenamed("id", "row_id").collect()}
    for r in found.where("row_id >= 2000000").orderBy("row_id", "rank").collect():
        others[r.row_id].append(r.neighbor)
    assert others == {2_000_000: [2_000_000, 0, 1], 2_000_001: [2_000_001, 0, 1], 2_000_002: [2_000_002, 2_000_003, 2_000_001], 2_000_003: [2_000_002, 2_000_003, 2_000_001]}


def test_hierarchy_of_equal_points(spark):
    """Crowds in one place go through core distances, tree and hierarchy."""
    rows = [(0.0, 0.0)] * 400 + [(50.0, 0.0)] * 300 + [(25.0, 40.0)]
    assert labels(hdbscan(points(spark, rows), 4, 5, geo=False)) == [0] * 400 + [1] * 300 + [0]  # the last one is as near to both


@pytest.mark.parametrize("seed", [9, 10])
def test_tree_both_ways(spark, seed):
    """One task, growing radii to the end, and their bounds from the start: the same tree, many ties included."""
    rng = random.Random(seed)
    rows = [(float(rng.randrange(6)), float(rng.randrange(6))) for _ in range(25)] + [(90.0, 90.0), (1e6, 0.0)] + [(30 + rng.random(), 40 + rng.random()) for _ in range(60)]
    scratch = Scratch(spark, "test")
    cored = with_core(points(spark, rows), 3, ["x", "y"], scratch)
    dense = sorted(map(tuple, mst(cored, ["x", "y"]).collect()))
    assert len(dense) == len(rows) - 1 and dense == sorted(map(tuple, mst(cored, ["x", "y"], dense_points=0).collect()))
    assert dense == sorted(map(tuple, grown(cored, ["x", "y"], scratch, Euclidean(), few_classes=0).collect()))


def test_forest_in_parts(spark):
    """Edges that several tasks thin out, and one task at once."""
    rng = random.Random(2)
    rows = [(a, b, a, b, float(rng.randrange(50))) for a in range(40) for b in range(a + 1, 40)]
    edges = spark.createDataFrame(rows, "a long, b long, u long, v long, w double").repartition(6)
    one, other = (sorted(map(tuple, trees.forest(edges, Scratch(spark, "test"), most).collect())) for most in (1 << 20, 30))
    parent, want = list(range(40)), []
    for a, b, u, v, w in sorted(rows, key=lambda r: (r[4], r[2], r[3])):
        x, y = a, b
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        if x != y:
            parent[x] = y
            want.append((a, b, u, v, w))
    assert one == other == sorted(want)


def test_least_edges_of_crowds(spark):
    """Two crowds and many copies of one place, cut until a few points are left."""
    rng = random.Random(8)
    rows = [(rng.random(), rng.random(), 0) for _ in range(120)] + [(1.2 + rng.random(), rng.random(), 1) for _ in range(120)] + [(0.5, 3.0, 2)] * 90 + [(0.5, 2.5, 3)] * 90
    given = spark.createDataFrame([(k, x, y, c, 0.0) for k, (x, y, c) in enumerate(rows)], "row_id long, x double, y double, label long, core double")
    want = {}
    for i, p in enumerate(rows):
        for j, q in enumerate(rows):
            d = ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
            if p[2] < q[2] and d <= 2.0:
                want[p[2], q[2]] = min(want.get((p[2], q[2]), (9.0, 0, 0)), (d, min(i, j), max(i, j)))
    for few in (4, 100_000):
        found = least_edges(given, 2.0, ["x", "y"], ["x", "y"], Euclidean(), Scratch(spark, "test"), few_pairs=few).collect()
        assert {(r.a, r.b): (r.w, r.u, r.v) for r in found} == want


def great_circle(a, b):
    f, g = math.radians(a[1]), math.radians(b[1])
    h = math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def test_on_the_globe(spark):
    """Across the date line and near a pole, by cells in space: pairs, neighbours, both clusterings; no plan compares all pairs."""
    rng = random.Random(4)
    rows = [(rng.choice((179.9, -179.9)) + rng.uniform(-0.09, 0.09), rng.uniform(-0.3, 0.3)) for _ in range(30)]
    rows += [(rng.uniform(-180, 180), 89.9 + rng.uniform(0, 0.1)) for _ in range(30)] + [(10.0, 50.0), (190.0 - 360.0, 50.0)]
    p = points(spark, rows)
    joined = range_join(p, 15.0, metric=Haversine())
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {(r.u, r.v) for r in joined.collect()} == {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if great_circle(a, b) <= 15.0}
    near = {(r.row_id, r["rank"]): r.distance for r in knn_join(p, 4, metric=Haversine()).collect()}
    for i, a in enumerate(rows):
        assert [near[i, k + 1] for k in range(4)] == pytest.approx(sorted(great_circle(a, b) for b in rows)[:4], abs=1e-6)
    wanted = brute(rows, lambda a, b: great_circle(a, b) <= 15.0, 4, 3)
    assert labels(dbscan(p, 15.0, 4, 3, metric=Haversine())) == wanted
    assert -1 not in labels(hdbscan(p, 3, 3, metric=Haversine()))[:60]
    scratch = Scratch(spark, "test")
    found = mst(with_core(p, 3, ["x", "y"], scratch, Haversine()), ["x", "y"], metric=Haversine())
    core = [sorted(great_circle(a, b) for b in rows)[2] for a in rows]
    total, inside, best = 0.0, {0}, {j: max(core[0], core[j], great_circle(rows[0], rows[j])) for j in range(1, len(rows))}
    while best:
        k = min(best, key=best.get)
        total += best.pop(k)
        inside.add(k)
        best = {j: min(w, max(core[k], core[j], great_circle(rows[k], rows[j]))) for j, w in best.items()}
    assert sum(r.w for r in found.collect()) == pytest.approx(total)


def test_crowded_cells_make_no_pairs(spark):
    """20,000 points within the radius: what the plan joins grows with the points and not with their pairs."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    crowd = pd.DataFrame({"row_id": np.arange(20_003), "x": np.append(rng.random(20_000) * 0.5, [1.2, 1.9, 30.0]), "y": np.append(rng.random(20_000) * 0.5, [0.2, 0.2, 0.0])})
    began = time.time()
    found = dbscan(spark.createDataFrame(crowd), 1.0, 4, 2, geo=False)
    assert labels(found.where("row_id >= 19999")) == [0, 0, 0, -1] and found.where("cluster_id = 0").count() == 20_002
    assert time.time() - began < 60  # 400 million pairs take longer


@pytest.mark.parametrize("far", [1e300, -1e300, 1e15, 3e9])
def test_far_from_zero(spark, far):
    rows = [(far, 0.0), (far, 0.5), (0.0, 0.0), (0.0, 0.5), (far, 0.9), (-far, 0.0)]
    p = points(spark, rows)
    assert labels(dbscan(p, 1.0, 2, 2, geo=False)) == [0, 0, 1, 1, 0, -1]
    assert {(r.u, r.v) for r in range_join(p, 1.0).collect()} == {(i, j) for g in ((0, 1, 4), (2, 3), (5,)) for i in g for j in g}
    if abs(far) < 1e100:  # squares of larger ones are no numbers
        assert {r.neighbor for r in knn_join(p, 3).where("row_id = 4").collect()} == {0, 1, 4}


def test_rows_without_coordinates(spark):
    """Null, NaN and infinite coordinates are noise and near to nothing, in all algorithms; so are points without a time."""
    rows = [(500.0, 0.0, 0), (500.1, 0.0, 0), (500.2, 0.0, 0), (None, 0.0, 0), (float("nan"), 0.0, 0), (float("inf"), 0.0, 0), (500.1, 0.1, None)]
    p = points(spark, rows, "x", "y", "t")
    assert labels(dbscan(p, 1.0, 1, 1, geo=False)) == [0, 0, 0, -1, -1, -1, 0]
    assert labels(st_dbscan(p, 1.0, 1, 1, 5, geo=False)) == [0, 0, 0, -1, -1, -1, -1]
    assert labels(hdbscan(p, 2, 2, geo=False)) == [0, 0, 0, -1, -1, -1, 0]
    assert knn_join(p, 2).count() == 8 and {r.u for r in range_join(p, 1.0).collect()} == {0, 1, 2, 6}


def test_names_of_coordinates(spark):
    """Coordinates may have any name."""
    rows = [(500.0, 0.0), (500.1, 0.0), (500.2, 0.0), (900.0, 0.0), (900.1, 0.0), (900.2, 0.0)]
    p = points(spark, rows, "core", "label")
    assert labels(dbscan(p, 1.0, 2, 2, ["core", "label"])) == labels(hdbscan(p, 2, 2, ["core", "label"])) == [0, 0, 0, 1, 1, 1]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(120)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    frame = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {x: find(x) for x in linked}
    # by rounds of stars, too
    assert {r.node: r.component for r in connected_components(frame, one_task=0).collect()} == got
    assert connected_components(frame.where("false")).count() == 0
    assert connected_components(frame.where(F.col("u") == F.col("v"))).count() == 0


def test_mean_does_not_depend_on_partitions(spark):
    """Latitudes whose sum depends on the order of addition: the projection is the same to the last bit."""
    from clusterloom.operators.project import project_km

    rng = random.Random(6)
    rows = [(rng.uniform(-180, 180), rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 2)) for _ in range(3000)]
    found = [sorted(map(tuple, project_km(points(spark, rows).repartition(n)).collect())) for n in (1, 7, 64)]
    assert found[0] == found[1] == found[2]
    assert project_km(points(spark, [(1.0, 1e300), (2.0, -1e300)])).count() == 2


def test_member_chunks(spark):
    """A cluster with nearly all rows: lists of bounded size, in order, nothing lost."""
    from clusterloom.operators.result import member_chunks

    labels = spark.range(2500).selectExpr("id * 3 as row_id", "int(if(id % 10 = 0, -1, if(id % 97 = 1, 1, 0))) as cluster_id").repartition(5)
    want = {}
    for r in labels.orderBy("row_id").collect():
        want.setdefault(r.cluster_id, []).append(r.row_id)
    for noise in (False, True):
        got = {}
        for r in member_chunks(labels, 100, noise).orderBy("cluster_id", "chunk").collect():
            assert len(r.members) <= 100 and r.chunk == len(got.setdefault(r.cluster_id, [])) // 100
            got[r.cluster_id] += r.members
        assert got == {c: m for c, m in want.items() if noise or c >= 0}


@pytest.mark.parametrize("eps", [0.0, 0.3, 2.0])
def test_own_metric_by_pivots(spark, eps):
    """Exact against brute force for metrics that no grid fits, equal points included, with more points than all pairs allow."""
    import numpy as np

    rng = random.Random(11)
    rows = [(rng.gauss(0, 2), rng.gauss(0, 2)) for _ in range(150)] + [(1.0, 1.0)] * 20 + [(1e6, 0.0)]
    largest = lambda a, b: np.maximum(np.abs(a[0] - b[0]), np.abs(a[1] - b[1]))
    jumps = lambda a, b: np.where((a[0] == b[0]) & (a[1] == b[1]), 0.0, 1.0 + np.minimum(np.abs(a[0] - b[0]), 1.0))
    for function in (largest, jumps):
        metric = PythonMetric(function, most_points=10, triangle=True)
        joined = range_join(points(spark, rows), eps, metric=metric)
        got = sorted((r.u, r.v) for r in joined.collect())
        apart = lambda a, b: float(function([np.float64(x) for x in a], [np.float64(x) for x in b]))  # noqa: B023, E731
        assert got == [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if apart(a, b) <= eps]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert range_join(points(spark, []), 1.0, metric=metric).count() == 0


def test_many_dimensions(spark):
    """Six dimensions, three of them alike for all points, against the sequential rules; crowds that touch are cut, not paired."""
    rng = random.Random(12)
    centres = [[rng.uniform(0, 6) for _ in range(3)] for _ in range(4)]
    rows = [(1.0, *(c + rng.gauss(0, 0.5) for c in rng.choice(centres)), 2.0, 3.0) for _ in range(110)]
    rows += [(1.0, 9.0, 9.0, 9.0, 2.0, 3.0)] * 15 + [(1.0, 9.0, 9.0, 9.9, 2.0, 3.0)] * 15
    names = [f"d{k}" for k in range(6)]
    p = points(spark, rows, *names)
    near = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) <= 1.0
    assert labels(dbscan(p, 1.0, 5, 4, names, geo=False)) == brute(rows, near, 5, 4)
    import numpy as np

    made = np.random.default_rng(1)
    two = np.concatenate([made.uniform(0, 1, (3000, 5)) * 0.5, made.uniform(0, 1, (3000, 5)) * 0.5 + [0.8, 0, 0, 0, 0], [[9.0] * 5]])
    crowd = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(two)], "row_id long, " + ", ".join(f"d{k} double" for k in range(5)))
    found = {r.cluster_id: r["count"] for r in dbscan(crowd, 0.6, 4, 2, names[:5], geo=False).groupBy("cluster_id").count().collect()}
    assert found == {0: 6000, -1: 1}
