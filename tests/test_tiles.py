"""Clusters by tiles: the same as from all pairs, without tables that grow with the pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clusterloom.functions.metrics import Euclidean, PythonMetric
from clusterloom.operators import tiles
from clusterloom.operators.dbscan import dbscan, pair_labels
from clusterloom.operators.joins import gathered
from clusterloom.plans.scratch import FREE_SHUFFLES, Scratch

OWN = PythonMetric(lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1]), triangle=True)
CASES = {"own": (2, OWN, None, 30.0), "own, crowded": (2, OWN, None, 7.0), "timed": (2, Euclidean(), 3, 12.0), "five axes": (5, Euclidean(), None, 4.5), "lattice": (2, Euclidean(), 1, 25)}


@pytest.mark.parametrize("case", CASES)
def test_tiles_equal_pairs(spark, case, monkeypatch):
    dims, metric, time_eps, wide = CASES[case]
    rng = random.Random(8)
    value = (lambda: float(rng.randrange(wide))) if isinstance(wide, int) else (lambda: rng.uniform(0, wide))
    columns = [f"c{k}" for k in range(dims)]
    rows = [(i, *(value() for _ in columns), rng.randrange(20)) for i in range(700)]
    rows += [(1000 + i, *(x + (k == 0) * 1e3 for k, x in enumerate(rows[i][1:-1])), rows[i][-1]) for i in range(90)]
    given = spark.createDataFrame(rows, f"row_id long, {', '.join(f'{c} double' for c in columns)}, t long")
    places = gathered(given, [*columns, *(["t"] if time_eps else [])])
    want = sorted(map(tuple, pair_labels(places, 1.0, 4, columns, metric, time_eps, Scratch(spark, "pairs")).collect()))
    assert len({label for _, label in want}) > 1 or case == "own, crowded"
    for tile, first, visitors in ((60, 2, 40), (250, 32, 1 << 15)):
        monkeypatch.setattr(tiles, "FIRST", first)
        monkeypatch.setattr(tiles, "VISITORS", visitors)
        assert sorted(map(tuple, tiles.tile_labels(places, 1.0, 4, columns, metric, time_eps, Scratch(spark, "tiles"), tile).collect())) == want


@pytest.mark.parametrize("dims,more", [(2, {"metric": OWN}), (2, {"time_eps": 50}), (6, {})])
def test_no_table_of_pairs(spark, dims, more, monkeypatch):
    """Distinct points with some hundred neighbours each: no table written on the way has more rows than there are points."""
    rng = random.Random(4)
    columns = [f"c{k}" for k in range(dims)]
    rows = [(i, *(rng.uniform(0, 3.0 if dims == 2 else 1.6) for _ in columns), rng.randrange(100)) for i in range(1500)]
    given = spark.createDataFrame(rows, f"row_id long, {', '.join(f'{c} double' for c in columns)}, t long")
    sizes, save = {}, Scratch.save

    def counted(self, df, name, *args):
        found = save(self, df, name, *args)
        sizes[name] = max(sizes.get(name, 0), found.count())
        return found

    monkeypatch.setattr(Scratch, "save", counted)
    labels = dbscan(given, 1.0, 4, 2, columns=columns, geo=False, **more)
    assert labels.count() == len(rows) and max(sizes.values()) <= len(rows), sizes


@pytest.mark.parametrize("metric", [Euclidean(), OWN])
def test_pairs_in_tiles(spark, metric, monkeypatch):
    """All pairs, of copies too, whichever tiles their ends lie in and however few pairs leave a task at once."""
    monkeypatch.setattr(tiles, "PAIRS", 300)
    monkeypatch.setattr(tiles, "CELLS", 2000)
    rng = random.Random(9)
    rows = [(float(rng.randrange(9)), rng.uniform(0, 9)) for _ in range(220)] + [(rng.uniform(0, 9), 3.0) for _ in range(30)] * 3
    far = (lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1])) if metric is OWN else (lambda a, b: math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2))
    want = sorted((i, j, far(a, b)) for i, a in enumerate(rows) for j, b in enumerate(rows) if far(a, b) <= 1.5)
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, x double, y double")
    chunks = given.groupBy("x", "y").agg(F.min("row_id").alias("row_id"), F.collect_list("row_id").alias("ids"))
    for tile in (30, 5000):
        found = tiles.tile_pairs(chunks, 1.5, ["x", "y"], metric, None, Scratch(spark, "pairs"), tile)
        assert sorted(map(tuple, found.collect())) == want


def test_saving_leaves_no_shuffle_files(spark):
    status = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: sum("shuffle" in f.getName() and f.getName().endswith(".data") for f in _files(status))
    before = shuffled()
    found = Scratch(spark, "freed").save(spark.range(1000).repartition(5, "id"), "rows")
    after = shuffled()
    assert after <= before and found.count() == 1000 and spark.conf.get(FREE_SHUFFLES) == "false"


def _files(manager):
    found = manager.getAllFiles()
    return [found.apply(k) for k in range(found.size())]
