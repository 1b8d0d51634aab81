"""Density clustering with a fixed radius, with or without a time band.

A point is core if at least min_pts points lie within the radius, itself counted.  Core points in reach
of each other are one cluster, named by its smallest core row_id.  Other points go to the cluster with
the smallest name among their core neighbours.  Clusters below the least size become noise with their
border points, and the rest are numbered from 0 in order of name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.metrics import GRID_DIMENSIONS, Euclidean, Metric
from clusterloom.functions.points import within_time
from clusterloom.operators.closest import least_edges
from clusterloom.operators.components import connected_components
from clusterloom.operators.joins import LAST_CELL, WIDER, cell, fit_for, gathered, near_cells, near_pairs, plain, spread_out
from clusterloom.operators.project import to_plane
from clusterloom.operators.tiles import tile_labels
from clusterloom.plans.scratch import Scratch
from clusterloom.sources.points import numbered

NOISE = -1


def renumber(labelled: DataFrame, min_cluster_size: int, scratch: Scratch | None = None) -> DataFrame:
    """(row_id, cluster_id) from (row_id, label), label null for noise: small clusters to noise, ids dense in order of label.

    Clusters are numbered like any rows, by ranges of their labels (see `numbered`), so no task sees them all.
    """
    sizes = labelled.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_cluster_size)
    ids = numbered(sizes.select("label"), ["label"], scratch).select("label", F.col("row_id").cast("int").alias("cluster_id"))
    joined = labelled.join(ids, "label", "left")
    return joined.select("row_id", F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"))


def pair_labels(places: DataFrame, eps: float, min_pts: int, columns: list[str], metric: Metric, time_eps: int | None, scratch: Scratch) -> DataFrame:
    """(row_id, label) of `places` (see `gathered`) from their neighbour pairs, before any size filter; those that are noise are left out."""
    met = near_pairs(places, eps, columns, metric, time_eps, ["copies"])
    ends = [F.struct(F.col(f"{p}_row_id").alias("u"), F.col(f"{q}_row_id").alias("v"), F.col(f"{q}_copies").alias("copies")) for p, q in (("u", "v"), ("v", "u"))]
    both = F.when(F.col("u_row_id") == F.col("v_row_id"), F.array(ends[0])).otherwise(F.array(*ends))
    pairs = scratch.save(met.select(F.explode(both).alias("p")).select("p.*"), "pairs")
    counted = pairs.groupBy(F.col("u").alias("row_id")).agg(F.sum("copies").alias("near"))
    core = scratch.save(counted.where(F.col("near") >= min_pts).select("row_id"), "core")
    pairs = pairs.drop("copies")
    mine = pairs.join(core.withColumnRenamed("row_id", "v"), "v", "left_semi")  # pairs with a core neighbour
    between = mine.join(core.withColumnRenamed("row_id", "u"), "u", "left_semi").where("u < v")
    found = connected_components(between, scratch=scratch)
    named = core.join(found.withColumnRenamed("node", "row_id"), "row_id", "left")
    named = scratch.save(named.select("row_id", F.coalesce("component", "row_id").alias("label")), "named")
    border = mine.join(core.withColumnRenamed("row_id", "u"), "u", "left_anti")
    border = border.join(named.withColumnRenamed("row_id", "v"), "v").groupBy("u").agg(F.min("label").alias("label"))
    return named.unionByName(border.select(F.col("u").alias("row_id"), "label"))


def by_spread(points: DataFrame, axes: list[str]) -> list[str]:
    """More axes than a grid cuts in order of how far they spread the points, widest first; else as they are."""
    if len(axes) <= GRID_DIMENSIONS:
        return axes
    wide = points.agg(*(F.stddev_pop(c).alias(c) for c in axes)).first()
    return sorted(axes, key=lambda c: -(wide[c] if wide[c] is not None and wide[c] == wide[c] else 0.0))


def cell_labels(places: DataFrame, eps: float, min_pts: int, columns: list[str], metric: Metric, time_eps: int | None, scratch: Scratch) -> DataFrame:
    """As `pair_labels`, without a table of neighbour pairs of places.

    Points of one small cell are all neighbours of each other.  So a cell of min_pts points is core
    without looking further, and the core points of a cell are one class.  Only points of cells with fewer
    count their neighbours; what they meet grows with min_pts and not with the square of a crowd.
    Classes are linked by `least_edges`, which compares their boundaries only.  With many dimensions
    cells are cut by all axes, and who is near is looked up by the few that spread the points most.
    """
    timed = ["t"] if time_eps is not None else []
    spots = metric.axes([F.col(c) for c in columns])
    axes = [f"a{k}" for k in range(len(spots))]
    side = metric.straight(eps) / len(axes) ** 0.5 * (2 - WIDER) - 2 * metric.slack
    given = places.select("row_id", *columns, *timed, "copies", *(x.alias(n) for x, n in zip(spots, axes, strict=True)))
    axes = by_spread(given, axes)
    far = reduce(lambda p, q: p | q, [F.abs(F.col(c) / side) >= LAST_CELL for c in axes])  # cells there may be larger: each such point alone
    numbers = [cell(F.col(c), side).alias(f"n{k}") for k, c in enumerate(axes)]
    numbers += [F.floor(F.col("t") / F.lit(time_eps)).alias("nt") for _ in timed]
    placed = given.select("*", *numbers, far.alias("far"), F.when(far, F.col("row_id")).otherwise(F.lit(0)).alias("lone"))
    keys = [c for c in placed.columns if c not in given.columns]
    placed = scratch.save(placed.join(placed.groupBy(*keys).agg(F.sum("copies").alias("n")), keys), "placed")

    def neighbours(some: DataFrame, others: DataFrame, *keep: str) -> DataFrame:
        kept = ["row_id", *columns, *axes, *timed]
        left = some.select(*(F.col(c).alias(f"u_{c}") for c in kept))
        right = others.select(*(F.col(c).alias(f"v_{c}") for c in (*kept, *keep)))
        ways = [[cell(F.col(f"{s}_{c}"), eps * WIDER + metric.slack) for c in axes[:GRID_DIMENSIONS]] + [F.floor(F.col(f"{s}_t") / F.lit(time_eps)) for _ in timed] for s in "uv"]
        a, b = ([F.col(f"{s}_{c}") for c in columns] for s in "uv")
        close = metric.comparable(a, b) <= F.lit(metric.threshold(eps))
        if time_eps is not None:
            close = close & within_time(F.col("u_t"), F.col("v_t"), time_eps)
        return near_cells(left, right, *ways, half=False).where(close)

    sparse = placed.where(F.col("n") < min_pts)
    counted = neighbours(sparse, placed, "copies").groupBy(F.col("u_row_id").alias("row_id")).agg(F.sum("v_copies").alias("near"))
    known = scratch.save(placed.join(counted, "row_id", "left").withColumn("is_core", (F.col("n") >= min_pts) | (F.coalesce("near", F.lit(0)) >= min_pts)), "known")
    core = known.where("is_core")
    core = core.join(core.groupBy(*keys).agg(F.min("row_id").alias("label")), keys)
    core = scratch.save(core.select("row_id", "label", F.lit(0.0).alias("core"), *columns, *axes, *timed), "core")
    links = least_edges(core, eps, columns, axes, metric, scratch, time_eps=time_eps)
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch=scratch).withColumnRenamed("node", "label")
    named = scratch.save(core.join(found, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component"), "named")
    border = neighbours(known.where("not is_core and near > 1"), named, "label").groupBy(F.col("u_row_id").alias("row_id")).agg(F.min("v_label").alias("label"))
    return named.select("row_id", "label").unionByName(border)


def dbscan(
    points: DataFrame, eps: float, min_pts: int, min_cluster_size: int = 1, columns: list[str] | None = None, geo: bool | str = "auto", metric: Metric | None = None, time_eps: int | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """(row_id, cluster_id), -1 for noise; points have row_id and `columns` (x, y by default), and t for `time_eps`.

    With a metric of your own points are not projected.  A row with a null, NaN or infinite coordinate, or
    without a time where one is needed, is noise; row_ids are to be unique.  An empty table gives an empty
    result.  The tables that it reads belong to `scratch` if given.  Equal points
    are clustered as one place.  Metrics that no grid fits go through a table of all neighbour pairs of places.
    """
    if not eps > 0:
        raise ValueError("eps must be positive")
    if min_pts < 1:
        raise ValueError("minPts must be at least 1")
    if min_cluster_size < 1:
        raise ValueError("minClusterSize must be at least 1")
    if time_eps is not None and time_eps <= 0:
        raise ValueError("timeEps must be positive")
    scratch = scratch.inner("dbscan") if scratch else Scratch(points.sparkSession, "dbscan")
    given, columns = plain(points, columns, ["t"] if time_eps is not None else [])
    found = given if metric else to_plane(given, columns, geo)
    metric = metric or Euclidean()
    found = fit_for(found, columns, metric)
    of = [*columns, *(["t"] if time_eps is not None else [])]
    places = scratch.save(gathered(found, of), "places")
    grid = metric.slack is not None and metric.straight(eps) > 1e3 * metric.slack
    tiled = getattr(metric, "triangle", False) or isinstance(metric, Euclidean) and (time_eps is not None or len(columns) > GRID_DIMENSIONS)
    labels = (tile_labels if tiled else cell_labels if grid else pair_labels)(places, eps, min_pts, columns, metric, time_eps, scratch)
    labels = spread_out(found, labels, of)
    labels = scratch.save(points.select("row_id").join(labels, "row_id", "left"), "labels")
    scratch.keep_only("labels")
    return renumber(labels, min_cluster_size, scratch)


def st_dbscan(points: DataFrame, eps: float, min_pts: int, min_cluster_size: int, time_eps: int, **more) -> DataFrame:
    """As `dbscan`, with neighbours also at most `time_eps` milliseconds apart in column t."""
    return dbscan(points, eps, min_pts, min_cluster_size, time_eps=time_eps, **more)
