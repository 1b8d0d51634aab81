"""The least edge between classes of points that lie within a radius of each other, without comparing all their points.

Points of one class and one cell make a box: their bounds, and the bounds of their core distances.  A
pair of boxes bounds the edges between its points from both sides, so a pair that can't hold the least
edge of its two classes is dropped, a pair of few points is compared point by point, and the boxes of
the others are cut along each axis, and so on.  Work and rows depend on the boundary between classes
and not on how many points they hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.metrics import GRID_DIMENSIONS, Metric
from clusterloom.functions.points import mutual_reachability, within_time
from clusterloom.operators.joins import WIDER, cell, near_cells
from clusterloom.plans.scratch import Scratch

#: pairs of boxes with up to so many pairs of points are compared point by point
FEW_PAIRS = 256
#: parts into which a box is cut on each axis, and on how many axes if there are more: its widest
CUT, CUT_AXES = 4, 4
#: share by which bounds are widened against rounding
LOOSE = 1e-9


def _box(limits: list[str]) -> list[Column]:
    """A box is named by its smallest row_id; `first` stands for all its points where they lie in one place."""
    bounds = [f(c).alias(f"{side}_{c}") for c in (*limits, "core") for side, f in (("lo", F.min), ("hi", F.max))]
    return [F.min("row_id").alias("box"), F.count("*").alias("n"), F.min(F.struct("core", "row_id"))["row_id"].alias("first"), *bounds]


def _weights(axes: list[str], metric: Metric) -> tuple[Column, Column]:
    """The least and the greatest weight that an edge between the boxes x and y can have."""
    near, far = F.lit(0.0), F.lit(0.0)
    for c in axes:
        apart = F.greatest(F.col(f"y.lo_{c}") - F.col(f"x.hi_{c}"), F.col(f"x.lo_{c}") - F.col(f"y.hi_{c}"), F.lit(0.0))
        across = F.greatest(F.col(f"y.hi_{c}") - F.col(f"x.lo_{c}"), F.col(f"x.hi_{c}") - F.col(f"y.lo_{c}"))
        near, far = near + apart * apart, far + across * across
    low, high = F.sqrt(near) * (1 - LOOSE) - metric.slack, metric.spread(F.sqrt(far)) * (1 + LOOSE) + metric.slack
    return F.greatest(low, F.col("x.lo_core"), F.col("y.lo_core")), F.greatest(high, F.col("x.hi_core"), F.col("y.hi_core"))


def _compared(pairs: DataFrame, boxed: DataFrame, columns: list[str], metric: Metric, radius: float, time_eps: int | None) -> DataFrame:
    """The least edge of each pair of classes among the points of these pairs of boxes."""
    kept = ["row_id", "core", *columns, *(["t"] if time_eps is not None else [])]
    sides = [boxed.select(F.col("box").alias(s), F.col("first").alias(f"{s}_first"), *(F.col(c).alias(f"{s}_{c}") for c in kept)) for s in "xy"]
    each = pairs.join(sides[0], "x").join(sides[1], "y").where("not flat or x_row_id = x_first and y_row_id = y_first")
    a, b = ([F.col(f"{s}_{c}") for c in columns] for s in "xy")
    close = (metric.comparable(a, b) <= F.lit(metric.threshold(radius))) & (F.greatest("x_core", "y_core") <= F.lit(radius))
    if time_eps is not None:
        close = close & within_time(F.col("x_t"), F.col("y_t"), time_eps)
    w = mutual_reachability(F.col("x_core"), F.col("y_core"), metric.distance(a, b))
    edge = F.struct(w.alias("w"), F.least("x_row_id", "y_row_id").alias("u"), F.greatest("x_row_id", "y_row_id").alias("v"))
    return each.where(close).groupBy("a", "b").agg(F.min(edge).alias("e"))


def least_edges(
    points: DataFrame, radius: float, columns: list[str], axes: list[str], metric: Metric, scratch: Scratch, pairs: DataFrame | None = None, time_eps: int | None = None, few_pairs: int = FEW_PAIRS
) -> DataFrame:
    """(a, b, u, v, w), a < b: for each two classes with an edge of weight up to `radius` the least one by (w, u, v), u < v.

    `points` has row_id, label (the class), core, `columns` and `axes` (what `Metric.axes` makes of them),
    all of them numbers; an edge weighs the mutual reachability.  The result is to be read before `scratch`
    is used again.  `pairs` (a, b) names the classes to
    compare, each one box at first; by default they are found through cells of the radius.  With
    `time_eps`, an edge also spans at most that time in column t.  Flat boxes, all of whose points lie in
    one place, are compared by one point each.
    """
    kept = ["row_id", "label", "core", *dict.fromkeys([*columns, *axes]), *(["t"] if time_eps is not None else [])]
    limits = [*axes, "t"] if time_eps is not None else axes
    low, high = _weights(axes, metric)
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    if time_eps is not None:
        near_in_time = (x("lo_t") <= y("hi_t") + time_eps) & (y("lo_t") <= x("hi_t") + time_eps)
        high = F.when((x("hi_t") - y("lo_t") <= time_eps) & (y("hi_t") - x("lo_t") <= time_eps), high)
    else:
        near_in_time = F.lit(True)
    numbers: list[str] = []
    given = points.select(*kept)
    if pairs is None:
        width = radius * WIDER + metric.slack
        cells = [cell(F.col(c), width) for c in axes[:GRID_DIMENSIONS]]
        if time_eps is not None:
            cells.append(F.floor(F.col("t") / F.lit(time_eps)))
        numbers = [f"__n{k}" for k in range(len(cells))]
        given = given.select("*", *(c.alias(n) for c, n in zip(cells, numbers, strict=True)))
    boxes = scratch.save(given.groupBy("label", *numbers).agg(*_box(limits)), "boxes")
    boxed = given.join(boxes.select("label", *numbers, "box", "first"), ["label", *numbers]).select("box", "first", *kept)
    if pairs is None:
        sides = [boxes.select(*(F.col(c).alias(f"{s}_{c}") for c in ("box", "label", *numbers))) for s in "xy"]
        found = near_cells(*sides, *([F.col(f"{s}_{c}") for c in numbers] for s in "xy"), half=True)
        found = found.where("x_label <> y_label and (not __same or x_box < y_box)").select("x_box", "y_box")
    else:
        ends = [boxes.select(F.col("label").alias(c), F.col("box").alias(f"{s}_box")) for s, c in (("x", "a"), ("y", "b"))]
        found = pairs.select("a", "b").join(ends[0], "a").join(ends[1], "b").select("x_box", "y_box")
    found = found.withColumn("bound", F.lit(None).cast("double"))
    edges: list[DataFrame] = []
    while True:
        step = len(edges)
        ends = [boxes.drop(*numbers).select(F.col("box").alias(f"{s}_box"), F.struct(*(c for c in boxes.columns if c not in numbers)).alias(s)) for s in "xy"]
        held = found.join(ends[0], "x_box").join(ends[1], "y_box").where((low <= radius) & near_in_time)
        flat = reduce(lambda p, q: p & q, [F.col(f"{s}.lo_{c}") == F.col(f"{s}.hi_{c}") for s in "xy" for c in limits])
        held = held.select(
            F.col("x_box").alias("x"),
            F.col("y_box").alias("y"),
            F.least("x.label", "y.label").alias("a"),
            F.greatest("x.label", "y.label").alias("b"),
            low.alias("low"),
            F.least(high, "bound").alias("high"),
            flat.alias("flat"),
            (flat | (x("n") * y("n") <= few_pairs)).alias("few"),
        )
        held = scratch.save(held, "held")
        if held.where("not few").isEmpty():
            edges.append(_compared(held, boxed, columns, metric, radius, time_eps))
            break
        bound = held.groupBy("a", "b").agg(F.min("high").alias("bound"))
        held = scratch.save(held.join(bound, ["a", "b"]).where("bound is null or low <= bound"), "open")
        edges.append(scratch.save(_compared(held.where("few"), boxed, columns, metric, radius, time_eps), f"found{step}"))
        large = held.where("not few").select("x", "y", "bound")
        if large.isEmpty():
            break
        wanted = large.select(F.col("x").alias("box")).unionByName(large.select(F.col("y").alias("box"))).distinct()
        whole = boxes.join(wanted, "box").select("box", *(f"{s}_{c}" for c in limits for s in ("lo", "hi")))
        names = [f"__p{k}" for k in range(len(limits))]
        share = [(F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) for c in limits]
        extent = [(F.col(f"hi_{c}") - F.col(f"lo_{c}")) * (radius / time_eps if c == "t" and time_eps else 1.0) for c in limits]
        least = F.sort_array(F.array(*extent), asc=False)[min(CUT_AXES, len(limits)) - 1]
        wide = [(e > 0) & (e >= least) for e in extent]
        parts = [F.when(cut, F.floor(x * CUT)).otherwise(0).alias(n) for cut, x, n in zip(wide, share, names, strict=True)]
        cut = scratch.save(boxed.drop("first").join(whole, "box").select(F.col("box").alias("of"), *kept, *parts), "cut")
        boxes = scratch.save(cut.groupBy("of", "label", *names).agg(*_box(limits)), "boxes")
        boxed = cut.join(boxes.select("of", *names, "box", "first"), ["of", *names]).select("box", "first", *kept)
        numbers = ["of", *names]
        cx, cy = (boxes.select(F.col("of").alias(s), F.col("box").alias(f"{s}_box")) for s in "xy")
        found = large.join(cx, "x").join(cy, "y").select("x_box", "y_box", "bound")
        x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    out = reduce(DataFrame.unionByName, edges)
    return out.groupBy("a", "b").agg(F.min("e").alias("e")).select("a", "b", "e.u", "e.v", "e.w")
