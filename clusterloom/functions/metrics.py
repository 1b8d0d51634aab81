"""Distances between points, as column expressions.

A metric offers ``distance`` (in its unit), ``comparable`` (a cheaper number in the same order) and
``threshold`` (a distance turned into that number).  If a grid of cells can prune it, ``axes`` gives
coordinates whose Euclidean distance is never above the metric's, up to ``slack``; ``spread`` gives
the greatest distance that goes with such a Euclidean one, and ``straight`` is its inverse.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: mean radius of the earth in kilometres (fixed value)
EARTH_KM = 6371.0
#: dimensions that a grid cuts; distances use all
GRID_DIMENSIONS = 3


def squared_euclidean(a: list[Column], b: list[Column]) -> Column:
    """Sum of squared differences over the dimensions that both points have."""
    total = F.lit(0.0)
    for p, q in zip(a, b, strict=False):
        total = total + (p - q) * (p - q)
    return total


def squared_euclidean_arrays(a: Column, b: Column) -> Column:
    """The same for arrays of doubles of any length; the longer one is cut."""
    n = F.least(F.size(a), F.size(b))
    squares = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda p, q: (p - q) * (p - q))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def haversine_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    return F.lit(2.0 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


class Metric(Protocol):
    #: `comparable` is the square of `distance`
    squared: bool
    #: rounding of `axes`, in the metric's unit; None if no grid can prune
    slack: float | None

    def distance(self, a: list[Column], b: list[Column]) -> Column: ...
    def comparable(self, a: list[Column], b: list[Column]) -> Column: ...
    def threshold(self, eps: float) -> float: ...
    def axes(self, a: list[Column]) -> list[Column]: ...
    def spread(self, straight: Column) -> Column: ...
    def straight(self, eps: float) -> float: ...


class Euclidean:
    squared, slack = True, 0.0

    def distance(self, a: list[Column], b: list[Column]) -> Column:
        return F.sqrt(squared_euclidean(a, b))

    def comparable(self, a: list[Column], b: list[Column]) -> Column:
        return squared_euclidean(a, b)

    def threshold(self, eps: float) -> float:
        return eps * eps

    def axes(self, a: list[Column]) -> list[Column]:
        return a

    def spread(self, straight: Column) -> Column:
        return straight

    def straight(self, eps: float) -> float:
        return eps


class Haversine:
    """Great-circle kilometres between (longitude, latitude) in degrees."""

    squared, slack = False, 1e-8

    def distance(self, a: list[Column], b: list[Column]) -> Column:
        return haversine_km(a[0], a[1], b[0], b[1])

    comparable = distance

    def threshold(self, eps: float) -> float:
        return eps

    def axes(self, a: list[Column]) -> list[Column]:
        """The place in space: a chord is never longer than its arc, at the poles and across the date line too."""
        lng, lat = F.radians(a[0]), F.radians(a[1])
        return [EARTH_KM * F.cos(lat) * F.cos(lng), EARTH_KM * F.cos(lat) * F.sin(lng), EARTH_KM * F.sin(lat)]

    def spread(self, straight: Column) -> Column:
        return F.lit(2.0 * EARTH_KM) * F.asin(F.least(straight / F.lit(2.0 * EARTH_KM), F.lit(1.0)))

    def arc(self, straight: float) -> float:
        return 2 * EARTH_KM * math.asin(min(straight / (2 * EARTH_KM), 1.0))

    def straight(self, eps: float) -> float:
        return 2 * EARTH_KM * math.sin(min(eps / (2 * EARTH_KM), math.pi / 2))


class PythonMetric:
    """A distance given as a function of two lists of numpy columns, run over Arrow batches.

    With `triangle` it is symmetric and obeys the triangle inequality, so distances to pivots prune a join
    (see `operators.pivots`).  Else nothing is known of it, and a join compares all pairs: of up to
    `most_points` points, which the caller answers for.
    """

    squared, slack = False, None

    def __init__(self, function: Callable, most_points: int = 20_000, triangle: bool = False):
        self.function, self.most_points, self.triangle = function, most_points, triangle

    def to_each(self, a: list[Column], others: list[tuple[float, ...]]) -> Column:
        """Distances to a few fixed points, as an array."""
        function = self.function

        @F.pandas_udf("array<double>")
        def call(*columns: pd.Series) -> pd.Series:
            values = [c.to_numpy(float) for c in columns]
            found = [np.broadcast_to(function(values, [np.full(len(values[0]), x) for x in p]), len(values[0])) for p in others]
            return pd.Series(list(np.stack(found, axis=1).astype(float)))

        return call(*a)

    def distance(self, a: list[Column], b: list[Column]) -> Column:
        function, n = self.function, len(a)

        @F.pandas_udf("double")
        def call(*columns: pd.Series) -> pd.Series:
            values = [c.to_numpy() for c in columns]
            return pd.Series(function(values[:n], values[n:]))

        return call(*a, *b)

    comparable = distance

    def threshold(self, eps: float) -> float:
        return eps
