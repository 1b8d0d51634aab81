"""Longitude and latitude: detection and projection to a local plane in kilometres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.metrics import Euclidean, Haversine, Metric

#: kilometres per degree of latitude (fixed value)
KM_PER_DEGREE = 111.32
#: decimal places of a latitude in the mean
EXACT = 18


def looks_geo(points: DataFrame, columns: list[str]) -> bool:
    """Whether the first row (smallest row_id) lies in the range of (longitude, latitude); two dimensions only."""
    if len(columns) != 2:
        return False
    first = points.agg(F.min_by(F.struct(*columns), "row_id").alias("p")).first()["p"]
    return first is not None and abs(first[0]) <= 180 and abs(first[1]) <= 90


def auto_metric(points: DataFrame, columns: list[str]) -> Metric:
    """Haversine where the first row looks like longitude and latitude, else Euclidean; for unprojected points."""
    return Haversine() if looks_geo(points, columns) else Euclidean()


def project_km(points: DataFrame, lng: str = "x", lat: str = "y") -> DataFrame:
    """`points` with both columns replaced by kilometres on a plane around the mean latitude of all rows.

    The mean is one number, read by the driver, so the projection itself stays a narrow expression.  Latitudes
    are added up as decimals of EXACT places, so it is the same to the last bit however rows are
    partitioned; only where one is too large for that, doubles are added in any order.
    """
    exact = F.col(lat).cast("double").try_cast(f"decimal(38,{EXACT})")
    stats = points.agg(F.try_sum(exact).alias("sum"), F.count(exact).alias("exact"), F.count(lat).alias("n"), F.avg(lat).alias("mean")).first()
    if stats["mean"] is None:
        return points
    mean = float(stats["sum"]) / stats["n"] if stats["exact"] == stats["n"] and stats["sum"] is not None else stats["mean"]
    scale = F.lit(KM_PER_DEGREE) * F.cos(F.radians(F.lit(mean)))
    return points.withColumn(lng, F.col(lng) * scale).withColumn(lat, F.col(lat) * KM_PER_DEGREE)


def to_plane(points: DataFrame, columns: list[str], geo: bool | str = "auto") -> DataFrame:
    """`points` projected if `geo` says so, or by its first row if `geo` is "auto"."""
    if geo is True or geo == "auto" and looks_geo(points, columns):
        return project_km(points, *columns)
    return points
