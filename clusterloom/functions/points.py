"""Building, parsing and printing points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_PATTERN = "yyyy-MM-dd HH:mm:ss"
#: weights up to this count as zero; their density is the largest double (fixed values)
LEAST_WEIGHT = 1e-12
MOST_DENSITY = 1.7976931348623157e308


def coordinates(*columns: Column) -> Column:
    return F.array(*(c.cast("double") for c in columns))


def coordinate(coords: Column, k: int) -> Column:
    """The k-th coordinate, zero where there is none."""
    return F.coalesce(F.get(coords, F.lit(k)), F.lit(0.0))


def parse_number(text: Column) -> Column:
    """A double, null where the text is none or is not finite."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def parse_millis(text: Column) -> Column:
    """Epoch milliseconds of a text of TIME_PATTERN in the session's time zone, null where it is none."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit(TIME_PATTERN)))


def millis(time: Column) -> Column:
    """Epoch milliseconds, rounded down, of a timestamp with or without time zone."""
    return F.unix_millis(time.cast("timestamp"))


def time_window(t: Column, time_eps: int) -> tuple[Column, Column]:
    return t - F.lit(time_eps), t + F.lit(time_eps)


def within_time(a: Column, b: Column, time_eps: int) -> Column:
    """Both ends included."""
    return F.abs(a - b) <= F.lit(time_eps)


def density(weight: Column) -> Column:
    return F.when(weight > LEAST_WEIGHT, 1 / weight).otherwise(F.lit(MOST_DENSITY))


def mutual_reachability(core_u: Column, core_v: Column, distance: Column) -> Column:
    return F.greatest(core_u, core_v, distance)


def point_text(coords: Column, cluster: Column) -> Column:
    parts = F.transform(coords, lambda v, i: F.concat(F.lit("coord"), i.cast("string"), F.lit("="), v.cast("string")))
    return F.concat(F.lit("Point{"), F.array_join(parts, ", "), F.lit(", clusterId="), cluster.cast("string"), F.lit("}"))
