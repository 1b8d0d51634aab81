"""One call from a table or file to a clustering result."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clusterloom.operators import result
from clusterloom.operators.dbscan import dbscan, st_dbscan
from clusterloom.operators.hdbscan import hdbscan
from clusterloom.params import ClusterParams
from clusterloom.plans.scratch import Scratch
from clusterloom.sources.points import numbered, points, read_csv, write_csv

_log = logging.getLogger(__name__)


class ClusterResult(NamedTuple):
    """`rows` are the usable input rows; `labels` (row_id, cluster_id).  Both read tables that `drop` deletes; what can
    be downloaded is kept.
    """

    rows: DataFrame
    labels: DataFrame
    download_id: str
    scratch: Scratch

    def drop(self) -> None:
        self.scratch.drop_all()

    def summary(self) -> DataFrame:
        return result.summary(self.labels)

    def response(self, params: ClusterParams) -> DataFrame:
        return result.response(self.rows, self.labels, params.lng_field, params.lat_field, self.download_id)


def labels_of(found: DataFrame, params: ClusterParams, scratch: Scratch | None = None) -> DataFrame:
    """(row_id, cluster_id) of points (row_id, x, y, t); the tables that it reads belong to `scratch` if given."""
    params.check()
    if params.kind == "hdbscan":
        return hdbscan(found, params.points_needed, params.min_cluster_size, geo=params.geo, tie_break=params.tie_break, scratch=scratch)
    if params.kind == "stdbscan":
        return st_dbscan(found, params.eps, params.points_needed, params.min_cluster_size, params.time_eps, geo=params.geo, scratch=scratch)
    return dbscan(found, params.eps, params.points_needed, params.min_cluster_size, geo=params.geo, scratch=scratch)


def answer(call: Callable[[], object]) -> tuple[int, object]:
    """What a service would answer for `call`: its result with 200, or a message.

    400 and the message for a bad parameter or file, 404 for an unknown result, else 500 and no details,
    which go to the log.
    """
    try:
        return 200, call()
    except KeyError:
        return 404, {"error": "Result not found"}
    except ValueError as said:
        return 400, {"error": str(said)}
    except Exception:
        _log.exception("failed")
        return 500, {"error": "Internal server error"}


def cluster(source: DataFrame | str, params: ClusterParams, spark: SparkSession | None = None, multi_line: bool = True) -> ClusterResult:
    """Cluster a table (any DataFrame; row_id is added if missing, and to be unique if not) or a CSV file (see `read_csv`).

    Rows without usable role columns are left out.  The result rows are kept for `download`.
    """
    params.check()
    spark = source.sparkSession if isinstance(source, DataFrame) else spark or SparkSession.active()
    scratch = Scratch(spark, "cluster")
    if isinstance(source, str):
        rows = read_csv(spark, source, multi_line, scratch)
    else:
        rows = source if "row_id" in source.columns else numbered(source, scratch=scratch)
    rows = scratch.save(rows, "rows")
    scratch.keep_only("rows")
    seen = Observation()
    found = scratch.save(points(rows, params).observe(seen, F.count(F.lit(1)).alias("n")), "points")
    _log.info("%s points from %s", seen.get["n"], params)
    seen = Observation()
    noise = F.count_if(F.col("cluster_id") == result.NOISE).alias("noise")
    last = F.max("cluster_id").alias("last")
    labels = scratch.save(labels_of(found, params, scratch).observe(seen, last, noise), "labels")
    _log.info("%s clusters, %s points of noise", (seen.get["last"] if seen.get["last"] is not None else -1) + 1, seen.get["noise"])
    kept = rows.join(labels.select("row_id"), "row_id", "left_semi")
    key = result.ResultCache(spark).put(result.attach(kept, labels))
    _log.info("result %s", key)
    scratch.keep_only("rows", "labels")
    return ClusterResult(kept, labels, key, scratch)


def download(spark: SparkSession, download_id: str, path: str | None = None, one_file: bool = True, max_age: float | None = None) -> DataFrame:
    """The rows of an earlier result, of this or another driver, written to `path` as CSV if given (see `write_csv`).

    KeyError for an unknown id, and for a result older than `max_age` seconds.
    """
    rows = result.ResultCache(spark, max_age).get(download_id)
    if rows is None:
        raise KeyError(download_id)
    if path:
        write_csv(rows, path, one_file)
    return rows
