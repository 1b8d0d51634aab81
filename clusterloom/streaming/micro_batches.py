"""Clustering anew, over a bounded horizon, whenever points arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.api import labels_of
from clusterloom.params import ClusterParams
from clusterloom.plans.scratch import Scratch


def recluster(stream: DataFrame, params: ClusterParams, horizon_ms: int, sink: Callable[[DataFrame, int], None], scratch: Scratch):
    """A writer that, per micro-batch, labels all points of the last `horizon_ms` and hands them to `sink`.

    `stream` has row_id, x, y and t.  The horizon's points are a table in the shared folder, so state is
    bounded by the horizon and survives lost executors; a replayed batch replaces rows by row_id.
    """
    state: dict[str, DataFrame] = {}

    def step(batch: DataFrame, number: int) -> None:
        known = state.get("points")
        both = batch if known is None else batch.unionByName(known.join(batch.select("row_id"), "row_id", "left_anti"))
        newest = both.agg(F.max("t")).first()[0]
        if newest is None:
            return
        state["points"] = scratch.save(both.where(F.col("t") > newest - horizon_ms), "horizon")
        sink(labels_of(state["points"], params), number)

    return stream.select("row_id", "x", "y", "t").writeStream.foreachBatch(step)
