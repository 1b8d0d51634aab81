"""Candidate pairs of points for a distance of which only the triangle inequality is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: points that others are measured against; a pivot's share of the points is a cell
PIVOTS = 64
#: by how much bounds are widened against the rounding of distances
LOOSE = 1e-9


def pivot_pairs(sides: tuple[DataFrame, DataFrame], columns: list[str], metric, eps: float, pivots: int = PIVOTS) -> DataFrame:
    """Pairs of rows of the two `sides` (u_.. and v_..: the same points) with u_row_id <= v_row_id, among them all within `eps`.

    Every point is measured against a few pivots, drawn by a hash, and belongs to the nearest one.  A point u
    within eps of v is at most 2 eps farther from v's pivot than from its own, and its distance from that
    pivot differs from v's by eps at most.  So v goes to its own cell, in rings as wide as eps; u goes to
    all cells that are near enough, in the ring it would be in and the two next to it; and an equi-join on cell
    and ring meets every pair once.  AQE splits rings with very many points.
    """
    left, right = sides
    drawn = right.select("v_row_id", *(f"v_{c}" for c in columns)).orderBy(F.xxhash64("v_row_id"), "v_row_id").limit(pivots).collect()
    if not drawn:
        return left.join(right, F.lit(False))
    others = [tuple(float(r[f"v_{c}"]) for c in columns) for r in drawn]
    wide = max(eps * (1 + LOOSE), 1e-300)

    def placed(side: DataFrame, s: str) -> tuple[DataFrame, Column]:
        far = side.withColumn("__to", metric.to_each([F.col(f"{s}_{c}").cast("double") for c in columns], others))
        return far.withColumn("__least", F.array_min("__to")), F.lit(LOOSE) * (F.col("__least") + eps)

    def ring(distance: Column) -> Column:
        return F.floor(F.least(distance / wide, F.lit(float(1 << 52))))

    near, slack = placed(left, "u")
    cells = F.filter(F.transform("__to", lambda d, i: F.struct(i.alias("cell"), d.alias("d"))), lambda x: x["d"] <= F.col("__least") + 2 * eps + 2 * slack)
    near = near.withColumn("__at", F.explode(cells)).drop("__to", "__least")
    near = near.select(*left.columns, F.col("__at.cell").alias("__cell"), F.explode(F.array(*(ring(F.col("__at.d")) + k for k in (-1, 0, 1)))).alias("__ring"))
    own, _ = placed(right, "v")
    own = own.select(*right.columns, (F.array_position("__to", F.col("__least")) - 1).cast("int").alias("__cell"), ring(F.col("__least")).alias("__ring"))
    return near.join(own, ["__cell", "__ring"]).drop("__cell", "__ring").where("u_row_id <= v_row_id")
