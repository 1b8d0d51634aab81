"""Parameters of a clustering run and their checks."""

from __future__ import annotations

from dataclasses import dataclass

ALGORITHMS = ("dbscan", "stdbscan", "hdbscan")


@dataclass(frozen=True)
class ClusterParams:
    """What a clustering needs to know.

    `min_pts` counts the point itself; None means `min_cluster_size` and is allowed for hdbscan only.
    `geo` is True, False or "auto" (by the first row).  `strict` asks for a positive eps also where the
    algorithm ignores it.
    """

    algorithm: str = "dbscan"
    eps: float = 0.0
    min_pts: int | None = None
    min_cluster_size: int = 1
    time_eps: int = 0
    lng_field: str = "lng"
    lat_field: str = "lat"
    time_field: str = "timestamp"
    geo: bool | str = "auto"
    tie_break: str = "canonical"
    strict: bool = False

    @property
    def kind(self) -> str:
        """The algorithm by its name in any case; unknown names mean dbscan."""
        name = self.algorithm.lower()
        return name if name in ALGORITHMS else "dbscan"

    @property
    def points_needed(self) -> int:
        return self.min_cluster_size if self.min_pts is None else self.min_pts

    def check(self) -> ClusterParams:
        """Raise ValueError for a value out of range, else return self."""
        if (self.kind != "hdbscan" or self.strict) and not self.eps > 0:
            raise ValueError("eps must be positive")
        if self.min_pts is None and self.kind != "hdbscan" or self.points_needed < 1:
            raise ValueError("minPts must be at least 1")
        if self.min_cluster_size < 1:
            raise ValueError("minClusterSize must be at least 1")
        if self.kind == "stdbscan" and self.time_eps <= 0:
            raise ValueError("timeEps must be positive")
        if self.tie_break not in ("canonical", "prim"):
            raise ValueError("tie_break must be canonical or prim")
        return self
