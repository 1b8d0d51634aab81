"""Fixed-radius classes of points from tiles of neighbouring points, without rows for pairs or cells around a point.

A tree of cuts, taken from a bounded sample, deals the points to tiles of about equal size.  Points of
one tile are compared in a task; after that a point visits another tile only if that can still tell something
and the tile's box is in reach: an undecided one to be counted, a core point where the tile is not in its class yet,
a border point for its label.  So a visit is a row, and a comparison is a cell of a block of numbers inside a task.

Boxes are bounds of axes that never differ by more than the distance: the coordinates (and the time), or for a
metric of your own the distances to a few pivots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.metrics import Metric
from clusterloom.operators.all_pairs import rounded
from clusterloom.operators.components import connected_components, merge_classes
from clusterloom.operators.joins import WIDER
from clusterloom.plans.scratch import Scratch

#: points of a tile, about, up to MOST_TILES of them (the driver gets a row per tile); beyond, tiles are larger
TILE, MOST_TILES = 2048, 1 << 13
#: tiles of a join of pairs, about, and the most points in one
WIDE_TILES, WIDE = 128, 1 << 16
#: pairs that leave a task at once, about
PAIRS = 1 << 20
#: points of the sample that the cuts are taken from
SAMPLE = 1 << 15
#: visitors of a tile that a task takes at a time, about
VISITORS = 1 << 15
#: pairs that are compared at once
CELLS = 1 << 16
#: points of a class that visit other tiles first
FIRST = 32
#: pivots of a metric of your own
PIVOTS = 6
#: from so many dimensions on, a matrix product tells most pairs
PRODUCT_FROM = 4


class Space:
    """The axes of points and which of them are close; points are a column each, with the time as last row where there is one."""

    def __init__(self, columns: list[str], eps: float, metric: Metric, time_eps: int | None, pivots: list[list[float]]):
        self.names, self.time_eps, self.pivots = [*columns, *(["t"] if time_eps is not None else [])], time_eps, pivots
        self.function, self.limit = getattr(metric, "function", None), metric.threshold(eps)
        self.n, self.reach = len(columns), np.array([eps * WIDER] * (len(pivots) if self.function else len(columns)) + [time_eps] * (time_eps is not None), float)

    def of(self, table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
        return [table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in self.names]

    def axes(self, points: list[np.ndarray]) -> np.ndarray:
        found = points[: self.n]
        if self.function:
            found = [np.broadcast_to(self.function(found, [np.full(len(found[0]), x) for x in p]), found[0].shape) for p in self.pivots]
        return np.array([*found, *points[self.n :]], float).reshape(len(self.reach), len(points[0]))

    def close(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Whether each of `a` is close to each of `b`."""
        shape = len(a[0]), len(b[0])
        if self.function:
            sides = [np.repeat(x, shape[1]) for x in a[: self.n]], [np.tile(y, shape[0]) for y in b[: self.n]]
            found = (np.broadcast_to(self.function(*sides), shape[0] * shape[1]) <= self.limit).reshape(shape)
        elif self.n < PRODUCT_FROM:
            found = self._summed([x[:, None] for x in a[: self.n]], [y[None] for y in b[: self.n]])
        else:
            x, y = np.array(a[: self.n], float), np.array(b[: self.n], float)
            lengths = [np.einsum("ij,ij->j", v, v) for v in (x, y)]
            apart = (-2.0 * x).T @ y
            apart += lengths[0][:, None]
            apart += lengths[1]
            # What the product leaves in doubt is summed as the metric does.
            error = (self.n + 8) * 2.0**-50 * (lengths[0].max(initial=0) + lengths[1].max(initial=0) + self.limit)
            found = apart <= self.limit
            rows, others = np.nonzero(~(np.abs(apart - self.limit) > error))
            if len(rows):
                found[rows, others] = self._summed([v[rows] for v in x], [v[others] for v in y])
        if self.time_eps is not None:
            found &= np.abs(a[-1][:, None] - b[-1][None]) <= self.time_eps
        return found

    def distance(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """The distance of each of `a` to the one of `b` at its place."""
        if self.function:
            return np.broadcast_to(self.function(a[: self.n], b[: self.n]), len(a[0])).astype(float)
        total = 0.0
        for x, y in zip(a[: self.n], b[: self.n], strict=True):
            total = total + (x - y) * (x - y)
        return np.sqrt(total)

    def _summed(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total = total + (x - y) * (x - y)
        return total <= self.limit


def cuts(axes: np.ndarray, reach: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and place of the cuts of a tree of `depth` levels that halves these points, along their widest axis in units of the reach."""
    axis, place = np.zeros((1 << depth) - 1, int), np.full((1 << depth) - 1, np.inf)
    held = [np.arange(axes.shape[1])]
    for node in range(len(axis)):
        some = held[node]
        at = axes[:, some]
        wide = (at.max(axis=1) - at.min(axis=1)) / reach if len(some) > 1 else np.zeros(len(reach))
        right = np.zeros(len(some), bool)
        if len(some) > 1 and (wide > 0).any():
            axis[node] = int(np.nanargmax(wide))
            low, high = np.sort(at[axis[node]])[[(len(some) - 1) // 2, len(some) - 1]]
            values = at[axis[node]]
            place[node] = low if low < high else values[values < high].max()
            right = values > place[node]
        held[node] = None
        held += [some[~right], some[right]]
    return axis, place


def mixed(ids: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """A part for each id, whatever the order of ids."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.asarray(parts, np.uint64)).astype(np.int64)


def inner_classes(space: Space, points: list[np.ndarray]) -> np.ndarray:
    """For each of the points the place of the first one that it is linked to through close ones."""
    n = len(points[0])
    first, left, start = np.full(n, -1), np.arange(n), 0
    while len(left):
        start, queue, left = left[0], left[:1], left[1:]
        first[start] = start
        while len(queue) and len(left):
            step = max(1, CELLS // len(left))
            some, queue = queue[:step], queue[step:]
            met = space.close([x[some] for x in points], [x[left] for x in points]).any(axis=0)
            first[left[met]] = start
            queue, left = np.concatenate([queue, left[met]]), left[~met]
    return first


class Tiles:
    """Where tiles lie and which are near each other; `boxes` are (tile, n, axes' least and greatest)."""

    def __init__(self, space: Space, boxes: list):
        self.space = space
        self.ids = [r["tile"] for r in boxes]
        k = len(space.reach)
        limits = np.array([r["box"] for r in boxes], float).reshape(len(boxes), 2 * k).T
        # The rounding of distances to pivots goes with their size.
        self.reach = space.reach + 1e-9 * np.abs(limits).max(initial=0) if space.function else space.reach
        low, high = limits[:k], limits[k:]
        self.box = {t: (low[:, i], high[:, i]) for i, t in enumerate(self.ids)}
        self.near = {}
        for i, t in enumerate(self.ids):
            gap = np.maximum(low - high[:, i, None], low[:, i, None] - high)
            self.near[t] = [self.ids[j] for j in np.flatnonzero(~(gap > self.reach[:, None]).any(axis=0)).tolist() if j != i]

    def meet(self, visitors: DataFrame, hosts: DataFrame, many: dict[int, int], extra: list[str], compare: Callable, schema: str, wanted: Callable | None = None, home: bool = False, half: bool = False) -> DataFrame:
        """What `compare`(visitors, hosts) of each tile gives, `visitors` (with columns `extra`) of tiles near it, or also of their own for `home`.

        `many` says how many may set out from each tile; with `half` they visit no tiles of smaller numbers.
        `wanted`(row values of the first extra column, tile) picks those that shall visit it.
        """
        guests, there = self.arrivals(visitors, hosts, many, extra, wanted, home, half)
        out = [f.split() for f in schema.split(", ")]
        empty = pa.schema([(name, pa.int64()) for name, _ in out])

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return empty.empty_table()
            return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in compare(left, right)], schema=empty)

        return guests.groupBy("tile", "part").cogroup(there.groupBy("tile", "part")).applyInArrow(run, schema)

    def arrivals(self, visitors: DataFrame, hosts: DataFrame, many: dict[int, int], extra: list[str], wanted: Callable | None, home: bool, half: bool, most: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Visitors with the tile and the part of it that they visit, and hosts for every part of theirs; see `meet`."""
        space, box, reach = self.space, self.box, self.reach
        ways = {t: [b for b in ([t] if home else []) + self.near[t] if not half or b >= t] for t in self.ids if many.get(t)}
        come: dict[int, int] = {}
        for t, to in ways.items():
            for b in to:
                come[b] = come.get(b, 0) + many[t]
        parts = {b: -(-n // (most or VISITORS)) for b, n in come.items()}
        kept = ["row_id", *space.names, *extra]
        names = ["tile", "part", *kept]

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tiles, ids = (batch.column(c).to_numpy() for c in ("tile", "row_id"))
                axes, out = space.axes(space.of(batch)), []
                for t in np.unique(tiles).tolist():
                    mine = np.flatnonzero(tiles == t)
                    at = axes[:, mine]
                    for b in ways.get(t, []):
                        low, high = box[b]
                        go = ~((low[:, None] - at > reach[:, None]) | (at - high[:, None] > reach[:, None])).any(axis=0)
                        if wanted is not None:
                            go &= wanted(batch.column(extra[0]).to_numpy(zero_copy_only=False)[mine], b)
                        if go.any():
                            out.append((b, mine[go]))
                if out:
                    rows = np.concatenate([r for _, r in out])
                    to = np.repeat([b for b, _ in out], [len(r) for _, r in out])
                    part = mixed(ids[rows], np.repeat([parts[b] for b, _ in out], [len(r) for _, r in out]))
                    taken = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(part), *(taken.column(c) for c in kept)], names)

        def hosted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tiles = batch.column("tile").to_numpy()
                copies = np.array([parts.get(t, 0) for t in tiles.tolist()], int)
                rows = np.repeat(np.arange(len(tiles)), copies)
                if len(rows):
                    part = np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)
                    taken = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([taken.column("tile"), pa.array(part), *(taken.column(c) for c in batch.schema.names if c != "tile")], ["tile", "part", *(c for c in batch.schema.names if c != "tile")])

        types = dict(visitors.dtypes)
        guests = visitors.mapInArrow(visit, ", ".join(f"{c} {types.get(c, 'long')}" for c in names))
        others = [c for c in hosts.columns if c != "tile"]
        return guests, hosts.mapInArrow(hosted, ", ".join(f"{c} {dict(hosts.dtypes).get(c, 'long')}" for c in ["tile", "part", *others]))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def blocks(space: Space, a: list[np.ndarray], b: list[np.ndarray], rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in a, whether each is close to each of b), by blocks of rows of `a`."""
    rows = np.arange(len(a[0])) if rows is None else rows
    step = max(1, CELLS // max(1, len(b[0])))
    for k in range(0, len(rows), step):
        some = rows[k : k + step]
        yield some, space.close([x[some] for x in a], b)


def _counted(space: Space) -> Callable:
    def compare(left: pa.Table, right: pa.Table) -> tuple:
        a, b, copies = space.of(left), space.of(right), _column(right, "copies").astype(float)
        near = np.concatenate([close.astype(float) @ copies for _, close in blocks(space, a, b)]).astype(np.int64)
        met = near > 0
        return _column(left, "row_id")[met], near[met]

    return compare


def _linked(space: Space) -> Callable:
    """Edges between classes of visitors and hosts, no more than join them."""

    def compare(left: pa.Table, right: pa.Table) -> tuple:
        a, b = space.of(left), space.of(right)
        names, codes = np.unique(np.concatenate([_column(left, "label"), _column(right, "label")]), return_inverse=True)
        x, y = codes[: left.num_rows], codes[left.num_rows :]
        root = np.arange(len(names))
        step = max(1, CELLS // max(1, len(y)))
        waiting = np.arange(len(x))
        while len(waiting):
            some, waiting = waiting[:step], waiting[step:]
            apart = root[x[some]][:, None] != root[y][None]
            p, q = np.nonzero(space.close([v[some] for v in a], b) & apart)
            if len(p):
                root = merge_classes(root, x[some][p], y[q])
                if len(ends := np.unique(root[y])) == 1:
                    waiting = waiting[root[x[waiting]] != ends[0]]
        moved = np.flatnonzero(root != np.arange(len(names)))
        return names[moved], names[root[moved]]

    return compare


def _least(space: Space) -> Callable:
    def compare(left: pa.Table, right: pa.Table) -> tuple:
        a, b = space.of(left), space.of(right)
        order = np.argsort(_column(right, "label"), kind="stable")
        labels, b = _column(right, "label")[order], [v[order] for v in b]
        found = [(some[close.any(axis=1)], labels[close.argmax(axis=1)[close.any(axis=1)]]) for some, close in blocks(space, a, b)]
        return _column(left, "row_id")[np.concatenate([r for r, _ in found])], np.concatenate([x for _, x in found])

    return compare


def _pivots(sample: list[np.ndarray], function: Callable) -> list[list[float]]:
    """Points of the sample that lie far from each other."""
    found, least = [], np.full(len(sample[0]), np.inf)
    at = 0
    for _ in range(min(PIVOTS, len(sample[0]))):
        found.append([float(x[at]) for x in sample])
        least = np.minimum(least, function(sample, [np.full(len(sample[0]), x) for x in found[-1]]))
        at = int(np.nanargmax(least))
    return found


def _assigned(space: Space, axis: np.ndarray, place: np.ndarray, parts: np.ndarray | None) -> Callable:
    """Rows with the leaf of the tree they belong to, and its part where it has `parts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            axes = space.axes(space.of(batch))
            node, every = np.zeros(batch.num_rows, int), np.arange(batch.num_rows)
            while len(axis) and batch.num_rows and node[0] < len(axis):
                node = 2 * node + 1 + (axes[axis[node], every] > place[node])
            leaf = node - len(axis)
            if parts is not None:
                leaf = leaf + (len(axis) + 1) * mixed(batch.column("row_id").to_numpy(), parts[leaf])
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["tile", *batch.schema.names])

    return run


def dealt(places: DataFrame, eps: float, columns: list[str], metric: Metric, time_eps: int | None, tile: int | None = None) -> tuple[Space, DataFrame]:
    """The space of `places`, and they with their tile before the other columns."""
    n = places.count()
    tile = tile or min(max(TILE, n // WIDE_TILES), WIDE)
    some = places.where(F.pmod(F.xxhash64("row_id"), F.lit(-(-n // SAMPLE) or 1)) == 0).select(*columns, *(["t"] if time_eps is not None else [])).toArrow()
    if not n or not some.num_rows:
        some = places.limit(1).select(*some.schema.names).toArrow()
    sample = [some.column(c).to_numpy() for c in some.schema.names]
    own = getattr(metric, "function", None)
    space = Space(columns, eps, metric, time_eps, _pivots(sample[: len(columns)], own) if own and n else [[0.0] * len(columns)])
    depth = max(0, min(MOST_TILES, -(-n // tile)) - 1).bit_length()
    axis, place = cuts(space.axes(sample), space.reach, depth)
    types = dict(places.dtypes)
    rows = ", ".join(f"{c} {types.get(c, 'long')}" for c in ["tile", *places.columns])
    counts = places.mapInArrow(_assigned(space, axis, place, None), rows).groupBy("tile").count().collect()
    parts = np.ones(len(axis) + 1, int)
    for r in counts:
        parts[r["tile"]] = -(-r["count"] // (4 * max(tile, n >> depth)))
    return space, places.mapInArrow(_assigned(space, axis, place, parts), rows)


def tile_pairs(chunks: DataFrame, eps: float, columns: list[str], metric: Metric, digits: int | None, scratch: Scratch, tile: int | None = None) -> DataFrame:
    """(u, v, distance) of all ordered pairs of ids of `chunks` (row_id, `columns`, ids: equal points) at most `eps` apart, each with itself.

    Tiles are larger here, so few points visit another one.  Pairs leave a task as lists of ids and
    distances, of a bounded number at a time, and nothing is shuffled after that.
    """
    space, given = dealt(chunks.select("row_id", *columns, "ids"), eps, columns, metric, None, tile)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, axes = batch.column("tile").to_numpy(), space.axes(space.of(batch))
            every = np.unique(tiles)
            found = [axes[:, tiles == t] for t in every.tolist()]
            sides = np.array([np.concatenate([x.min(axis=1), -x.max(axis=1)]) for x in found]).reshape(len(every), -1)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array([x.shape[1] for x in found], pa.int64()), *(pa.array(c) for c in sides.T)], ["tile", "n", *limits])

    limits = [f"b{k}" for k in range(2 * len(space.reach))]
    given = scratch.save(given, "given")
    stats = given.mapInArrow(bounds, f"tile long, n long, {', '.join(f'{c} double' for c in limits)}").groupBy("tile").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in limits)).collect()
    half = len(space.reach)
    tiles = Tiles(space, [{"tile": r["tile"], "box": [r[c] for c in limits[:half]] + [-r[c] for c in limits[half:]]} for r in stats])
    given = given.withColumn("home", F.col("tile"))
    guests, there = tiles.arrivals(given, given, {r["tile"]: r["n"] for r in stats}, ["home", "ids"], None, True, True, WIDE * 8)
    met = guests.withColumn("guest", F.lit(True)).unionByName(there.withColumn("guest", F.lit(False)))

    def expand(a: tuple[np.ndarray, np.ndarray], r: np.ndarray, c: np.ndarray, distances: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows (id, others, distances, inner) for pairs of the chunks r[k] and c[k], in order of r."""
        (starts, values), sizes = a, np.diff(a[0])
        for inner in (False, True):
            mine = np.flatnonzero((r == c) == inner)
            x, y, d = r[mine], c[mine], distances[mine]
            if (sizes[x] == 1).all():
                rows, counts = np.unique(x, return_counts=True)
                n = sizes[y]
                at = np.repeat(starts[y] - np.cumsum(n) + n, n) + np.arange(n.sum())
                ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts))]
                yield _listed(values[starts[rows]], values[at], np.repeat(d, n), ends, inner)
                continue
            for row in np.unique(x).tolist():
                low, high = np.searchsorted(x, [row, row + 1])
                others = np.concatenate([values[starts[k] : starts[k + 1]] for k in y[low:high].tolist()])
                far = np.repeat(d[low:high], sizes[y[low:high]])
                own, step = values[starts[row] : starts[row + 1]], max(1, PAIRS // len(others))
                for k in range(0, len(own), step):
                    some = own[k : k + step]
                    yield _listed(some, np.tile(others, len(some)), np.tile(far, len(some)), np.arange(len(some) + 1) * len(others), inner)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        guest = _column(table, "guest")
        if guest.all() or not guest.any():
            return
        points, homes, names = space.of(table), _column(table, "home"), _column(table, "row_id")
        lists = table.column("ids").combine_chunks()
        held = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        axes = space.axes(points)
        come, here = np.flatnonzero(guest), np.flatnonzero(~guest)
        along = axes[int(np.argmax((axes[:, here].max(axis=1) - axes[:, here].min(axis=1)) / space.reach))]
        come, here = come[np.argsort(along[come], kind="stable")], here[np.argsort(along[here], kind="stable")]
        # A chunk that meets itself is one row as guest and one as host; it goes by its row as host.
        edge, low = float(np.max(tiles.reach)), 0
        while low < len(come):
            first = np.searchsorted(along[here], along[come[low]] - edge)
            high = min(len(come), low + max(1, PAIRS // max(1, 1 + np.searchsorted(along[here], along[come[low]] + edge, side="right") - first)))
            last = np.searchsorted(along[here], along[come[high - 1]] + edge, side="right")
            some, others = come[low:high], here[first:last]
            low = high
            if not len(others):
                continue
            for k in range(0, len(some), max(1, CELLS // len(others))):
                rows = some[k : k + max(1, CELLS // len(others))]
                close = space.close([x[rows] for x in points], [x[others] for x in points])
                if (homes[rows] == key[0].as_py()).any():
                    close &= (homes[rows] != key[0].as_py())[:, None] | (names[rows][:, None] <= names[others][None])
                p, q = np.nonzero(close)
                if len(p):
                    r, c = rows[p], others[q]
                    distances = space.distance([x[r] for x in points], [x[c] for x in points])
                    if digits is not None:
                        distances = rounded(distances, digits)
                    same = names[r] == names[c]
                    r = np.where(same, c, r)
                    order = np.argsort(r, kind="stable")
                    yield from expand(held, r[order], c[order], distances[order])

    found = met.repartition(4 * max(len(stats), 1), "tile", "part").groupBy("tile", "part").applyInArrow(run, "id long, others array<long>, distances array<double>, inner boolean")
    pairs = found.select("id", "distances", "inner", F.posexplode("others").alias("k", "other")).select("id", "other", F.get("distances", F.col("k")).alias("distance"), "inner")
    ways = [F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (("id", "other"), ("other", "id"))]
    pairs = pairs.select("distance", F.explode(F.when(F.col("inner"), F.array(ways[0])).otherwise(F.array(*ways))).alias("p"))
    return pairs.select("p.u", "p.v", "distance")


def _listed(ids: np.ndarray, others: np.ndarray, distances: np.ndarray, ends: np.ndarray, inner: bool) -> pa.RecordBatch:
    ends = pa.array(ends.astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (others, distances)]
    return pa.RecordBatch.from_arrays([pa.array(ids), *lists, pa.array(np.full(len(ids), inner))], ["id", "others", "distances", "inner"])


def tile_labels(places: DataFrame, eps: float, min_pts: int, columns: list[str], metric: Metric, time_eps: int | None, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """(row_id, label) of `places` (see `joins.gathered`), before any size filter; those that are noise are left out.

    For Euclidean distances, and metrics of your own that obey the triangle inequality.
    """
    timed = ["t"] if time_eps is not None else []
    kept = ["row_id", *columns, *timed, "copies"]
    space, tiled = dealt(places.select(*kept), eps, columns, metric, time_eps, tile)
    types = dict(places.dtypes)
    rows = ", ".join(f"{c} {types.get(c, 'long')}" for c in ["tile", *kept])
    box_type = pa.list_(pa.float64())

    def inside(key: tuple, table: pa.Table) -> pa.Table:
        points, copies = space.of(table), _column(table, "copies").astype(float)
        near = np.concatenate([close.astype(float) @ copies for _, close in blocks(space, points, points)]).astype(np.int64)
        axes = space.axes(points)
        box = [np.concatenate([axes.min(axis=1), axes.max(axis=1)]).tolist()] + [None] * (table.num_rows - 1)
        return table.append_column("near", pa.array(near)).append_column("box", pa.array(box, box_type))

    seen = scratch.save(tiled.groupBy("tile").applyInArrow(inside, f"{rows}, near long, box array<double>"), "seen")
    stats = seen.groupBy("tile").agg(F.max("box").alias("box"), F.count_if(F.col("near") < min_pts).alias("open")).collect()  # a row per tile
    tiles, many = Tiles(space, stats), {r["tile"]: r["open"] for r in stats}
    seen = seen.drop("box")
    out_of = seen.where(F.col("near") < min_pts)
    counted = tiles.meet(out_of, seen.select("tile", *kept), many, [], _counted(space), "row_id long, near long")
    counted = scratch.save(counted.groupBy("row_id").agg(F.sum("near").alias("more")), "counted")
    known = seen.join(counted, "row_id", "left").withColumn("near", F.col("near") + F.coalesce("more", F.lit(0))).select("tile", *kept, "near")
    known = scratch.save(known, "known")
    scratch.drop("seen")
    scratch.drop("counted")

    def classes(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(_column(table, "row_id"), kind="stable")))
        points = space.of(table)
        first = inner_classes(space, points)
        axes, early = space.axes(points), np.zeros(table.num_rows, bool)
        order = np.argsort(first, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(first[order]) > 0))
        for mine in np.split(order, starts[1:]):
            if len(mine) > FIRST:
                at = axes[:, mine]
                mine = mine[np.unique(np.concatenate([at.argmin(axis=1), at.argmax(axis=1), np.linspace(0, len(mine) - 1, FIRST).astype(int)]))]
            early[mine] = True
        return table.append_column("label", pa.array(_column(table, "row_id")[first])).append_column("early", pa.array(early))

    points = f"tile long, row_id long, {', '.join(f'{c} {types[c]}' for c in (*columns, *timed))}"
    core = known.where(F.col("near") >= min_pts).select("tile", "row_id", *columns, *timed)
    core = scratch.save(core.groupBy("tile").applyInArrow(classes, f"{points}, label long, early boolean"), "core")
    hosts = core.select("tile", *columns, *timed, "label")
    many = {r["tile"]: r["n"] for r in core.where("early").groupBy("tile").agg(F.count("*").alias("n")).collect()}
    links = tiles.meet(core.where("early"), hosts, many, ["label"], _linked(space), "u long, v long", half=True)
    named = _merged(core, links, scratch, "first")
    scratch.drop("core")
    stats = named.groupBy("tile").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count_if(~F.col("early")).alias("n")).collect()
    many, only = {r["tile"]: r["n"] for r in stats}, {r["tile"]: r["least"] if r["least"] == r["most"] else None for r in stats}

    def elsewhere(labels: np.ndarray, b: int) -> np.ndarray:
        """Whether a visit can join a class to another one."""
        return np.full(len(labels), b in only) if only.get(b) is None else labels != only[b]

    hosts = named.select("tile", *columns, *timed, "label")
    links = tiles.meet(named.where("not early"), hosts, many, ["label"], _linked(space), "u long, v long", elsewhere, half=True)
    named = _merged(named, links, scratch, "named")
    scratch.drop("first")
    edge = known.where((F.col("near") < min_pts) & (F.col("near") > F.col("copies")))
    many = {r["tile"]: r["n"] for r in edge.groupBy("tile").agg(F.count("*").alias("n")).collect()}
    border = tiles.meet(edge, named.select("tile", *columns, *timed, "label"), many, [], _least(space), "row_id long, label long", home=True)
    return named.select("row_id", "label").unionByName(border.groupBy("row_id").agg(F.min("label").alias("label")))


def _merged(core: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    found = connected_components(links, scratch=scratch).withColumnRenamed("node", "label")
    return scratch.save(core.join(found, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component").select(*core.columns), name)
