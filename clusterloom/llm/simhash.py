"""SimHash near-duplicates: exact comparison of fingerprints in tiles, by numpy xor and bit counts.

1. A document's fingerprint is taken from the XXH64 of its word shingles.  Equal fingerprints are
   one from here on, so copies cost one row however many there are.
2. Two fingerprints within the radius agree in at least one of (radius + 1) fixed bit ranges, so
   only fingerprints that share a range need comparing.  Each such bucket is put in order of
   population count and cut into tiles; tile pairs whose counts lie further apart than the radius
   are skipped, the others are compared in full.  For very many fingerprints more ranges are fixed
   at once, with the same exact result.
3. A tile pair gives a spanning forest of the links it found, never all pairs, and connected
   components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterloom.llm import wordbytes
from clusterloom.llm.tables import fresh, table
from clusterloom.operators.components import connected_components, merge_classes
from clusterloom.plans.scratch import Scratch

SHINGLE = 4
RADIUS = 4
BITS = 64
#: fingerprints in a tile, about
TILE = 8192
#: with one fixed range a bucket holds 1/8192 of the fingerprints; a range more is fixed for every so many times as many
#: (two from 2^26 on, three from 2^39), so that buckets stay near a tile
ONE_RANGE_UPTO, NEXT_RANGE = 1 << 26, 1 << 13
_CHUNK = 1 << 16


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """The 64-bit fingerprint of each text; null, empty and blank texts have zero."""
    found = wordbytes.words(texts, lower=True)
    out = np.zeros(len(texts), np.uint64)
    counts = np.diff(found.first)
    # The shingles of a document start at its first words, one at least if it has a word.
    per = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), per)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per) + found.first[:-1][owner]
    last = np.minimum(at + shingle, found.first[1:][owner]) - 1
    data = found.text.tobytes()
    digest = xxhash.xxh64_intdigest
    starts, ends = found.start[at], found.end[last]
    ones = np.zeros((len(texts), BITS), np.int64)
    for low in range(0, len(at), _CHUNK):
        part = slice(low, low + _CHUNK)
        spans = zip(starts[part].tolist(), ends[part].tolist(), strict=True)
        hashes = np.fromiter((digest(data[a:b], seed) for a, b in spans), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        docs, first = np.unique(owner[part], return_index=True)
        ones[docs] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    over = (2 * ones > per[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).reshape(-1) if len(texts) else out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in wordbytes.slices(batches, "text"):
        prints = fingerprints_of(batch.column("text")).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the fingerprint's 64 bits as a signed bigint."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def bucket_keys(fp: Column, radius: int = RADIUS, fixed: int = 1) -> Column:
    """The keys of all buckets of a fingerprint, one for each choice of `fixed` out of radius + fixed bit ranges."""
    parts = radius + fixed
    edges = [round(i * BITS / parts) for i in range(parts + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(parts), fixed)):
        key = F.lit(n).cast("long")
        for i in chosen:
            size = edges[i + 1] - edges[i]
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << size) - 1)))
        keys.append(key)
    return F.array(*keys)


def tile_forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within `left`, or between `left` and `right`, as pairs of fingerprints.

    Both are put in order of population count, so a run of rows is compared only with the rows whose
    counts lie within the radius.
    """
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    other = left if right is None else right[np.argsort(np.bitwise_count(right), kind="stable")]
    shift = 0 if right is None else len(left)
    nodes = left if right is None else np.concatenate([left, other])
    counts, against = np.bitwise_count(left).astype(np.int64), np.bitwise_count(other).astype(np.int64)
    root = np.arange(len(nodes))
    for low in range(0, len(left), rows):
        part = slice(low, low + rows)
        begin = np.searchsorted(against, counts[low] - radius, "left")
        stop = np.searchsorted(against, counts[part][-1] + radius, "right")
        if right is None:
            begin = max(begin, low)
        if begin < stop:
            close = np.bitwise_count(left[part, None] ^ other[None, begin:stop]) <= radius
            i, j = np.nonzero(close)
            root = merge_classes(root, i + low, j + begin + shift)
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def _tile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (task, side); tasks may go on in the next batch."""
    rest = None
    for batch in batches:
        now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "a", "b", "side", "fp"))
        rest = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        bucket, a, b, _, _ = rest
        if len(bucket):
            new = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            if len(new):
                yield from _tasks([x[: new[-1]] for x in rest], np.concatenate([[0], new]))
                rest = tuple(x[new[-1] :] for x in rest)
    if rest is not None and len(rest[0]):
        yield from _tasks(rest, np.array([0, len(rest[0])]))


def _tasks(rows: tuple[np.ndarray, ...], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    _, _, _, side, fp = rows
    us, vs = [], []
    for low, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if stop - low < 2:
            continue
        prints = fp[low:stop].view(np.uint64)
        middle = int(np.searchsorted(side[low:stop], 1, "left"))
        u, v = tile_forest(prints[:middle], prints[middle:] if middle < stop - low else None)
        us.append(u)
        vs.append(v)
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])


def links(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE, fixed: int | None = None) -> DataFrame:
    """(u, v): spanning links between distinct fingerprints (column fp) that differ in `radius` bits or fewer.

    Buckets of up to `tile` fingerprints are one tile.  A larger bucket is cut by population count
    (and by a hash among equal counts) into tiles of about that size; its tile pairs become tasks of
    their own, so a group of any size is spread over tasks of bounded memory.
    """
    if fixed is None:
        fixed, upto, n = 1, ONE_RANGE_UPTO, prints.count()
        while n > upto:
            fixed, upto = fixed + 1, upto * NEXT_RANGE
    rows = prints.select("fp", F.explode(bucket_keys(F.col("fp"), radius, fixed)).alias("bucket"))
    ones = F.bit_count("fp").cast("int")
    classes = rows.groupBy("bucket", ones.alias("ones")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("bucket").orderBy("ones"))
    large = classes.select("bucket", "ones", "n", (upto - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy("bucket")).alias("all"))
    large = scratch.save(large.where(F.col("all") > tile).drop("all"), "large")
    hashed = F.shiftrightunsigned(F.xxhash64("fp"), 11).cast("double") / float(1 << 53)
    place = F.col("before") + F.floor(F.col("n") * hashed)
    if large.isEmpty():
        cut = rows.select("bucket", "fp", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("side"))
    else:
        # At most 65 rows a large bucket, and a bucket is large by holding over `tile` rows.
        placed = rows.withColumn("ones", ones).join(large, ["bucket", "ones"], "left")
        placed = placed.select("bucket", "ones", "fp", F.coalesce(F.floor(place / tile), F.lit(0)).cast("long").alias("tile"))
        placed = scratch.save(placed, "placed")
        tiles = placed.join(large.select("bucket").distinct(), "bucket", "left_semi")
        tiles = tiles.groupBy("bucket", "tile").agg(F.min("ones").alias("least"), F.max("ones").alias("most"))
        x, y = tiles.alias("x"), tiles.alias("y")
        near = (F.col("x.tile") <= F.col("y.tile")) & (F.col("y.least") <= F.col("x.most") + radius) & (F.col("x.least") <= F.col("y.most") + radius)
        pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & near).select("x.bucket", F.col("x.tile").alias("a"), F.col("y.tile").alias("b"))
        sides = pairs.select("bucket", F.col("a").alias("tile"), "a", "b", F.lit(0).alias("side")).unionByName(
            pairs.where("a <> b").select("bucket", F.col("b").alias("tile"), "a", "b", F.lit(1).alias("side"))
        )
        sides = sides.groupBy("bucket", "tile").agg(F.collect_list(F.struct("a", "b", "side")).alias("tasks"))
        alone = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("side")))
        dealt = placed.join(sides, ["bucket", "tile"], "left").select("bucket", "fp", F.explode(F.coalesce("tasks", alone)).alias("t"))
        cut = dealt.select("bucket", "fp", "t.a", "t.b", "t.side")
    ready = cut.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "side")
    return ready.select("bucket", "a", "b", "side", "fp").mapInArrow(_tile_batches, "u long, v long")


def components(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, fixed: int | None = None, rooted: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id of the documents reachable over links.  Documents without
    words share fingerprint zero and link like any other; rows that share a doc_id are separate
    documents with that id; a null doc_id counts as larger than any id and gives null only where a
    whole class has none.  An empty table gives an empty result.  `rooted` adds the column root: a
    fingerprint of the class, the same for all its rows, which tells classes apart that share an id.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs), "prints")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = scratch.save(links(distinct.select("fp"), scratch, radius, tile, fixed), "links")
    joined = scratch.save(connected_components(found).withColumnRenamed("node", "fp"), "joined")
    least = joined.join(distinct, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    least = scratch.save(least, "least")
    root = [F.col("component").alias("root")] if rooted else []
    linked = scratch.save(joined.join(least, "component").select("fp", "component_id", *root), "linked")
    root = [F.coalesce("root", "fp").alias("root")] if rooted else []
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), *root)
    named = scratch.save(named, "named")
    for done in ("placed", "large", "links", "joined", "least", "linked", "distinct"):
        scratch.drop(done)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", *(["root"] if rooted else []))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`docs` without near-duplicates: of each class the row with the smallest doc_id stays.

    A null doc_id counts as larger than any.  Where rows of the class share that doc_id, or none has one,
    the one with the least fingerprint stays, then the least text by hash.

    An id that one row has is enough to find the row; only rows whose doc_id is null or shared get their
    fingerprint once more, to tell their class.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.save(components(docs, radius, rooted=True), "classes")
    ids, prints, rows_of, fp, text, rank = fresh([*docs.columns, "doc_id", "text"], "chosen", "chosen_fp", "n_chosen", "fp", "read_text", "rank")
    of_class = F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("fp")))
    chosen = found.groupBy("root").agg(F.min("component_id").alias(ids), of_class.alias(prints)).drop("root")
    sharing = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(rows_of)).where(F.col(rows_of) > 1)
    several = scratch.save(sharing.select(F.col("doc_id").alias(rows_of)), "several")
    alone = chosen.where(F.col(ids).isNotNull()).join(several, F.col(ids) == F.col(rows_of), "left_anti").select(ids)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(alone, F.col("doc_id") == F.col(ids)).select(*columns)
    if several.isEmpty() and found.where("doc_id is null").isEmpty():
        return kept
    doubtful = docs.where("doc_id is null").unionByName(docs.join(several, F.col("doc_id") == F.col(rows_of), "left_semi"))
    doubtful = doubtful.withColumn(text, F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordbytes.slices(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints_of(batch.column(text)).view(np.int64))], [*batch.schema.names, fp])

    doubtful = doubtful.mapInArrow(run, doubtful.withColumn(fp, F.lit(0).cast("long")).schema).drop(text)
    picked = doubtful.join(chosen, F.col("doc_id").eqNullSafe(F.col(ids)) & (F.col(fp) == F.col(prints)))
    first = W.partitionBy("doc_id", fp).orderBy(F.xxhash64("text"), F.xxhash64(*columns))
    return kept.unionByName(picked.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*columns))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of `documents`, whole texts; see `components`."""
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
