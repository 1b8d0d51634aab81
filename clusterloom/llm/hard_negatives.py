"""Hard negatives of anchors, by a product of matrices that are cut in two dimensions.

1. Rows and anchors get dense numbers, and blocks of them are cut into chunks of dimensions.
2. Each task multiplies one block of anchors with one block of rows in one chunk: a partial tile of
   int64 scores.  Partial tiles of one place are shuffled together and added.
3. A tile gives its best rows of the anchor's own label; reduced over tiles they are its positives.  Each
   pair of anchor and positive opens a window of scores, and a tile gives its best rows of
   other labels inside; reduced over tiles they are the negatives.

Tiles are of fixed size whatever the number of rows, no key has more than one tile, and a label or vector
that very many rows share is no key at all.  The anchors are a query set: all of them meet all rows, in
blocks, and no other pair is ever made.  As scores grow with anchors times rows, anchors go in waves of a
bounded number of scores; what a wave wrote and shuffled is deleted before the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterloom.llm.tables import table
from clusterloom.plans.scratch import Scratch, settings, shuffles_freed
from clusterloom.sources.points import numbered

#: anchors and rows of a tile, anchors of the slabs in which tiles are shuffled, dimensions of a chunk
ANCHORS, ROWS, SLAB, DIMENSIONS = 1024, 2048, 128, 32
#: scores of a wave, about; a slab of anchors meets all rows in any case
SCORES = 1 << 27
#: blocks that a task is handed at once
BLOCKS = 16

_NEAR = "array<struct<anchor:long,anchor_id:long,anchor_label:long,at:int,id:long,row:long,score:long>>"


def _blocks(rows: DataFrame, number: str, size: int, chunks: int) -> DataFrame:
    """(block, chunk, n, rows, ids, labels, data): `size` consecutive rows a block, all columns but the first three packed int64."""

    def pack(key: tuple, found: pa.Table) -> pa.Table:
        found = found.take(pc.sort_indices(found, [(number, "ascending")]))
        vectors = found.column("vector").combine_chunks()
        lengths = np.diff(vectors.offsets.to_numpy())
        values = vectors.flatten().to_numpy()
        data = np.zeros((len(lengths), chunks * DIMENSIONS), np.int64)
        at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        data[np.repeat(np.arange(len(lengths)), lengths), at] = values
        meta = [found.column(c).to_numpy().astype(np.int64).tobytes() for c in ("row", "id", "label")]
        out = [(key[0].as_py(), k, len(lengths), *meta, np.ascontiguousarray(data[:, k * DIMENSIONS : (k + 1) * DIMENSIONS]).tobytes()) for k in range(chunks)]
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    schema = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("n", pa.int32())] + [(c, pa.binary()) for c in ("rows", "ids", "labels", "data")])
    blocked = rows.withColumn("block", F.floor(F.col(number) / size))
    return blocked.groupBy("block").applyInArrow(pack, "block long, chunk int, n int, rows binary, ids binary, labels binary, data binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in int64; through doubles where these hold every sum exactly."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < float(1 << 53):
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def squeezed(scores: np.ndarray) -> bytes:
    """int64 numbers without the bytes that small ones do not need: their bytes by place, compressed."""
    folded = (scores << 1) ^ (scores >> 63)
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(folded.reshape(-1, 1).view(np.uint8).T).tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    folded = np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)
    return (folded >> np.uint64(1)).view(np.int64) ^ -(folded & np.uint64(1)).view(np.int64)


_META = ("rows", "ids", "labels")
_PARTIAL = pa.schema([(c, pa.int64()) for c in ("i", "j", "s")] + [("chunk", pa.int32())] + [(c, pa.binary()) for c in ("data", "a_rows", "a_ids", "a_labels", "b_rows", "b_ids", "b_labels")])


def _multiplied(slab: int):
    """Blocks of one chunk, two a row (a_.., b_..), to the slabs of their partial tile; those of the first chunk also carry what the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                tile = product(*(np.frombuffer(r[f"{x}_data"], np.int64).reshape(r[f"{x}_n"], -1) for x in "ab"))
                out = []
                for s in range(0, len(tile), slab):
                    row = {"i": r["i"], "j": r["j"], "s": s // slab, "chunk": r["chunk"], "data": squeezed(tile[s : s + slab].reshape(-1))}
                    if not r["chunk"]:
                        row |= {f"a_{c}": r[f"a_{c}"][s * 8 : (s + slab) * 8] for c in _META} | {f"b_{c}": r[f"b_{c}"] for c in _META}
                    out.append(row)
                yield from pa.Table.from_pylist(out, _PARTIAL).to_batches()

    return run


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best by (score descending, id, row)."""
    if len(scores) > 4 * most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((rows[some], ids[some], ~scores[some]))[:most]]


def _added(positives: int):
    """Partial slabs of one place to their sum, with the best rows of each anchor's label."""
    schema = pa.schema([(c, pa.int64()) for c in ("i", "j", "s")] + [(c, pa.binary()) for c in ("data", "a_rows", "a_labels", "b_rows", "b_ids", "b_labels")])
    near_type = pa.list_(pa.struct([(n, pa.int32() if n == "at" else pa.int64()) for n in ("anchor", "anchor_id", "anchor_label", "at", "id", "row", "score")]))
    schema = schema.append(pa.field("near", near_type))

    def run(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(unsqueezed(x.as_py()) for x in parts.column("data"))
        first = next(r for r in parts.drop_columns(["data"]).to_pylist() if not r["chunk"])
        rows, ids, labels = ({s: np.frombuffer(first[f"{s}_{c}"], np.int64) for s in "ab"} for c in ("rows", "ids", "labels"))
        tile = total.reshape(len(rows["a"]), len(rows["b"]))
        near = []
        for at in range(len(tile)):
            same = np.flatnonzero((labels["b"] == labels["a"][at]) & (rows["b"] != rows["a"][at]))
            for x in same[_best(tile[at, same], ids["b"][same], rows["b"][same], positives)].tolist():
                near.append({"anchor": int(rows["a"][at]), "anchor_id": int(ids["a"][at]), "anchor_label": int(labels["a"][at]), "at": at, "id": int(ids["b"][x]), "row": int(rows["b"][x]), "score": int(tile[at, x])})
        row = {c: first[c] for c in schema.names if c not in ("data", "near")} | {"data": squeezed(total), "near": near}
        return pa.Table.from_pylist([row], schema)

    return run


_FOUND = pa.schema([(c, pa.int64()) for c in ("anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative", "negative_id", "negative_score")])


def _windowed(negatives: int, low: int, high: int):
    """The best rows of other labels in the window of each pair of anchor and positive of each slab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield one(batch.slice(k, 1).to_pylist()[0])

    def one(slab: dict) -> pa.RecordBatch:
        rows, ids, labels = (np.frombuffer(slab[f"b_{c}"], np.int64) for c in ("rows", "ids", "labels"))
        tile = unsqueezed(slab["data"]).reshape(-1, len(rows))
        out, ordered, wide = [], {}, {}
        windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in slab["pairs"]]
        for p, (least, most) in zip(slab["pairs"], windows, strict=True):
            if least <= most:
                was = wide.get(p["at"], (least, most))
                wide[p["at"]] = min(least, was[0]), max(most, was[1])
        for p, (least, most) in zip(slab["pairs"], windows, strict=True):
            at = p["at"]
            if least > most:
                continue
            if at not in ordered:  # only rows in some window of this anchor are put in order
                other = np.flatnonzero((labels != p["anchor_label"]) & (tile[at] >= wide[at][0]) & (tile[at] <= wide[at][1]))
                other = other[np.lexsort((rows[other], ids[other], ~tile[at, other]))]
                ordered[at] = other, ~tile[at, other]
            other, falling = ordered[at]
            start, stop = np.searchsorted(falling, ~most), np.searchsorted(falling, ~least, side="right")
            for x in other[start : min(stop, start + negatives)].tolist():
                out.append((p["anchor"], p["anchor_id"], p["row"], p["id"], p["score"], int(rows[x]), int(ids[x]), int(tile[at, x])))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(_FOUND), schema=_FOUND)

    return run


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scratch: Scratch | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `vectors` (id, label, vector, anchor).

    `vector` is an array of longs, `anchor` says whether the row is one.  A score is the inner product,
    a shorter vector going on with zeros.  An anchor's positives are its first `positives` other rows of
    its label, by score from above and then by id.  For each of them come the first `negatives` rows of
    other labels whose score lies between `low` and `high` percent of the positive's, both included.

    A null id, label, vector or component: the row takes no part.  Rows that share an id are rows of
    their own, so two anchors of one id each give their rows, and a copy of an anchor may be its positive.
    Scores are int64 and wrap beyond it.  Empty tables, or none that is an anchor, give an empty result.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "hard-negatives")
    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    given = vectors.where(whole).select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<long>"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    rows = scratch.save(numbered(given, scratch=scratch).withColumnRenamed("row_id", "row"), "rows")
    own = numbered(rows.where("anchor"), scratch=Scratch(vectors.sparkSession, "anchors")).withColumnRenamed("row_id", "number")
    size = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("m"), F.max(F.size("vector")).alias("d")).first()
    chunks = max(1, -(-(size["d"] or 0) // DIMENSIONS))
    spark = vectors.sparkSession
    wave = max(SLAB, SCORES // max(1, size["n"]) // SLAB * SLAB)
    block = min(ANCHORS, wave)
    left = scratch.save(_blocks(own, "number", block, chunks), "left")
    met = -(-size["n"] // ROWS) * chunks
    tasks = max(1, min(met, max(-(-met // BLOCKS), 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))))
    right = scratch.save(_blocks(rows, "row", ROWS, chunks).repartition(tasks, "block", "chunk"), "right")
    packed = ("n", *_META, "data")
    b = right.select("chunk", F.col("block").alias("j"), *(F.col(c).alias(f"b_{c}") for c in packed))
    types = "i long, j long, s long"
    out = scratch.path("found")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for first in range(0, -(-size["m"] // block), max(1, wave // block)):
        a = left.where(F.col("block").between(first, first + max(1, wave // block) - 1)).select("chunk", F.col("block").alias("i"), *(F.col(c).alias(f"a_{c}") for c in packed))
        # A wave's anchors are a bounded table, so rows need no shuffle to meet them.
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BLOCKS)):
            partial = b.join(F.broadcast(a), "chunk").mapInArrow(_multiplied(SLAB), f"{types}, chunk int, data binary, a_rows binary, a_ids binary, a_labels binary, b_rows binary, b_ids binary, b_labels binary")
            slabs = partial.groupBy("i", "j", "s").applyInArrow(_added(positives), f"{types}, data binary, a_rows binary, a_labels binary, b_rows binary, b_ids binary, b_labels binary, near {_NEAR}")
            slabs = scratch.save(slabs, "slabs")
        near = slabs.select("i", "s", F.explode("near").alias("p")).select("i", "s", "p.*")
        order = W.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "row")
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).drop("rank")
        pairs = near.groupBy("i", "s").agg(F.collect_list(F.struct(*(c for c in near.columns if c not in ("i", "s")))).alias("pairs"))  # SLAB * positives at most
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BLOCKS)), shuffles_freed(spark):
            found = slabs.drop("near", "a_rows", "a_labels").join(F.broadcast(pairs), ["i", "s"])
            found = found.mapInArrow(_windowed(negatives, low, high), ", ".join(f"{c} long" for c in _FOUND.names))
            order = W.partitionBy("anchor", "positive").orderBy(F.col("negative_score").desc(), "negative_id", "negative")
            ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(out)
    for name in ("slabs", "left", "right"):
        scratch.drop(name)
    return spark.read.schema(schema).parquet(out)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector of `embeddings`, components scaled by 256 and rounded down; see `hard_negatives`.

    A vector with a null, NaN or infinite component takes no part.
    """
    rows = table(spark, sf_dir, "embeddings").where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor")))


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5),
negative AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 3
"""
