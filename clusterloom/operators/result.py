"""From labels to results: counts, members, nested documents, rows for download."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.operators.dbscan import NOISE
from clusterloom.plans.names import fresh
from clusterloom.plans.scratch import Scratch, shared_dir
from clusterloom.sources.points import numbered

#: row_ids in a list of `member_chunks`
CHUNK = 10_000
POINT = "struct<coordinates:array<double>,extraData:map<string,string>,x:double,y:double>"


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("cluster_id") != NOISE).groupBy("cluster_id").agg(F.count("*").alias("n_points"))


def summary(labels: DataFrame) -> DataFrame:
    """One row: total_clusters, total_points, noise_points; zeros for an empty table."""
    real = F.when(F.col("cluster_id") != NOISE, F.col("cluster_id"))
    return labels.agg(F.countDistinct(real).alias("total_clusters"), F.count("*").alias("total_points"), F.count_if(F.col("cluster_id") == NOISE).alias("noise_points"))


def size_filter(labels: DataFrame, min_cluster_size: int) -> DataFrame:
    """`labels` with the clusters below the least size turned to noise; ids keep their gaps (see `renumber`)."""
    kept = cluster_sizes(labels).where(F.col("n_points") >= min_cluster_size).select("cluster_id", F.lit(True).alias("stays"))
    return labels.join(kept, "cluster_id", "left").select("row_id", F.when(F.col("stays"), F.col("cluster_id")).otherwise(NOISE).alias("cluster_id"))


def cluster_members(labels: DataFrame) -> DataFrame:
    """(cluster_id, members): the row_ids of each cluster in order, noise left out.

    A list is one value, so a cluster has to fit in a task here; `member_chunks` has no such limit.
    """
    return labels.where(F.col("cluster_id") != NOISE).groupBy("cluster_id").agg(F.sort_array(F.collect_list("row_id")).alias("members"))


def member_chunks(labels: DataFrame, size: int = CHUNK, noise: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(cluster_id, chunk, members): the row_ids of each cluster in order, `size` in a list, lists from 0; with `noise` those of noise too.

    Rows are sorted by ranges of (cluster_id, row_id) and numbered there, so a crowded cluster is spread over
    tasks and no list is longer than `size`.  A place in a cluster is a row's number less its cluster's first.
    """
    given = labels if noise else labels.where(F.col("cluster_id") != NOISE)
    (own,) = fresh(["row_id", "cluster_id"], "member")
    found = numbered(given.select("cluster_id", F.col("row_id").alias(own)), ["cluster_id", own], scratch)
    first = found.groupBy("cluster_id").agg(F.min("row_id").alias("first"))
    placed = found.join(first, "cluster_id").withColumn("chunk", F.floor((F.col("row_id") - F.col("first")) / size))
    return placed.groupBy("cluster_id", "chunk").agg(F.sort_array(F.collect_list(own)).alias("members"))


def noise_points(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("cluster_id") == NOISE).select("row_id")


def attach(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` with the column clusterId as text, put last; a column of that name (in any case) is replaced."""
    rest = [c for c in rows.columns if c.lower() != "clusterid"]
    (own,) = fresh(rows.columns, "cluster_id")
    joined = rows.join(labels.select("row_id", F.col("cluster_id").alias(own)), "row_id", "left")
    return joined.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(own, F.lit(NOISE)).cast("string").alias("clusterId"))


def download_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns as text, missing values empty, clusterId last, and row_id to order by."""
    found = attach(rows, labels)
    return found.select("row_id", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in found.columns if c != "row_id"))


def extra_data(rows: DataFrame) -> Column:
    """All columns but row_id as a map of texts, missing values empty."""
    pairs = [x for c in rows.columns if c != "row_id" for x in (F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def response(rows: DataFrame, labels: DataFrame, x: str = "x", y: str = "y", download_id: str | None = None) -> DataFrame:
    """One row: the result as a nested document, members in order of row_id.

    A document holds all points by its nature; large results are better taken from `download_rows` or
    `cluster_members`.
    """
    known = attach(rows, labels)
    coords = F.array(F.col(f"`{x}`").try_cast("double"), F.col(f"`{y}`").try_cast("double"))
    point = F.struct(coords.alias("coordinates"), extra_data(known).alias("extraData"), coords[0].alias("x"), coords[1].alias("y"))
    each = known.select("row_id", F.col("clusterId").cast("int").alias("cluster_id"), point.alias("p"))

    # Maps cannot be ordered, so points are compared by row_id alone.
    by_id = lambda a, b: F.when(a["row_id"] < b["row_id"], -1).when(a["row_id"] > b["row_id"], 1).otherwise(0)
    grouped = each.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "p")), by_id).alias("members"), F.count("*").alias("n"))
    grouped = grouped.select("cluster_id", "n", F.transform("members", lambda m: m["p"]).alias("points"))
    real = F.col("cluster_id") != NOISE
    total = grouped.agg(
        F.lit(download_id or str(uuid.uuid4())).alias("downloadId"),
        F.count_if(real).cast("int").alias("totalClusters"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("totalPoints"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).cast("int").alias("noisePoints"),
        F.collect_list(F.when(real, F.struct(F.col("cluster_id").alias("clusterId"), "points"))).alias("clusters"),
        F.coalesce(F.max_by(F.when(~real, F.col("points")), F.when(~real, 1)), F.array().cast(f"array<{POINT}>")).alias("noisePointsList"),
    )
    ordered = F.array_sort(F.col("clusters"), lambda a, b: a["clusterId"] - b["clusterId"])
    return total.withColumn("clusters", ordered)


def to_json(document: DataFrame) -> DataFrame:
    return document.select(F.to_json(F.struct("*")).alias("json"))


class ResultCache:
    """Results by a random id, for a later download: tables in a folder of the shared folder, which is the list of what
    there is.  So another driver with the same spark.checkpoint.dir finds them, and a driver keeps none in memory.

    A result that is not whole (its writer was lost) is none.  `max_age` in seconds makes older ones unknown;
    `evict` deletes them.
    """

    def __init__(self, spark: SparkSession, max_age: float | None = None):
        self.spark, self.max_age, self.root = spark, max_age, f"{shared_dir(spark)}/results"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, rows: DataFrame) -> str:
        key = str(uuid.uuid4())
        rows.write.parquet(f"{self.root}/{key}")
        return key

    def _age(self, key: str) -> float | None:
        try:
            uuid.UUID(key)
        except ValueError:
            return None
        done = self._path(f"{self.root}/{key}/_SUCCESS")
        return time.time() - self._files.getFileStatus(done).getModificationTime() / 1000 if self._files.exists(done) else None

    def get(self, key: str) -> DataFrame | None:
        age = self._age(key)
        return None if age is None or self.max_age is not None and age > self.max_age else self.spark.read.parquet(f"{self.root}/{key}")

    def drop(self, key: str) -> None:
        if self._age(key) is not None:
            self._files.delete(self._path(f"{self.root}/{key}"), True)

    def evict(self, max_age: float) -> list[str]:
        """Delete the results that are older, and say which."""
        if not self._files.exists(self._path(self.root)):
            return []
        keys = [f.getPath().getName() for f in self._files.listStatus(self._path(self.root))]
        old = [k for k in keys if (age := self._age(k)) is not None and age > max_age]
        for key in old:
            self.drop(key)
        return old
