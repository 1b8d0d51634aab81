"""Files in, files and documents out, parameters, streams."""

import csv
import glob
import importlib
import importlib.util
import json
import sys

import pytest
from pyspark.sql import functions as F

from clusterloom.api import answer, cluster, download
from clusterloom.operators import result
from clusterloom.params import ClusterParams
from clusterloom.plans.scratch import Scratch, shared_dir
from clusterloom.sources.points import numbered, read_csv, rejects, write_csv
from clusterloom.streaming.micro_batches import recluster

TEXT = """id,lng,lat,timestamp,name
1,116.1,39.9,2024-01-01 00:00:00,a
2, 116.1001 ,39.9,2024-02-30 10:00:00,"b,""q""\"
3,abc,39.8,2024-01-01 00:00:00,c
4,116.3
5,NaN,39.0,2024-01-01 00:00:00.5,e
6,1d,2f,2024-01-01 00:00:00,f,more

"""


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "points.csv"
    p.write_text(TEXT)
    return str(p)


def test_file_to_result(spark, path, tmp_path):
    params = ClusterParams(eps=1.0, min_pts=2, min_cluster_size=2)
    found = cluster(path, params)
    assert [(r.row_id, r.cluster_id) for r in found.labels.orderBy("row_id").collect()] == [(0, 0), (1, 0), (5, -1)]
    assert tuple(found.summary().first()) == (1, 3, 1)
    document = json.loads(result.to_json(found.response(params)).first()[0])
    assert document["downloadId"] == found.download_id and document["totalPoints"] == 3 and document["noisePoints"] == 1
    assert [p["extraData"]["name"] for p in document["clusters"][0]["points"]] == ["a", 'b,"q"']
    assert document["noisePointsList"][0]["coordinates"] == [1.0, 2.0]
    download(spark, found.download_id, str(tmp_path / "out"))
    (file,) = glob.glob(str(tmp_path / "out" / "*.csv"))
    rows = list(csv.reader(open(file)))
    assert rows[0] == ["id", "lng", "lat", "timestamp", "name", "clusterId"] and rows[2][4:] == ['b,"q"', "0"] and len(rows) == 4
    with pytest.raises(KeyError):
        download(spark, "unknown")


def test_rejects(spark, path):
    rows = read_csv(spark, path)
    assert [tuple(r) for r in rejects(rows, ClusterParams()).orderBy("row_id").collect()] == [(2, "no coordinates"), (3, "no coordinates"), (4, "no coordinates")]
    timed = rejects(rows, ClusterParams(algorithm="StDbscan")).orderBy("row_id").collect()
    assert [tuple(r) for r in timed][0] == (1, "no time")
    assert rejects(rows, ClusterParams(lng_field="LNG")).count() == 6


def test_missing_values_and_replaced_column(spark, tmp_path):
    rows = spark.createDataFrame([(0, None, "x", "old"), (1, "b", None, None)], "row_id long, p string, q string, clusterid string")
    labels = spark.createDataFrame([(0, 3), (1, -1)], "row_id long, cluster_id int")
    found = result.download_rows(rows, labels)
    assert found.columns == ["row_id", "p", "q", "clusterId"]
    assert [tuple(r)[1:] for r in found.orderBy("row_id").collect()] == [("", "x", "3"), ("b", "", "-1")]
    write_csv(found, str(tmp_path / "o"))
    assert len(glob.glob(str(tmp_path / "o" / "*.csv"))) == 1


@pytest.mark.parametrize(
    ("params", "said"),
    [
        (dict(), "eps must be positive"),
        (dict(eps=1.0), "minPts must be at least 1"),
        (dict(eps=1.0, min_pts=0), "minPts must be at least 1"),
        (dict(eps=1.0, min_pts=1, min_cluster_size=0), "minClusterSize must be at least 1"),
        (dict(eps=1.0, min_pts=1, algorithm="STDBSCAN"), "timeEps must be positive"),
        (dict(algorithm="hdbscan", min_pts=1, strict=True), "eps must be positive"),
    ],
)
def test_parameters(params, said):
    with pytest.raises(ValueError, match=said):
        ClusterParams(**params).check()


def test_parameters_in_order():
    assert ClusterParams(algorithm="HDBSCAN", min_cluster_size=7).check().points_needed == 7
    assert ClusterParams(algorithm="something", eps=1.0, min_pts=1).check().kind == "dbscan"


def test_empty_result(spark):
    empty = spark.createDataFrame([], "row_id long, lng double, lat double")
    found = cluster(empty, ClusterParams(eps=1.0, min_pts=2))
    assert tuple(found.summary().first()) == (0, 0, 0)
    document = json.loads(result.to_json(found.response(ClusterParams())).first()[0])
    assert document["clusters"] == [] and document["noisePointsList"] == []


def test_rows_of_several_files_in_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_text("n,text\n" + "".join(f'{10 * k + i},"a\nb"\n' for i in range(k, 4)))
    rows = read_csv(spark, str(tmp_path / "*.csv")).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(9)) and [int(r.n) for r in rows] == [0, 1, 2, 3, 11, 12, 13, 22, 23]
    spread = numbered(spark.range(100).repartition(5))
    assert sorted(r.row_id for r in spread.collect()) == list(range(100)) and spread.columns == ["row_id", "id"]


def test_stream(spark, tmp_path):
    rows = [(i, 1000.0 + i * 0.1, 1000.0, i * 1000) for i in range(6)]
    for k in range(2):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], "row_id long, x double, y double, t long").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, x double, y double, t long").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    seen = []
    params = ClusterParams(eps=0.15, min_pts=2, min_cluster_size=2)
    query = recluster(stream, params, 10_000, lambda labels, n: seen.append(labels.agg(F.count("*"), F.max("cluster_id")).first()), Scratch(spark, "stream"))
    started = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    started.awaitTermination(120)
    assert tuple(seen[-1]) == (6, 0)


def test_columns_of_any_name(spark, tmp_path):
    """Columns that carry names which the engine uses itself."""
    names = "row_id,cluster_id,x,y,t,reason,group,place,offset,__x,__group,lng,lat"
    (tmp_path / "in.csv").write_text(names + "\n" + "".join(f"a{k},b,c,d,e,f,g,h,i,j,k,{500 + k / 10},1\n" for k in range(4)))
    found = cluster(str(tmp_path / "in.csv"), ClusterParams(eps=1.0, min_pts=2))
    rows = download(spark, found.download_id).orderBy("row_id")
    assert rows.columns == ["row_id", "_" + names.split(",")[0], *names.split(",")[1:], "clusterId"]
    assert [(r._row_id, r.cluster_id, r.clusterId) for r in rows.collect()] == [(f"a{k}", "b", "0") for k in range(4)]
    frame = spark.createDataFrame([(k, 500.0 + k / 10, 1.0, "b", 7) for k in range(4)], "row_id long, lng double, lat double, cluster_id string, __x int")
    assert cluster(frame, ClusterParams(eps=1.0, min_pts=2)).summary().first().total_points == 4
    assert cluster(frame.drop("row_id"), ClusterParams(eps=1.0, min_pts=2)).summary().first().total_points == 4


def test_split_files_keep_their_order(spark, tmp_path):
    (tmp_path / "in.csv").write_text("n,text\n" + "".join(f"{k},{'x' * 50}\n" for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_csv(spark, str(tmp_path / "in.csv"), multi_line=False)
        assert len([f for f in rows.inputFiles() if "/placed-" in f]) > 3  # one per task that read a part of the file
        assert all(r.row_id == int(r.n) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    mixed = numbered(spark.range(500).repartition(5).withColumnRenamed("id", "n"), ["n"])
    assert sorted((r.row_id, r.n) for r in mixed.collect()) == [(k, k) for k in range(500)]


def test_answers(spark, path, tmp_path):
    (tmp_path / "none.csv").write_text("")
    good = ClusterParams(eps=1.0, min_pts=2)
    assert answer(lambda: cluster(path, good).summary().first().total_points)[0] == 200
    assert answer(lambda: cluster(str(tmp_path / "none.csv"), good)) == (400, {"error": "File is empty"})
    assert answer(lambda: cluster(path, ClusterParams())) == (400, {"error": "eps must be positive"})
    assert answer(lambda: download(spark, "unknown"))[0] == 404
    assert answer(lambda: cluster(str(tmp_path / "missing.csv"), good)) == (500, {"error": "Internal server error"})


def test_shared_folder_is_needed_off_local_masters(spark, monkeypatch):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere)


def test_entry_without_a_library(monkeypatch):
    """The engine's queries are there where the others can't be imported."""
    entry = importlib.util.spec_from_file_location("entry_alone", importlib.import_module("__spark_entry__").__file__)
    for name in [n for n in sys.modules if n.startswith("clusterloom.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    module = importlib.util.module_from_spec(entry)
    entry.loader.exec_module(module)
    assert "dbscan_labels" in module.queries() and not any(n.startswith("op") for n in module.queries())


@pytest.mark.parametrize("parts", [4, 64])
def test_numbers_behind_a_shuffle(spark, parts):
    """The input of a shuffle that AQE coalesces: no row is lost, and ids are dense."""
    rows = spark.range(400_000).withColumn("x", F.col("id") % 977 + 1000.0).withColumn("y", F.col("id") % 13 + 1000.0)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        grouped = rows.groupBy("id", "x", "y").agg(F.count("*").alias("n"), F.first(F.lit("padding " * 4)).alias("text"))
        joined = rows.join(rows.select("id", F.lit(1).alias("one")).hint("merge"), "id")
        for given in (grouped, joined, rows.repartition(parts, "id"), rows.repartition(parts)):
            found = numbered(given)
            stats = found.agg(F.count("*"), F.countDistinct("row_id"), F.min("row_id"), F.max("row_id"), F.countDistinct("id")).first()
            assert tuple(stats) == (400_000, 400_000, 0, 399_999, 400_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("parts", [4, 64])
def test_cluster_keeps_rows_behind_a_shuffle(spark, parts):
    rows = spark.range(20_000).select("id", (F.col("id") % 40 * 50 + 1000.0).alias("lng"), (F.floor(F.col("id") / 40) * 0.5 + 1000.0).alias("lat"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        params = ClusterParams(eps=0.6, min_pts=2, min_cluster_size=2, geo=False)
        for given in (rows.groupBy("id", "lng", "lat").count(), rows.join(rows.select("id").hint("merge"), "id"), rows.repartition(parts)):
            found = cluster(given, params)
            assert found.rows.count() == found.labels.count() == 20_000
            assert tuple(found.summary().first()) == (40, 20_000, 0)
            per = found.rows.join(found.labels, "row_id").groupBy("lng").agg(F.countDistinct("cluster_id").alias("n"))
            assert per.where("n <> 1").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_running_total(spark):
    from clusterloom.sources.points import running_total

    rows = spark.range(500).select((F.col("id") * 3).alias("at"), (F.col("id") % 5).alias("n"))
    found = running_total(rows, "at", F.shiftright("at", 6), "n").orderBy("at").collect()
    total = 0
    for row in found:
        assert row.before == total
        total += row.n
    assert len(found) == 500


def test_large_document(spark):
    """One cluster of 200,000 points: the document is sorted, not searched point by point."""
    import time

    rows = spark.range(200_000).select(F.col("id").alias("row_id"), (F.col("id") % 1000 * 1.0).alias("x"), F.lit(1.0).alias("y"), F.col("id").cast("string").alias("name"))
    began = time.time()
    found = result.response(rows.repartition(7), rows.select("row_id", F.lit(0).alias("cluster_id"))).select("totalPoints", F.transform("clusters", lambda c: F.transform(c["points"], lambda p: p["extraData"]["name"])).alias("names")).first()
    assert time.time() - began < 60
    assert found.totalPoints == 200_000 and found.names[0] == [str(k) for k in range(200_000)]


def _folders(spark):
    import os

    root = shared_dir(spark).removeprefix("file://")
    return {os.path.join(d, x) for d, names, _ in os.walk(root) for x in names}


@pytest.mark.parametrize("algorithm", ["dbscan", "hdbscan"])
def test_no_folder_left(spark, algorithm):
    """What a clustering wrote goes, but for the tables of its result; with `drop` those go too, and the download stays."""
    rows = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 3 * 100 + 500.0).alias("lng"), (F.col("id") * 0.01).alias("lat"))
    before = _folders(spark)
    found = cluster(rows, ClusterParams(algorithm=algorithm, eps=1.0, min_pts=2, min_cluster_size=2, geo=False))
    new = {x.rsplit("/", 1)[1].split("-")[0] for x in _folders(spark) - before}
    assert new <= {"cluster", "rows", "labels", "results", found.download_id.split("-")[0]}
    assert found.labels.count() == 60
    found.drop()
    new = {x.rsplit("/", 1)[1] for x in _folders(spark) - before}
    assert new - {"results"} == {found.download_id}
    assert download(spark, found.download_id).count() == 60


def test_results_outlive_their_driver(spark, tmp_path):
    """Another driver finds a result by its id; results expire, are evicted, and half-written ones are none."""
    import os
    import subprocess
    import time

    rows = spark.range(30).select(F.col("id").alias("row_id"), (F.col("id") * 0.1 + 500.0).alias("lng"), F.lit(1.0).alias("lat"))
    key = cluster(rows, ClusterParams(eps=1.0, min_pts=2, geo=False)).download_id
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {spark.conf.get("spark.checkpoint.dir")!r}).getOrCreate()
from clusterloom.api import download
print("ROWS", download(spark, {key!r}).where("clusterId = '0'").count())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200, env=os.environ | {"PYTHONPATH": root})
    assert "ROWS 30" in said.stdout, said.stderr[-500:]
    cache = result.ResultCache(spark)
    time.sleep(1.1)
    assert cache.get(key).count() == 30 and result.ResultCache(spark, max_age=1.0).get(key) is None
    with pytest.raises(KeyError):
        download(spark, key, max_age=1.0)
    half = cache.put(rows)
    os.remove(f"{cache.root.removeprefix('file://')}/{half}/_SUCCESS")
    assert cache.get(half) is None and cache.get("../rows") is None
    assert cache.evict(3600.0) == [] and key in cache.evict(0.5) and cache.get(key) is None
    other = cache.put(rows)
    cache.drop(other)
    assert cache.get(other) is None
