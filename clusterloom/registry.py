"""The registered queries of the clustering engine, each with its SQL where SQL can express it.

The tables hold no coordinates, so points are derived: customers by nation and balance, suppliers the
same, events by user and value as longitude and latitude with their time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.api import answer, cluster, download
from clusterloom.functions import metrics
from clusterloom.functions import points as fn
from clusterloom.operators import hierarchy, joins, mst, project, result
from clusterloom.operators.all_pairs import group_distances
from clusterloom.operators.components import connected_components
from clusterloom.operators.dbscan import dbscan, renumber, st_dbscan
from clusterloom.operators.hdbscan import hdbscan
from clusterloom.params import ClusterParams
from clusterloom.plans.scratch import Scratch
from clusterloom.sources.points import numbered, points, read_csv, rejects, write_csv

#: radius, least neighbours and least size for customers, and for events in kilometres
PLAIN = (1.5, 4, 5)
GEO = (1.1, 12, 12)
TIMED = (3.0, 4, 4)
DAY = 86_400_000

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 100.0).alias("y"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 1000.0).alias("y"))


def events(spark: SparkSession, d: str) -> DataFrame:
    lng, lat = F.lit(116.0) + F.col("user_id") / 100.0, F.lit(39.0) + F.col("value") / 500.0
    return _read(spark, d, "events").select(F.col("event_id").alias("row_id"), lng.alias("x"), lat.alias("y"), fn.millis(F.col("ts")).alias("t"))


CUSTOMERS = "SELECT c_custkey AS row_id, c_nationkey::DOUBLE AS x, c_acctbal / 100.0::DOUBLE AS y FROM customer"
SUPPLIERS = "SELECT s_suppkey AS row_id, s_nationkey::DOUBLE AS x, s_acctbal / 1000.0::DOUBLE AS y FROM supplier"
EVENTS = "SELECT event_id AS row_id, 116.0::DOUBLE + user_id / 100.0::DOUBLE AS x, 39.0::DOUBLE + value / 500.0::DOUBLE AS y, epoch_us(ts) // 1000 AS t FROM events"
EVENTS_KM = f"SELECT row_id, x * (111.32::DOUBLE * cos(radians((SELECT avg(y) FROM ({EVENTS}))))) AS x, y * 111.32::DOUBLE AS y, t FROM ({EVENTS})"
SQUARED = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
APART = "(abs(a.x - b.x) + abs(a.y - b.y))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of suppliers of one nation, u < v."""
    s = suppliers(spark, d)
    u, v = (s.select(F.col("x").alias("nation"), *(F.col(c).alias(f"{k}_{c}") for c in s.columns)) for k in "uv")
    return u.join(v, "nation").where("u_row_id < v_row_id")


def _distance(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        a, b = ([F.col(f"{k}_x"), F.col(f"{k}_y")] for k in "uv")
        value = {"euclid": metrics.Euclidean().distance, "sq": metrics.squared_euclidean, "haversine": metrics.Haversine().distance}[kind](a, b)
        return _pairs(spark, d).select(F.col("u_row_id").alias("u"), F.col("v_row_id").alias("v"), F.round(value, 6).alias("distance"))

    return run


def _dist_nd(spark: SparkSession, d: str) -> DataFrame:
    return group_distances(_read(spark, d, "embeddings"), "label", "vec_id", "embedding", digits=6)


def _row_number_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """Orders from their lines, numbered behind the shuffle that made them: whether the numbers are dense, and whether a row is lost."""
    orders = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    found = numbered(orders)
    return found.agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"), F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.sum("lines").alias("lines"))


def _geo_detect(spark: SparkSession, d: str) -> DataFrame:
    part = _read(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    rows = [(name, project.looks_geo(t, ["x", "y"])) for name, t in (("events", events(spark, d)), ("part", part))]
    return spark.createDataFrame(rows, "name string, geo boolean")


def _text_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as texts with some that are no points, as a file would give them."""
    e = _read(spark, d, "events")
    lng = F.when(F.col("event_id") % 7 == 0, F.lit("abc")).otherwise(F.col("user_id").cast("string"))
    time = F.when(F.col("event_id") % 5 == 0, F.lit("2024-13-01")).otherwise(F.date_format("ts", fn.TIME_PATTERN))
    return e.select(F.col("event_id").alias("row_id"), lng.alias("lng"), F.col("value").cast("string").alias("lat"), time.alias("timestamp"))


_CSV = ClusterParams(algorithm="STDBSCAN", eps=1, min_pts=1, time_eps=1)


def _mst(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    return mst.mst(mst.with_core(suppliers(spark, d), 2, ["x", "y"], scratch), ["x", "y"], scratch=scratch)


def _mst_large(spark: SparkSession, d: str) -> DataFrame:
    """The tree by growing radii and boundaries, whatever the number of points."""
    scratch = Scratch(spark, "mst-large")
    cored = mst.with_core(customers(spark, d), 4, ["x", "y"], scratch)
    return mst.mst(cored, ["x", "y"], scratch=scratch, dense_points=0).select("u", "v", F.round("w", 6).alias("w"))


def _reject_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows are no points, and why, where a role column is missing or rows end before it."""
    texts = _text_rows(spark, d)
    cut = texts.withColumn("lat", F.when(F.col("row_id") % 3 > 0, F.col("lat")))
    plain = ClusterParams(eps=1, min_pts=1)
    cases = {"no lng": (texts.drop("lng"), plain), "no time": (texts.drop("timestamp"), _CSV), "other name": (texts.withColumnRenamed("lat", "LAT"), plain), "short": (cut, plain)}
    found = [rejects(rows, params).groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(name).alias("case"), "reason", "n") for name, (rows, params) in cases.items()]
    return reduce(DataFrame.unionByName, found)


def _service_answers(spark: SparkSession, d: str) -> DataFrame:
    """What a service would answer: status, and the message or the number of points."""
    rows = customers(spark, d).withColumnsRenamed({"x": "lng", "y": "lat"})
    fine = {"eps": PLAIN[0], "min_pts": PLAIN[1], "min_cluster_size": PLAIN[2], "geo": False}
    cases = {"fine": {}, "eps": {"eps": 0.0}, "minPts": {"min_pts": 0}, "size": {"min_cluster_size": 0}, "timeEps": {"algorithm": "StDbscan"}}
    calls = {name: lambda c=case: cluster(rows, ClusterParams(**fine | c)).labels.count() for name, case in cases.items()}
    calls["unknown"] = lambda: download(spark, "00000000-0000-0000-0000-000000000000")
    found = [(name, status, said["error"] if isinstance(said, dict) else str(said)) for name, call in calls.items() for status, said in [answer(call)]]
    return spark.createDataFrame(found, "case string, status int, message string")


def _csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as CSV, clustered from the files in one call, downloaded as CSV and read again."""
    scratch = Scratch(spark, "csv")
    rows = customers(spark, d).join(_read(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_name"), "row_id")
    write_csv(rows.withColumn("lng", F.col("x")).withColumn("lat", F.col("y")).withColumn("key", F.col("row_id")).drop("x", "y"), scratch.path("in"), one_file=False)
    params = ClusterParams(eps=PLAIN[0], min_pts=PLAIN[1], min_cluster_size=PLAIN[2], geo=False)
    found = cluster(scratch.path("in"), params, spark, multi_line=False)
    download(spark, found.download_id, scratch.path("out"))
    return read_csv(spark, scratch.path("out")).select(F.col("key").cast("long").alias("key"), "c_name", "clusterId")


def _dendrogram(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "dendrogram")
    found = hierarchy.dendrogram(scratch.save(_mst(spark, d, scratch), "tree"), 3)
    return found.select("node", "left", "right", "size", *(F.round(c, 6).alias(c) for c in ("density", "parent_density", "own", "best")), "stable")


def _plain_labels(spark: SparkSession, d: str) -> DataFrame:
    return dbscan(customers(spark, d), *PLAIN, geo=False)


#: dimensions, radius, least neighbours and least size for embeddings
MANY = (8, 0.22, 3, 4)


def _dbscan_nd(spark: SparkSession, d: str) -> DataFrame:
    axes = [f"e{k}" for k in range(MANY[0])]
    rows = _read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(axes)))
    return dbscan(rows, *MANY[1:], columns=axes, geo=False)


def _blocks_apart(a: list, b: list):
    """A metric of a user's own: along the axes."""
    return abs(a[0] - b[0]) + abs(a[1] - b[1])


_OWN = metrics.PythonMetric(_blocks_apart, triangle=True)


def _knn(spark: SparkSession, d: str) -> DataFrame:
    return joins.knn_join(suppliers(spark, d), 5)


def queries() -> dict[str, Query]:
    rounded = "round(distance, 6) AS distance"
    return {
        "row_number_points": lambda s, d: numbered(_read(s, d, "customer").select("c_custkey"), ["c_custkey"]),
        "row_number_shuffled": _row_number_shuffled,
        "coords_array_xy": lambda s, d: events(s, d)
        .withColumn("c", fn.coordinates(F.col("x"), F.col("y")))
        .select("row_id", fn.coordinate(F.col("c"), 0).alias("x"), fn.coordinate(F.col("c"), 1).alias("y"), fn.coordinate(F.col("c"), 2).alias("z")),
        "point_text": lambda s, d: suppliers(s, d).select("row_id", fn.point_text(fn.coordinates(F.col("x"), F.floor(F.col("y"))), F.lit(-1)).alias("text")),
        "geo_detect": _geo_detect,
        "project_km": lambda s, d: project.project_km(events(s, d)).select("row_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")),
        "dist_euclid": _distance("euclid"),
        "dist_sq": _distance("sq"),
        "dist_haversine": _distance("haversine"),
        "dist_nd": _dist_nd,
        "parse_points": lambda s, d: points(_text_rows(s, d), _CSV),
        "parse_rejects": lambda s, d: rejects(_text_rows(s, d), _CSV),
        "reject_counts": _reject_counts,
        "service_answers": _service_answers,
        "time_window": lambda s, d: events(s, d).select("row_id", *(x.alias(n) for x, n in zip(fn.time_window(F.col("t"), DAY), ("low", "high"), strict=True))),
        "range_join": lambda s, d: joins.range_join(customers(s, d), PLAIN[0], digits=6),
        "range_join_haversine": lambda s, d: joins.range_join(suppliers(s, d), 300.0, metric=metrics.Haversine()).selectExpr("u", "v", rounded),
        "metric_range_join": lambda s, d: joins.range_join(customers(s, d), PLAIN[0], metric=_OWN, digits=6),
        "metric_dbscan_labels": lambda s, d: dbscan(customers(s, d), *PLAIN, metric=_OWN),
        "auto_metric_join": lambda s, d: joins.range_join(suppliers(s, d), 300.0, metric=project.auto_metric(suppliers(s, d), ["x", "y"])).selectExpr("u", "v", rounded),
        "neighbor_count": lambda s, d: joins.near_counts(customers(s, d), PLAIN[0]),
        "core_points": lambda s, d: joins.near_counts(customers(s, d), PLAIN[0]).where(F.col("n_neighbors") >= PLAIN[1]).select("row_id"),
        "st_range_join": lambda s, d: joins.range_join(project.project_km(events(s, d)), TIMED[0], time_eps=DAY).select("u", "v"),
        "knn_join": lambda s, d: _knn(s, d).selectExpr("row_id", "neighbor", "rank", rounded),
        "core_distance": lambda s, d: joins.core_distance(_knn(s, d), 5).select("row_id", F.round("core", 6).alias("core"), F.round(fn.density(F.col("core")), 6).alias("density")),
        "mutual_reachability": lambda s, d: mst.reachability_pairs(mst.with_core(suppliers(s, d), 3, ["x", "y"], Scratch(s, "q")), 2.0, ["x", "y"]).select("u", "v", F.round("w", 6).alias("w")),
        "mst_edges": lambda s, d: _mst(s, d, Scratch(s, "q")).select("u", "v", F.round("w", 6).alias("w")),
        "mst_edges_large": _mst_large,
        "dendrogram": _dendrogram,
        "stability": lambda s, d: _dendrogram(s, d).where("stable").select("node", "size", "own", "best"),
        "connected_components": lambda s, d: connected_components(joins.near_links(customers(s, d), 0.5)),
        "dbscan_labels": _plain_labels,
        "dbscan_nd_labels": _dbscan_nd,
        "dbscan_geo_labels": lambda s, d: dbscan(events(s, d), *GEO),
        "stdbscan_labels": lambda s, d: st_dbscan(events(s, d), *TIMED, time_eps=DAY),
        "hdbscan_labels": lambda s, d: hdbscan(suppliers(s, d), 2, 3, geo=False),
        "hdbscan_few_points": lambda s, d: hdbscan(suppliers(s, d), 1_000_000, 3, geo=False),
        "hdbscan_prim_labels": lambda s, d: hdbscan(suppliers(s, d), 2, 3, geo=False, tie_break="prim"),
        "size_filter": lambda s, d: result.size_filter(_plain_labels(s, d), 20),
        "renumber": lambda s, d: renumber(_plain_labels(s, d).select("row_id", F.when(F.col("cluster_id") >= 0, 1000 - F.col("cluster_id")).cast("long").alias("label")), 20),
        "csv_round_trip": _csv_round_trip,
        "cluster_summary": lambda s, d: result.summary(_plain_labels(s, d)),
        "cluster_sizes": lambda s, d: result.cluster_sizes(_plain_labels(s, d)),
        "cluster_members": lambda s, d: result.cluster_members(_plain_labels(s, d)),
        "cluster_member_chunks": lambda s, d: result.member_chunks(_plain_labels(s, d), 7, noise=True),
        "noise_points": lambda s, d: result.noise_points(_plain_labels(s, d)),
        "download_rows": lambda s, d: result.download_rows(_read(s, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_name", "c_nationkey"), _plain_labels(s, d)),
        "response_json": lambda s, d: result.to_json(result.response(suppliers(s, d), hdbscan(suppliers(s, d), 2, 3, geo=False), download_id="result")),
    }


def _labels_sql(source: str, eps: float, min_pts: int, least: int, time_eps: int | None = None, near: str = "") -> str:
    """CTEs p, pairs, core, lab, named, sized and out(row_id, cluster_id) of a fixed-radius clustering."""
    timed = f" AND abs(a.t - b.t) <= {time_eps}" if time_eps else ""
    return f"""
WITH RECURSIVE p AS MATERIALIZED ({source}),
pairs AS MATERIALIZED (SELECT a.row_id AS u, b.row_id AS v FROM p a JOIN p b ON a.y BETWEEN b.y - {eps * 1.001} AND b.y + {eps * 1.001} AND {near or f"{SQUARED} <= {eps * eps}::DOUBLE"}{timed}),
core AS MATERIALIZED (SELECT u AS id FROM pairs GROUP BY u HAVING count(*) >= {min_pts}),
edges AS MATERIALIZED (SELECT u, v FROM pairs WHERE u IN (SELECT id FROM core) AND v IN (SELECT id FROM core) AND u <> v),
lab(id, label) USING KEY (id) AS (
  SELECT id, id AS label FROM core
  UNION
  SELECT e.u, min(l.label) FROM lab l JOIN edges e ON e.v = l.id JOIN recurring.lab r ON r.id = e.u WHERE l.label < r.label GROUP BY e.u),
named AS (
  SELECT id, label FROM lab
  UNION ALL
  SELECT q.u, min(l.label) FROM pairs q JOIN lab l ON l.id = q.v WHERE q.u NOT IN (SELECT id FROM core) GROUP BY q.u),
sized AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS cluster_id, count(*) AS n FROM named GROUP BY label HAVING count(*) >= {least}),
out AS (
  SELECT p.row_id, coalesce(s.cluster_id, -1)::INTEGER AS cluster_id
  FROM p LEFT JOIN named l ON l.id = p.row_id LEFT JOIN sized s ON s.label = l.label)
"""


_KNN = f"""
SELECT * FROM (SELECT a.row_id, b.row_id AS neighbor, sqrt({SQUARED}) AS distance,
  row_number() OVER (PARTITION BY a.row_id ORDER BY sqrt({SQUARED}), b.row_id)::INTEGER AS rank FROM ({SUPPLIERS}) a, ({SUPPLIERS}) b)
"""
_REACH = """
SELECT a.row_id AS u, b.row_id AS v, greatest(ca.core, cb.core, sqrt({sq})) AS w
FROM ({s}) a JOIN ({s}) b ON a.row_id < b.row_id
JOIN (SELECT row_id, distance AS core FROM ({knn}) WHERE rank = {k}) ca ON ca.row_id = a.row_id
JOIN (SELECT row_id, distance AS core FROM ({knn}) WHERE rank = {k}) cb ON cb.row_id = b.row_id
"""


def _same_nation(value: str) -> str:
    return f"SELECT a.row_id AS u, b.row_id AS v, round({value}, 6) AS distance FROM ({SUPPLIERS}) a JOIN ({SUPPLIERS}) b ON a.x = b.x AND a.row_id < b.row_id"


_HALF = "(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))"
_HAVERSINE = f"(12742.0::DOUBLE * atan2(sqrt({_HALF}), sqrt(1 - {_HALF})))"


def oracle_sql() -> dict[str, str]:
    plain = _labels_sql(CUSTOMERS, *PLAIN)
    near = f"SELECT a.row_id AS u, b.row_id AS v, sqrt({SQUARED}) AS distance FROM ({CUSTOMERS}) a JOIN ({CUSTOMERS}) b ON {SQUARED} <= {PLAIN[0] ** 2}"
    reach = lambda k: _REACH.format(sq=SQUARED, s=SUPPLIERS, knn=_KNN, k=k)
    texts = "SELECT event_id AS row_id, event_id % 7 = 0 AS bad, event_id % 5 = 0 AS late, user_id, value, ts FROM events"
    return {
        "row_number_points": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey FROM customer",
        "row_number_shuffled": "SELECT count(DISTINCT l_orderkey) AS n, count(DISTINCT l_orderkey) AS ids, 0 AS first, count(DISTINCT l_orderkey) - 1 AS last, count(*) AS lines FROM lineitem",
        "coords_array_xy": f"SELECT row_id, x, y, 0.0::DOUBLE AS z FROM ({EVENTS})",
        "point_text": f"SELECT row_id, 'Point{{coord0=' || x::VARCHAR || ', coord1=' || floor(y)::VARCHAR || ', clusterId=-1}}' AS text FROM ({SUPPLIERS})",
        "geo_detect": f"SELECT 'events' AS name, abs(arg_min(x, row_id)) <= 180 AND abs(arg_min(y, row_id)) <= 90 AS geo FROM ({EVENTS}) "
        "UNION ALL SELECT 'part', abs(arg_min(p_retailprice, p_partkey)) <= 180 AND abs(arg_min(p_size, p_partkey)) <= 90 FROM part",
        "project_km": f"SELECT row_id, round(x, 6) AS x, round(y, 6) AS y FROM ({EVENTS_KM})",
        "dist_euclid": _same_nation(f"sqrt({SQUARED})"),
        "dist_sq": _same_nation(SQUARED),
        "dist_haversine": _same_nation(_HAVERSINE),
        "dist_nd": "SELECT a.vec_id AS u, b.vec_id AS v, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id",
        "parse_points": f"SELECT row_id, user_id::DOUBLE AS x, value AS y, epoch_us(date_trunc('second', ts)) // 1000 AS t FROM ({texts}) WHERE NOT bad AND NOT late",
        "parse_rejects": f"SELECT row_id, CASE WHEN bad THEN 'no coordinates' ELSE 'no time' END AS reason FROM ({texts}) WHERE bad OR late",
        "reject_counts": """
SELECT 'no lng' AS "case", 'no column lng' AS reason, count(*) AS n FROM events
UNION ALL SELECT 'no time', CASE WHEN event_id % 7 = 0 THEN 'no coordinates' ELSE 'no column timestamp' END AS reason, count(*) FROM events GROUP BY reason
UNION ALL SELECT 'other name', 'no column lat', count(*) FROM events
UNION ALL SELECT 'short', 'no coordinates', count(*) FROM events WHERE event_id % 7 = 0 OR event_id % 3 = 0""",
        "service_answers": """
SELECT 'fine' AS "case", 200 AS status, count(*)::VARCHAR AS message FROM customer
UNION ALL VALUES ('eps', 400, 'eps must be positive'), ('minPts', 400, 'minPts must be at least 1'), ('size', 400, 'minClusterSize must be at least 1'),
  ('timeEps', 400, 'timeEps must be positive'), ('unknown', 404, 'Result not found')""",
        "auto_metric_join": f"SELECT a.row_id AS u, b.row_id AS v, round({_HAVERSINE}, 6) AS distance FROM ({SUPPLIERS}) a, ({SUPPLIERS}) b WHERE {_HAVERSINE} <= 300",
        "hdbscan_few_points": "SELECT s_suppkey AS row_id, -1 AS cluster_id FROM supplier",
        "time_window": f"SELECT row_id, t - {DAY} AS low, t + {DAY} AS high FROM ({EVENTS})",
        "range_join": f"SELECT u, v, round(distance, 6) AS distance FROM ({near})",
        "range_join_haversine": f"SELECT a.row_id AS u, b.row_id AS v, round({_HAVERSINE}, 6) AS distance FROM ({SUPPLIERS}) a, ({SUPPLIERS}) b WHERE {_HAVERSINE} <= 300",
        "metric_range_join": f"SELECT a.row_id AS u, b.row_id AS v, round({APART}, 6) AS distance FROM ({CUSTOMERS}) a JOIN ({CUSTOMERS}) b ON {APART} <= {PLAIN[0]}::DOUBLE",
        "metric_dbscan_labels": _labels_sql(CUSTOMERS, *PLAIN, near=f"{APART} <= {PLAIN[0]}::DOUBLE") + "SELECT row_id, cluster_id FROM out",
        "neighbor_count": f"SELECT u AS row_id, count(*) AS n_neighbors FROM ({near}) GROUP BY u",
        "core_points": f"SELECT u AS row_id FROM ({near}) GROUP BY u HAVING count(*) >= {PLAIN[1]}",
        "st_range_join": f"WITH p AS MATERIALIZED ({EVENTS_KM}) SELECT a.row_id AS u, b.row_id AS v FROM p a JOIN p b ON a.t BETWEEN b.t - {DAY} AND b.t + {DAY} AND {SQUARED} <= {TIMED[0] ** 2}::DOUBLE",
        "knn_join": f"SELECT row_id, neighbor, rank, round(distance, 6) AS distance FROM ({_KNN}) WHERE rank <= 5",
        "core_distance": f"SELECT row_id, round(distance, 6) AS core, round(CASE WHEN distance > 1e-12 THEN 1 / distance ELSE {fn.MOST_DENSITY!r} END, 6) AS density FROM ({_KNN}) WHERE rank = 5",
        "mutual_reachability": f"SELECT u, v, round(w, 6) AS w FROM ({reach(3)}) WHERE w <= 2.0",
        "mst_edges": f"""
WITH RECURSIVE e AS MATERIALIZED ({reach(2)}),
both_ways AS MATERIALIZED (SELECT u AS a, v AS b, u, v, w FROM e UNION ALL SELECT v, u, u, v, w FROM e),
tree(seen, u, v, w) AS (
  SELECT [min(u)], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM e
  UNION ALL
  SELECT list_append(t.seen, n.b), n.u, n.v, n.w FROM tree t, LATERAL (
    SELECT b, u, v, w FROM both_ways WHERE list_contains(t.seen, a) AND NOT list_contains(t.seen, b) ORDER BY w, u, v LIMIT 1) n)
SELECT u, v, round(w, 6) AS w FROM tree WHERE u IS NOT NULL""",
        "mst_edges_large": f"""
WITH RECURSIVE p AS MATERIALIZED ({CUSTOMERS}),
d AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b, sqrt({SQUARED}) AS distance FROM p a JOIN p b ON true),
core AS MATERIALIZED (SELECT a AS id, distance AS core FROM (SELECT a, distance, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM d) WHERE rank = 4),
e AS MATERIALIZED (SELECT a, b, least(a, b) AS u, greatest(a, b) AS v, greatest(x.core, y.core, distance) AS w FROM d JOIN core x ON x.id = a JOIN core y ON y.id = b WHERE a <> b),
grown(id, u, v, w, inside) USING KEY (id) AS (
  SELECT row_id, NULL::BIGINT, NULL::BIGINT, CASE WHEN row_id = (SELECT min(row_id) FROM p) THEN -1.0::DOUBLE ELSE 'infinity'::DOUBLE END, false FROM p
  UNION
  (WITH next AS (SELECT id, u, v, w FROM recurring.grown WHERE NOT inside ORDER BY w, u, v, id LIMIT 1)
  SELECT id, u, v, w, true FROM next
  UNION ALL
  SELECT r.id, e.u, e.v, e.w, false FROM next n JOIN e ON e.a = n.id JOIN recurring.grown r ON r.id = e.b
  WHERE NOT r.inside AND (e.w < r.w OR e.w = r.w AND (r.u IS NULL OR e.u < r.u OR e.u = r.u AND e.v < r.v))))
SELECT u, v, round(w, 6) AS w FROM grown WHERE u IS NOT NULL""",
        "stability": _hierarchy_sql(reach(2), 3) + "SELECT -k AS node, size, round(own, 6) AS own, round(best, 6) AS best FROM nodes WHERE stable",
        "dendrogram": _hierarchy_sql(reach(2), 3)
        + """SELECT -k AS node, CASE WHEN l = 0 THEN u ELSE -l END AS "left", CASE WHEN r = 0 THEN v ELSE -r END AS "right", size, round(density, 6) AS density,
  round(parent_density, 6) AS parent_density, round(own, 6) AS own, round(best, 6) AS best, stable FROM nodes""",
        "hdbscan_labels": _hierarchy_sql(reach(2), 3)
        + f""", highest AS (SELECT i.p, max(i.k) AS k FROM inside i JOIN nodes n ON n.k = i.k AND n.stable GROUP BY i.p),
named AS (SELECT k, row_number() OVER (ORDER BY min(p)) - 1 AS cluster_id FROM highest GROUP BY k HAVING count(*) >= 3)
SELECT s.row_id, coalesce(n.cluster_id, -1)::INTEGER AS cluster_id FROM ({SUPPLIERS}) s LEFT JOIN highest h ON h.p = s.row_id LEFT JOIN named n ON n.k = h.k""",
        "connected_components": f"""
WITH RECURSIVE edges AS MATERIALIZED (SELECT a.row_id AS u, b.row_id AS v FROM ({CUSTOMERS}) a JOIN ({CUSTOMERS}) b ON a.row_id <> b.row_id AND {SQUARED} <= 0.25),
lab(id, label) USING KEY (id) AS (
  SELECT DISTINCT u AS id, u AS label FROM edges
  UNION
  SELECT e.u, min(l.label) FROM lab l JOIN edges e ON e.v = l.id JOIN recurring.lab r ON r.id = e.u WHERE l.label < r.label GROUP BY e.u)
SELECT id AS node, label AS component FROM lab""",
        "dbscan_labels": plain + "SELECT row_id, cluster_id FROM out",
        "size_filter": plain + "SELECT row_id, CASE WHEN cluster_id >= 0 AND count(*) OVER (PARTITION BY cluster_id) >= 20 THEN cluster_id ELSE -1 END::INTEGER AS cluster_id FROM out",
        "renumber": plain
        + ", large AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id DESC) - 1 AS id FROM out WHERE cluster_id >= 0 GROUP BY cluster_id HAVING count(*) >= 20) "
        "SELECT row_id, coalesce(id, -1)::INTEGER AS cluster_id FROM out LEFT JOIN large USING (cluster_id)",
        "csv_round_trip": plain + "SELECT c.c_custkey AS key, c.c_name, o.cluster_id::VARCHAR AS \"clusterId\" FROM customer c JOIN out o ON o.row_id = c.c_custkey",
        "dbscan_nd_labels": _labels_sql(
            f"SELECT vec_id AS row_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, list_transform(embedding[1:{MANY[0]}], lambda v: v::DOUBLE) AS e FROM embeddings",
            *MANY[1:],
            near=f"list_distance(a.e, b.e) <= {MANY[1]}::DOUBLE",
        )
        + "SELECT row_id, cluster_id FROM out",
        "dbscan_geo_labels": _labels_sql(EVENTS_KM, *GEO) + "SELECT row_id, cluster_id FROM out",
        "stdbscan_labels": _labels_sql(EVENTS_KM, *TIMED, DAY) + "SELECT row_id, cluster_id FROM out",
        "cluster_summary": plain + "SELECT count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS total_clusters, count(*) AS total_points, count(*) FILTER (cluster_id = -1) AS noise_points FROM out",
        "cluster_sizes": plain + "SELECT cluster_id, count(*) AS n_points FROM out WHERE cluster_id <> -1 GROUP BY cluster_id",
        "cluster_members": plain + "SELECT cluster_id, list(row_id ORDER BY row_id) AS members FROM out WHERE cluster_id <> -1 GROUP BY cluster_id",
        "cluster_member_chunks": plain
        + ", placed AS (SELECT *, (row_number() OVER (PARTITION BY cluster_id ORDER BY row_id) - 1) // 7 AS chunk FROM out) "
        "SELECT cluster_id, chunk, list(row_id ORDER BY row_id) AS members FROM placed GROUP BY cluster_id, chunk",
        "noise_points": plain + "SELECT row_id FROM out WHERE cluster_id = -1",
        "download_rows": plain + "SELECT c.c_custkey AS row_id, c.c_name, c.c_nationkey::VARCHAR AS c_nationkey, o.cluster_id::VARCHAR AS clusterId FROM customer c JOIN out o ON o.row_id = c.c_custkey",
    }


def _hierarchy_sql(reach: str, least: int) -> str:
    """CTEs up to nodes(k, u, v, l, r, size, ..., own, best, stable), inside(k, p) and ranked tree edges.

    Merge k of the sorted tree edges holds the points whose path to its edge uses edges up to k only, and
    its parts are the merges of the largest edges used before it.
    """
    return f"""
WITH RECURSIVE e AS MATERIALIZED ({reach}),
ends AS MATERIALIZED (SELECT u AS a, v AS b, u, v, w FROM e UNION ALL SELECT v, u, u, v, w FROM e),
grown(seen, u, v, w) AS (
  SELECT [min(u)], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM e
  UNION ALL
  SELECT list_append(t.seen, n.b), n.u, n.v, n.w FROM grown t, LATERAL (
    SELECT b, u, v, w FROM ends WHERE list_contains(t.seen, a) AND NOT list_contains(t.seen, b) ORDER BY w, u, v LIMIT 1) n),
tree AS MATERIALIZED (SELECT row_number() OVER (ORDER BY w, u, v) AS k, u, v, w FROM grown WHERE u IS NOT NULL),
steps AS MATERIALIZED (SELECT k, u AS a, v AS b FROM tree UNION ALL SELECT k, v, u FROM tree),
path(p, prev, q, m) AS (
  SELECT DISTINCT a, a, a, 0::BIGINT FROM steps
  UNION ALL
  SELECT t.p, t.q, s.b, greatest(t.m, s.k) FROM path t JOIN steps s ON s.a = t.q AND s.b <> t.prev),
paths AS MATERIALIZED (SELECT p, q, m FROM path),
inside AS MATERIALIZED (SELECT t.k, x.q AS p FROM tree t JOIN paths x ON x.p = t.u AND x.m <= t.k),
parts AS MATERIALIZED (
  SELECT t.k, t.u, t.v, t.w, max(CASE WHEN x.p = t.u THEN x.m END) AS l, max(CASE WHEN x.p = t.v THEN x.m END) AS r,
    count(*) FILTER (x.p = t.u) AS nl, count(*) FILTER (x.p = t.v) AS nr
  FROM tree t JOIN paths x ON x.p IN (t.u, t.v) AND x.m < t.k GROUP BY ALL),
dense AS MATERIALIZED (SELECT *, nl + nr AS size, CASE WHEN w > 1e-12 THEN 1 / w ELSE {fn.MOST_DENSITY!r} END AS density FROM parts),
lives AS MATERIALIZED (
  SELECT d.*, coalesce(up.density, 0) AS parent_density, up.k IS NULL OR up.nl >= {least} AND up.nr >= {least} AS top,
    (greatest(d.density, coalesce(up.density, 0)) - coalesce(up.density, 0)) * d.size AS life
  FROM dense d LEFT JOIN dense up ON d.k IN (up.l, up.r)),
worth(k, owns, bests) AS (
  SELECT 0::BIGINT, []::DOUBLE[], []::DOUBLE[]
  UNION ALL
  SELECT n.k, list_append(t.owns, n.life + CASE WHEN nl >= {least} AND nr >= {least} THEN 0 WHEN nl >= {least} THEN coalesce(owns[l], 0) WHEN nr >= {least} THEN coalesce(owns[r], 0) ELSE 0 END),
    list_append(t.bests, CASE
      WHEN nl >= {least} AND nr >= {least} THEN greatest(coalesce(owns[l], 0), coalesce(bests[l], 0)) + greatest(coalesce(owns[r], 0), coalesce(bests[r], 0))
      WHEN nl >= {least} THEN coalesce(bests[l], 0) WHEN nr >= {least} THEN coalesce(bests[r], 0) ELSE 0 END)
  FROM worth t JOIN lives n ON n.k = t.k + 1),
nodes AS MATERIALIZED (
  SELECT n.*, t.owns[n.k] AS own, t.bests[n.k] AS best, n.top AND t.owns[n.k] > t.bests[n.k] AS stable
  FROM lives n, (SELECT owns, bests FROM worth ORDER BY k DESC LIMIT 1) t)
"""


def flagship(spark: SparkSession, sf_dir: str, eps: float = 4.0) -> DataFrame:
    """Customers clustered, with their payload and cluster number."""
    labels = dbscan(customers(spark, sf_dir), eps, PLAIN[1], PLAIN[2], geo=False)
    return _read(spark, sf_dir, "customer").join(labels, F.col("c_custkey") == F.col("row_id")).drop("row_id")
