"""Hard negatives against brute force and SQL."""

import random

import numpy as np
import pytest
from oracle import rows_of, rows_of_sql
from pyspark.sql import functions as F

from clusterloom.llm import hard_negatives
from clusterloom.llm.hard_negatives import product

SCHEMA = "id long, label int, vector array<long>, anchor boolean"


def brute(rows, positives, negatives, low, high):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for i, a in enumerate(rows):
        if not a[3]:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], j) for j, b in enumerate(rows) if j != i]
        mine = sorted(s for s in scored if rows[s[2]][1] == a[1])[:positives]
        for p in mine:
            fit = sorted(s for s in scored if rows[s[2]][1] != a[1] and low * -p[0] <= 100 * -s[0] <= high * -p[0])
            out += [(a[0], p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("anchors, rows, slab", [(1024, 2048, 128), (3, 5, 2)])
def test_against_brute_force(spark, monkeypatch, anchors, rows, slab):
    for name, value in (("ANCHORS", anchors), ("ROWS", rows), ("SLAB", slab), ("DIMENSIONS", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(3)
    made = [(k, rng.choice([None, 0, 1, 2, 2, 2]), [rng.randint(-4, 9) for _ in range(rng.choice([5, 5, 5, 3]))], k % 4 == 0) for k in range(60)]
    made += [(60, 1, None, True), (61, 1, [1, None], True), (None, 1, [9, 9], True), (62, 2, [], True), (64, 2, [3, 3, 3, 3, 3], None)]
    made += [(65 + k, 2, [4, 4, 4, 4, 4], k == 0) for k in range(6)]  # one vector for many rows
    found = hard_negatives.hard_negatives(spark.createDataFrame(made, SCHEMA).repartition(3), 4, 3, 50, 95)
    assert sorted(tuple(r) for r in found.collect()) == brute(made, 4, 3, 50, 95)


def test_shared_ids_and_empty(spark):
    made = [(0, 1, [10, 0], True), (0, 1, [10, 0], True), (1, 2, [9, 0], False)]
    found = hard_negatives.hard_negatives(spark.createDataFrame(made, SCHEMA))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0, 1, 1, 100, 90)] * 2
    for none in (made[2:], []):
        assert hard_negatives.hard_negatives(spark.createDataFrame(none, SCHEMA)).count() == 0


def test_product_is_exact():
    rng = np.random.default_rng(0)
    for most in (300, 1 << 30):
        a, b = rng.integers(-most, most, (5, 7)), rng.integers(-most, most, (4, 7))
        assert product(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


def test_op11_equals_sql(spark, sf):
    assert rows_of(hard_negatives.op11_hard_negatives(spark, sf)) == rows_of_sql(sf, hard_negatives.OP11_SQL)


def test_op11_broken_vectors(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").limit(120)
    broken = rows.withColumn("embedding", F.when(F.col("vec_id") % 10 == 1, F.array(F.lit(float("nan")).cast("float"))).when(F.col("vec_id") % 10 == 2, F.lit(None)).otherwise(F.col("embedding")))
    broken.withColumn("label", F.when(F.col("vec_id") % 10 != 3, F.col("label"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "d").mkdir()
    next((tmp_path / "in").glob("part-*")).rename(tmp_path / "d/embeddings.parquet")
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/d/embeddings.parquet'")
    found = hard_negatives.op11_hard_negatives(spark, str(tmp_path / "d"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(con.sql(hard_negatives.OP11_SQL).fetchall())


def test_waves_bound_what_is_on_disk(spark, monkeypatch):
    """Whatever anchors and rows there are, no table of scores holds more than a wave of them."""
    for name, value in (("ANCHORS", 4), ("ROWS", 8), ("SLAB", 2), ("DIMENSIONS", 2), ("SCORES", 300)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(6)
    made = [(k, k % 3, [rng.randint(-9, 9) for _ in range(5)], k % 4 == 0) for k in range(70)]
    sizes, save = [], hard_negatives.Scratch.save

    def counted(self, df, name, *args):
        found = save(self, df, name, *args)
        if name == "slabs":
            sizes.append(sum(len(r.a_rows) * len(r.b_rows) // 64 for r in found.select("a_rows", "b_rows").collect()))
        return found

    monkeypatch.setattr(hard_negatives.Scratch, "save", counted)
    found = hard_negatives.hard_negatives(spark.createDataFrame(made, SCHEMA), 4, 3, 50, 95)
    assert sorted(tuple(r) for r in found.collect()) == brute(made, 4, 3, 50, 95)
    assert sum(sizes) == 18 * 70 and max(sizes) <= 300


def test_squeezed_scores():
    values = np.array([0, -1, 1, 255, -256, 1 << 40, -(1 << 63), (1 << 63) - 1])
    assert hard_negatives.unsqueezed(hard_negatives.squeezed(values)).tolist() == values.tolist()
