"""Grouped ranking against brute force and SQL."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import TABLES, rows_of, rows_of_sql
from pyspark.sql import functions as F

from clusterloom.llm import ranked_groups
from clusterloom.llm.ranked_groups import first_lines, merge_maps

SCHEMA = "g long, h int, p int, q long, a long, b string, pos string"


def brute(rows, k):
    """(row, pos, tied) of rows (g, h, p, q, a, b, pos): p descending with nulls first, q ascending with nulls last."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0], r[1]].append(r)
    last = lambda v: (v is None, v if v is not None else 0)
    out = []
    for members in groups.values():
        members.sort(key=lambda r: (r[2] is not None, -(r[2] or 0), last(r[3]), last(r[4]), (r[5] is None, r[5] or "")))
        count = Counter((r[2], r[3]) for r in members)
        out += [(*r, i + 1, count[r[2], r[3]]) for i, r in enumerate(members[:k])]
    return out


@pytest.mark.parametrize("k", [1, 2, 5])
def test_against_brute_force(spark, k):
    rng = random.Random(k)
    pick = lambda n: rng.choice([None, *range(-1, n)])
    rows = [(pick(3) if rng.random() < 0.6 else 7, pick(2), pick(4), pick(3), pick(5), rng.choice([None, "", "x", "y"]), "old") for _ in range(800)]
    rows += rows[:50]
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = first_lines(table, ["g", "h"], [("p", True, True), ("q", False, False)], ["a", "b"], k)
    assert found.columns == ["g", "h", "p", "q", "a", "b", "_pos", "pos", "tied"]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, brute(rows, k)))


def test_one_line_for_all(spark):
    """A group whose lines are all the same is spread over tasks and numbered once."""
    table = spark.range(0, 3000, 1, 9).select(F.lit(1).alias("g"), F.lit(None).cast("int").alias("p"), F.lit(2).alias("a"))
    found = first_lines(table, ["g"], [("p", True, True)], ["a"], 3).orderBy("pos").collect()
    assert [(r.pos, r.tied) for r in found] == [(1, 3000), (2, 3000), (3, 3000)]


def test_extremes_and_empty(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    table = spark.createDataFrame([(least, most), (least, least), (most, 0), (None, 0), (None, None)], "g long, p long")
    found = first_lines(table, ["g"], [("p", True, False)], [], 1)
    assert {(r.g, r.p, r.tied) for r in found.collect()} == {(least, most, 1), (most, 0, 1), (None, 0, 1)}
    assert first_lines(table.limit(0), ["g"], [("p", True, False)], [], 1).count() == 0
    with pytest.raises(ValueError):
        first_lines(table, ["g"], [("p", True, False)], [], 0)


def test_maps_merge_exactly():
    """However lines are cut into parts, merged maps of parts are the map of all."""
    rng = np.random.default_rng(1)
    g, p = rng.integers(0, 4, 500), rng.integers(0, 9, 500)
    ones = np.ones(500, np.int64)
    whole = merge_maps([g, p], ones, 1, 3)
    for size in (7, 100, 499):
        keys, n = [np.zeros(0, np.int64)] * 2, np.zeros(0, np.int64)
        for low in range(0, 500, size):
            part, count, _ = merge_maps([g[low : low + size], p[low : low + size]], ones[low : low + size], 1, 3)
            keys, n, better = merge_maps([np.concatenate(c) for c in zip(keys, part, strict=True)], np.concatenate([n, count]), 1, 3)
        for a, b in zip((*keys, n, better), (*whole[0], *whole[1:]), strict=True):
            assert np.array_equal(a, b)


def test_broken_lines(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, None, None, None, None, nan, inf, None, None), (1, 1, -3, 5, -11, -0.005, nan, "x", None), (1, 1, -3, 5, -11, -0.005, nan, "x", None)]
    table = spark.createDataFrame(rows, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz")
    found = {(r.vendor_id, r.part, r.month, r.pos, r.quantity, r.percent, r.amount_cents, r.tied) for r in ranked_groups.sale_ranks(table).collect()}
    assert found == {(None, -1, -1, 1, None, None, None, 1), (5, 2, -1, 1, -11, None, 0, 2), (5, 2, -1, 2, -11, None, 0, 2)}


def test_op13_equals_sql(spark, sf, monkeypatch):
    monkeypatch.setattr("oracle.TABLES", [*TABLES, "sale_lines"])
    assert rows_of(ranked_groups.op13_ranked_groups(spark, sf)) == rows_of_sql(sf, ranked_groups.OP13_SQL)
