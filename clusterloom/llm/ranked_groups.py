"""The first lines of every group, by a coarse pair that many lines share, then by finer columns.

1. Every task folds its lines into a map from group to the k best distinct pairs and the number of lines
   that have them.  Such truncated maps merge exactly: a pair among the best k of all lines is among the
   best k of every part that holds it, so no count is ever cut off.  Maps are merged by group in two
   levels, first those of a share of the tasks, so a group that every task holds meets few at a time.
2. A merged map says which pairs the first k lines can have.  Lines with another pair go, by an equi-join
   on group and pair whose hot keys AQE splits.
3. What is left is sorted by ranges of (group, pair, finer columns), so a group, or a pair that a third of
   all lines share, may lie in many tasks.  A task numbers its own lines in each group and passes on the
   first k; those are numbered in order of tasks, again in two levels.

Nothing here goes to the driver, into a broadcast that Spark has not sized, or whole into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterloom.llm.tables import fresh, table
from clusterloom.plans.scratch import Scratch

#: maps of so many tasks are merged in one of the tasks of the first level: every FAN-th one
FAN = 32
#: lines that a task folds at a time
FOLD_ROWS = 1 << 18

Batches = Iterator[pa.RecordBatch]


def merge_maps(keys: list[np.ndarray], n: np.ndarray, n_group: int, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(keys, counts, lines in better pairs of the group) of the `k` least distinct keys of each group, in order.

    The first `n_group` of the `keys` name the group, the others order its pairs.
    """
    if not len(n):
        return keys, n, n
    order = np.lexsort(tuple(reversed(keys)))
    keys, n = [c[order] for c in keys], n[order]

    def changes(columns: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(columns[0]), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return new

    first = np.flatnonzero(changes(keys))
    keys, n = [c[first] for c in keys], np.add.reduceat(n, first)
    opens = changes(keys[:n_group]) if n_group else np.arange(len(n)) == 0
    start = np.maximum.accumulate(np.where(opens, np.arange(len(n)), 0))
    kept = np.arange(len(n)) - start < k
    total = np.cumsum(n) - n
    return [c[kept] for c in keys], n[kept], (total - total[start])[kept]


def _fold(n_group: int, k: int, last: bool = False) -> Callable[[Batches], Batches]:
    """Rows (keys, count) to truncated maps; with `last`, only pairs with fewer than `k` lines before them, and that number."""

    def run(batches: Batches) -> Batches:
        held: list[list[np.ndarray]] = []
        names: list[str] = []

        def merged() -> list[np.ndarray]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            keys, n, better = merge_maps(columns[:-1], columns[-1], n_group, k)
            if not last:
                return [*keys, n]
            return [c[better < k] for c in (*keys, n, better)]

        rows = 0
        for batch in batches:
            names = batch.schema.names
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            rows += batch.num_rows
            if rows >= FOLD_ROWS and not last:
                held = [merged()]
                rows = 0
        if held:
            found = merged()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], [*names, *(["better"] if last else [])])

    return run


def best_pairs(keyed: DataFrame, group: list[str], pair: list[str], k: int) -> DataFrame:
    """(group, pair, n, better): for each group the pairs that its first `k` lines have, the number of
    lines with that pair, and of those with a better one.  All columns are longs without nulls, pairs
    ascending.
    """
    names = [*group, *pair]
    (n, better, salt) = "n", "better", "salt"
    schema = ", ".join(f"`{c}` long" for c in (*names, n))
    local = keyed.select(*names, F.lit(1).cast("long").alias(n)).mapInArrow(_fold(len(group), k), schema)
    some = local.withColumn(salt, F.spark_partition_id() % FAN).repartition(*group, salt).drop(salt)
    merged = some.mapInArrow(_fold(len(group), k), schema)
    whole = merged.repartition(*group) if group else merged.repartition(1)
    return whole.mapInArrow(_fold(len(group), k, last=True), f"{schema}, {better} long")


def _numbered(group: list[str], k: int, task: str, place: str) -> Callable[[Batches], Batches]:
    """Of sorted lines the first `k` of each group in this task, with the task and the line's place among them."""

    def run(batches: Batches) -> Batches:
        part = TaskContext.get().partitionId()
        before: tuple | None = None
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in group]
            rows = np.arange(batch.num_rows)
            opens = np.zeros(batch.num_rows, bool)
            for c in keys:
                opens[1:] |= c[1:] != c[:-1]
            head = tuple(c[0] for c in keys)
            opens[0] = head != before
            start = np.maximum.accumulate(np.where(opens, rows, -1))
            at = np.where(start >= 0, rows - start, rows + seen)
            before, seen = tuple(c[-1] for c in keys), int(at[-1]) + 1
            kept = pa.array(np.flatnonzero(at < k))
            if len(kept):
                chosen = batch.take(kept)
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(np.full(len(kept), part, np.int64)), pa.array(at[at < k].astype(np.int64))], [*batch.schema.names, task, place])

    return run


def first_lines(lines: DataFrame, group: list[str], pair: list[tuple[str, bool, bool]], order: list[str], k: int, scratch: Scratch | None = None) -> DataFrame:
    """`lines` that come among the first `k` of their group, with pos (from 1) and tied.

    `group` and the columns of `pair` are integers; null is a group of its own.  `pair` names columns with
    (descending, nulls first); lines that agree in all of them are tied, and `tied` counts all such
    lines of the group, returned or not.  Within a pair lines go by `order`, ascending, nulls last; lines
    equal there too go in any order, each with a place of its own.  Columns of `lines` named pos or tied
    come as _pos and _tied.  Empty tables give an empty result, ValueError for k below 1.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    scratch = scratch or Scratch(lines.sparkSession, "first-lines")
    pos, tied = "pos", "tied"
    renamed = {c: f"_{c}" if c.lower() in (pos, tied) else c for c in lines.columns}
    nulls, task, place, row, n, better, *rest = fresh(
        [*renamed.values(), pos, tied], "nulls", "task", "place", "row", "n", "better", *(f"g{i}" for i in range(len(group))), *(f"p{i}" for i in range(2 * len(pair)))
    )
    groups, pairs = [nulls, *rest[: len(group)]], rest[len(group) :]
    mask = F.lit(0).cast("long")
    for i, c in enumerate(group):
        mask = mask + F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i)).otherwise(0)
    keys = [mask.alias(nulls), *(F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias(g) for c, g in zip(group, groups[1:], strict=True))]
    for i, (c, down, nulls_first) in enumerate(pair):
        value = F.col(f"`{c}`").cast("long")
        keys.append(F.when(value.isNull(), F.lit(0 if nulls_first else 1)).otherwise(1 if nulls_first else 0).cast("long").alias(pairs[2 * i]))
        keys.append(F.coalesce(F.bitwise_not(value) if down else value, F.lit(0)).alias(pairs[2 * i + 1]))
    keyed = lines.select(*(F.col(f"`{c}`").alias(to) for c, to in renamed.items()), *keys)

    wanted = best_pairs(keyed.select(*groups, *pairs), groups, pairs, k).select(*groups, *pairs, F.col("n").alias(n))
    left = keyed.join(wanted.hint("shuffle_hash"), [*groups, *pairs])
    left = scratch.save(left, "left").withColumn(row, F.monotonically_increasing_id())
    sort = [*groups, *pairs, *(F.col(f"`{renamed[c]}`").asc_nulls_last() for c in order), row]
    ranged = left.repartitionByRange(*sort).sortWithinPartitions(*sort).drop(row)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + f", `{task}` long, `{place}` long"
    early = ranged.mapInArrow(_numbered(groups, k, task, place), schema)
    near = W.partitionBy(*groups, F.shiftright(task, 5)).orderBy(task, place)
    early = early.withColumn(row, F.row_number().over(near)).where(F.col(row) <= k).drop(row)
    placed = early.withColumn(pos, F.row_number().over(W.partitionBy(*groups).orderBy(task, place)).cast("long")).where(F.col(pos) <= k)
    return placed.select(*(F.col(f"`{c}`") for c in renamed.values()), pos, F.col(n).alias(tied))


#: op13's number of lines from each group
PLACES = 2
#: every so many-th sale, by the crc32 of its id, has its lines ranked together
TOGETHER = 5


def _whole(value: Column) -> Column:
    """floor(value + 0.5) as a long, null for what is no finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.floor(value + 0.5)).cast("long")


def sale_ranks(lines: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The first PLACES lines of each vendor, part (item_id mod 5) and month, and of all sales ranked together.

    A null vendor_id is a group of its own, a null item_id or shipped_at counts as -1.  Amounts and
    discounts that are no finite numbers count as null; a null percent comes last.
    """
    sale = F.col("sale_id").cast("long")
    together = F.coalesce(F.crc32(sale.cast("string").cast("binary")) % TOGETHER == 0, F.lit(False))
    month = F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1)).cast("long")
    one = lambda c: F.when(together, F.lit(-1)).otherwise(c).cast("long")
    ready = lines.select(
        one(F.col("vendor_id")).alias("vendor_id"),
        one(F.coalesce(F.pmod(F.col("item_id"), F.lit(5)), F.lit(-1))).alias("part"),
        one(month).alias("month"),
        sale.alias("sale_id"),
        F.col("line_no").cast("long").alias("line_no"),
        F.col("quantity").cast("long").alias("quantity"),
        _whole(F.lit(100) * F.col("discount").cast("double")).alias("percent"),
        _whole(F.lit(100) * F.col("amount").cast("double")).alias("amount_cents"),
        F.floor(F.col("quantity") / F.lit(10)).cast("long").alias("tens"),
    )
    found = first_lines(ready, ["vendor_id", "part", "month"], [("tens", True, True), ("percent", False, False)], ["sale_id", "line_no", "quantity", "amount_cents"], PLACES, scratch)
    return found.select("vendor_id", "part", "month", "pos", F.col("pos").alias("place"), "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


def op13_ranked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two lines of every group of `sale_lines`; see `sale_ranks`."""
    return sale_ranks(table(spark, sf_dir, "sale_lines"))


def _crc32_sql(text: str) -> str:
    """crc32 of a text of ASCII characters, by the usual table of 256 entries, which is made from its rule."""
    entries = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        entries.append(value)
    step = f"xor(a >> 8, list_extract({entries}, (xor(a, b) & 255) + 1)::BIGINT)"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda a, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


OP13_SQL = f"""
WITH sales_of AS (
  SELECT sale_id, {_crc32_sql("sale_id::VARCHAR")} % {TOGETHER} = 0 AS together FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL)),
ready AS (
  SELECT CASE WHEN together THEN -1 ELSE vendor_id END::BIGINT AS vendor_id,
    CASE WHEN together THEN -1 ELSE coalesce((item_id % 5 + 5) % 5, -1) END::BIGINT AS part,
    CASE WHEN together THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END::BIGINT AS month,
    l.sale_id::BIGINT AS sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity, floor(100 * discount + 0.5)::BIGINT AS percent,
    floor(100 * amount + 0.5)::BIGINT AS amount_cents, floor(quantity / 10.0)::BIGINT AS tens
  FROM sale_lines l LEFT JOIN sales_of s ON s.sale_id = l.sale_id),
placed AS (
  SELECT *, count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied, row_number() OVER (
    PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS LAST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos
  FROM ready)
SELECT vendor_id, part, month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied FROM placed WHERE pos <= {PLACES}
"""
