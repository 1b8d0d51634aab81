"""Points from CSV files or from any DataFrame."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterloom.functions.points import parse_millis, parse_number
from clusterloom.params import ClusterParams
from clusterloom.plans.names import fresh
from clusterloom.plans.scratch import Scratch

#: monotonically_increasing_id holds the task above, and the row in it in so many bits (fixed value)
TASK_BITS = 33
#: tasks whose counts are summed together: 2^RUN_BITS
RUN_BITS = 10


def numbered(df: DataFrame, order: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """`df` plus row_id from 0, dense; a column of that name is kept as _row_id.

    With `order`, by those columns (rows that are equal there in any order): the rows are sorted by ranges,
    so no task sees them all.  Else in the order of partitions and rows, without a shuffle of rows.

    `df` is computed once: each task writes its rows to the shared folder with their place in it, and
    numbers come from what was written.  Counting one run and numbering another would lose rows where
    the two are cut into partitions differently, as behind a shuffle.
    """
    scratch = scratch or Scratch(df.sparkSession, "numbered")
    return _numbered(df.orderBy(*order) if order else df, [], scratch)


def _numbered(df: DataFrame, group: list[Column], scratch: Scratch) -> DataFrame:
    """Number the rows task by task, or in the order of `group`: columns that have one value on a run of rows of one task."""
    place, task, before, own, *keys = fresh(["row_id", *df.columns], "place", "task", "before", "row_id", *(f"g{k}" for k in range(len(group))))
    rest = {c: own if c.lower() == "row_id" else c for c in df.columns}
    placed = df.select(*(F.col(f"`{c}`").alias(n) for c, n in rest.items()), F.monotonically_increasing_id().alias(place), *(g.alias(k) for g, k in zip(group, keys, strict=True)))
    written = scratch.save(placed, "placed").withColumn(task, F.shiftright(place, TASK_BITS))
    keys = keys or [task]
    runs = written.groupBy(*keys).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    if group:
        runs = scratch.save(runs.orderBy(*keys).withColumn("at", F.monotonically_increasing_id()), "runs")
        runs = running_total(runs, "at", F.shiftright("at", TASK_BITS), "n")
    else:
        runs = running_total(runs.withColumn("at", F.col(task)), "at", F.shiftright("at", RUN_BITS), "n")
    runs = runs.select(*keys, (F.col("before") - F.col("first")).alias(before))
    return written.join(runs, keys).select((F.col(place) + F.col(before)).alias("row_id"), *(F.col(f"`{n}`") for n in rest.values()))


def running_total(counts: DataFrame, at: str, block: Column, n: str) -> DataFrame:
    """`counts` plus before, the sum of `n` over all rows with a smaller `at`.

    `block` cuts the rows into consecutive ranges of `at`, each summed by a task of its own; only the
    blocks' totals meet in one task.
    """
    blocked = counts.withColumn("block", block)
    inside = F.sum(n).over(W.partitionBy("block").orderBy(at).rowsBetween(W.unboundedPreceding, -1))
    totals = blocked.groupBy("block").agg(F.sum(n).alias("total"))
    totals = totals.select("block", F.sum("total").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("base"))
    found = blocked.withColumn("inside", inside).join(totals, "block")
    return found.select(*counts.columns, (F.coalesce("inside", F.lit(0)) + F.coalesce("base", F.lit(0))).alias("before"))


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """All columns as text, by the header row, plus row_id in the order of files and lines.

    A cell in quotes may hold line ends, so a file is read by one task; large files without such cells are
    split and read in parallel with `multi_line` off.  A column of the file named row_id comes as _row_id.
    ValueError for files without columns.
    """
    read = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)
    if not read.columns:
        raise ValueError("File is empty")
    # A file, or the block of it that a task reads, is one run of rows.
    return _numbered(read, [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")], scratch or Scratch(spark, "csv"))


class Parsed(NamedTuple):
    """`rows` with x, y and t (null where `rows` have no time) and the reason why a row is no point, under names of their own."""

    rows: DataFrame
    x: str
    y: str
    t: str
    reason: str


def parsed(rows: DataFrame, params: ClusterParams) -> Parsed:
    """`rows` plus their coordinates, their time for stdbscan, and a reason: why a row is no point, else null.

    Role columns are looked up by exact name.  A missing one makes every row unusable, as do values that
    are no finite number or no time.  Numbers and timestamps are taken as they are.
    """
    kinds = dict(rows.dtypes)
    x, y, t, why = fresh(rows.columns, "x", "y", "t", "reason")

    def number(name: str):
        if name not in kinds:
            return F.lit(None).cast("double")
        return parse_number(F.col(f"`{name}`")) if kinds[name] == "string" else parse_number(F.col(f"`{name}`").cast("string"))

    out = rows.withColumn(x, number(params.lng_field)).withColumn(y, number(params.lat_field))
    missing = [f for f in (params.lng_field, params.lat_field) if f not in kinds]
    reason = F.lit(f"no column {missing[0]}") if missing else F.when(F.col(x).isNull() | F.col(y).isNull(), F.lit("no coordinates"))
    time = F.lit(None).cast("long")
    if params.kind == "stdbscan":
        name = params.time_field
        if name not in kinds:
            bad = F.lit(f"no column {name}")
        else:
            column = F.col(f"`{name}`")
            time = parse_millis(column) if kinds[name] == "string" else column.cast("long") if kinds[name] in ("bigint", "int") else F.unix_millis(column.cast("timestamp"))
            bad = F.when(F.col(t).isNull(), F.lit("no time"))
        reason = F.coalesce(reason, bad)
    return Parsed(out.withColumn(t, time).withColumn(why, reason), x, y, t, why)


def points(rows: DataFrame, params: ClusterParams) -> DataFrame:
    """The usable rows, with x, y (and t) for the operators."""
    found = parsed(rows, params)
    timed = {found.t: "t"} if params.kind == "stdbscan" else {}
    return found.rows.where(F.col(found.reason).isNull()).select("row_id", *(F.col(c).alias(n) for c, n in ({found.x: "x", found.y: "y"} | timed).items()))


def rejects(rows: DataFrame, params: ClusterParams) -> DataFrame:
    """(row_id, reason) of the rows that are no points."""
    found = parsed(rows, params)
    return found.rows.where(F.col(found.reason).isNotNull()).select("row_id", F.col(found.reason).alias("reason"))


def write_csv(rows: DataFrame, path: str, one_file: bool = True) -> None:
    """CSV with a header, in order of row_id, which is not written; missing values are empty.

    One file, which one task writes, or without `one_file` as many as the sort has ranges, in order of name.
    """
    rest = [c for c in rows.columns if c != "row_id"]
    texts = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rest)
    found = rows.orderBy("row_id").select(*texts)
    (found.coalesce(1) if one_file else found).write.csv(path, header=True, escape='"', emptyValue="")
