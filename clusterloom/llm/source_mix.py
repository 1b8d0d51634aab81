"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, targets follow from the weights, and every document is emitted
floor(rate) times plus once more with probability equal to the rate's fraction.  The draw is a hash
of the seed and doc_id, so a rerun, a retry of a task or another partitioning emits the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterloom.llm.tables import WORD, fresh, table
from clusterloom.plans.scratch import Scratch

#: Weights given to the sources in code point order, repeating; a null source comes last.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this.
MOST_REPEATS = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and doc_id only (52 bits of an MD5)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from one row per document with source and size.

    target is least(most * source_size, level * weight) with the level at which the targets add up
    to all sizes; that is where repeated resharing of the excess ends.  A source is held at its
    limit if the level exceeds limit / weight, so sources in order of that ratio are held from the
    front and the level is the largest of the levels that hold a prefix.

    The windows run over one row per source, after an aggregation with map-side combine; documents
    never meet in them.  All sizes zero: every target is zero.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    share = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", share.cast("long")).withColumn("limit", F.col("source_size") * most)
    front = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    held = F.coalesce(F.sum("limit").over(front.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(front.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    per = per.withColumn("level", (total - held).cast("double") / open_weight.cast("double"))
    level = F.greatest(F.max("level").over(everything), F.lit(0.0))
    target = F.least(F.col("limit").cast("double"), level * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of `docs`.

    `docs` needs doc_id, source and text; other columns are ignored.  A null text has size 0, a null
    doc_id draws as the empty string, rows that share a doc_id draw alike.  Sizes are counted once
    and written to the shared folder, so the text is scanned once.  The join back carries numbers
    only: AQE broadcasts the sources if they are few and splits a hot one if they are not.
    """
    kept = Scratch(docs.sparkSession, "mix").save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    rates = targets(kept, weights, most).withColumnRenamed("source", "of_source")
    joined = kept.join(rates, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("rate", rate)
    whole = F.floor("rate")
    extra = (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", (whole + extra).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """`docs` with every row repeated as often as the mix takes it; columns stay as they are.

    The rates are worked out per source first; then each row computes its own copies, so texts are
    joined with the few source rows only and never shuffled by doc_id.
    """
    kept = Scratch(docs.sparkSession, "mix").save(docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("size")), "sizes")
    rates = targets(kept, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    of_source, its_rate, copy = fresh(docs.columns, "of_source", "rate", "copy")
    rates = rates.select(F.col("source").alias(of_source), rate.alias(its_rate))
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col(of_source)))
    whole = F.floor(its_rate)
    copies = whole + (draw(F.col("doc_id"), seed) < F.col(its_rate) - whole).cast("long")
    repeated = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of `documents`; see `plan_mix` for nulls and repeated ids."""
    planned = plan_mix(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT source, source_size, {MOST_REPEATS} * source_size AS most,
    [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)]::BIGINT AS weight FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT::DOUBLE
    / (sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT::DOUBLE AS level
  FROM ranked),
goals AS (
  SELECT source, source_size, least(most::DOUBLE, greatest(max(level) OVER (), 0) * weight) AS target FROM levels),
rates AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken
FROM rates
"""
