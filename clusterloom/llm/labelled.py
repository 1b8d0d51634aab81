"""The labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo `folds`; a null doc_id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_rows(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, text, label): up to `per_class` labelled documents of either class outside fold `held`.

    The choice goes by a hash of doc_id, so it is the same on every run.  This is the one bounded
    sample of a classifier: 2 * per_class rows whatever the input's size, which is what makes the
    broadcast below bounded.  A doc_id counts once: with labels that contradict each other it is passed
    over, and of documents that share one the smallest text is taken.  Labels other than 0 and 1, and
    null ids and texts, are passed over.
    """
    usable = labels.select(F.col("doc_id").cast("long"), F.col(target).cast("int").alias("label"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held))
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    order = F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string")))
    parts = [usable.where(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
