"""URL filter: listed rules first, else the ratio of two character language models.

Two smoothed variable-order Markov models are trained, one on URLs that the rules accept and one on
URLs that they reject.  A URL that no rule decides is blocked if the difference of its
log-likelihoods, divided by its length, lies above a threshold calibrated on labelled URLs that the
models have not seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clusterloom.llm.tables import table

#: (verdict, host, path): a rule fits its host and all subdomains, and paths that start with its path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 6
SLOTS = 1 << 18
#: share of accepted calibration URLs that may be blocked
MOST_LOST = 0.02


class Model(NamedTuple):
    """Per order, hashed counts of context and next character, of contexts, and of kinds after a context; for both verdicts."""

    pairs: np.ndarray
    contexts: np.ndarray
    kinds: np.ndarray
    threshold: float


def host_of(url: Column) -> Column:
    """Behind the first "://" up to "/", "?", "#" or the end, A-Z in lower case; null or no "://": empty."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to "?", "#" or the end; null or no "://": empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """`pages` (with url) plus host, path, rule and rule_verdict; the longest fitting rule wins, else both are null.

    Columns of `pages` with one of these four names are replaced.
    Rules of one length go in the order given.  They are a short parameter, compiled into one expression.
    """
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, of_host, of_path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | F.endswith(host, F.lit(f".{of_host}"))) & F.startswith(path, F.lit(of_path))
        rule = F.when(fits, F.lit(of_host + of_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    found = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return found.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _slots(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per order and character the slots of (context, character) and of the context; and each character's URL.

    Characters are the bytes of host and path behind start bytes, closed by an end byte.
    """
    raw = [b"\x02" * ORDER + u.encode("utf-8", "replace") + b"\x03" for u in urls]
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raw], np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(inside >= ORDER)
    context = np.zeros(len(at), np.uint64)
    pairs, contexts = np.empty((ORDER + 1, len(at)), np.int64), np.empty((ORDER + 1, len(at)), np.int64)
    for order in range(ORDER + 1):
        if order:
            context = (context + text[at - order] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            context ^= context >> np.uint64(31)
        mixed = (context + np.uint64(order)) * np.uint64(0xBF58476D1CE4E5B9)
        contexts[order] = (mixed >> np.uint64(40)) % np.uint64(SLOTS)
        both = (mixed ^ (text[at] + np.uint64(1))) * np.uint64(0x94D049BB133111EB)
        pairs[order] = (both >> np.uint64(40)) % np.uint64(SLOTS)
    return pairs, contexts, owner[at]


def fit(accepted: list[str], rejected: list[str]) -> Model:
    """Counts of both models from three quarters of the URLs; the rest sets the threshold.

    The threshold is the smallest at which at most MOST_LOST of the accepted calibration URLs are
    blocked, and no less than the middle between both classes' means.  Without URLs of a verdict, nothing is blocked.
    """
    tables = [np.zeros((2, ORDER + 1, SLOTS), np.float32) for _ in range(3)]
    for c, urls in enumerate((accepted, rejected)):
        pairs, contexts, _ = _slots(urls[len(urls) // 4 :])
        for order in range(ORDER + 1):
            tables[0][c, order] = np.bincount(pairs[order], minlength=SLOTS)
            tables[1][c, order] = np.bincount(contexts[order], minlength=SLOTS)
            _, first = np.unique(pairs[order], return_index=True)
            tables[2][c, order] = np.bincount(contexts[order][first], minlength=SLOTS)
    model = Model(*tables, np.inf)
    if not accepted or not rejected:
        return model
    good, bad = (ratio(model, urls[: max(1, len(urls) // 4)]) for urls in (accepted, rejected))
    return model._replace(threshold=float(max(np.quantile(good, 1 - MOST_LOST), min(0.0, (good.mean() + bad.mean()) / 2))))


def ratio(model: Model, urls: list[str]) -> np.ndarray:
    """Log-likelihood under the rejected model less that under the accepted one, per character.

    Orders are blended from short to long contexts (Witten-Bell): a context seen n times with t kinds
    of next character gives the next shorter one the weight t / (n + t).
    """
    if not urls:
        return np.zeros(0)
    pairs, contexts, owner = _slots(urls)
    logs = []
    for c in range(2):
        p = np.full(pairs.shape[1], 1 / 256)
        for order in range(ORDER + 1):
            n, t = model.contexts[c, order][contexts[order]], model.kinds[c, order][contexts[order]]
            seen = n > 0
            blended = (np.minimum(model.pairs[c, order][pairs[order]], n) + t * p) / np.maximum(n + t, 1)
            p = np.where(seen, blended, p)
        logs.append(np.log(np.maximum(p, 1e-12)))
    sizes = np.bincount(owner, minlength=len(urls))
    return np.bincount(owner, weights=logs[1] - logs[0], minlength=len(urls)) / sizes


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each (verdict, order, context slot, pair slot), packed into one number, comes in URLs (u, bad)."""
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            part = batch.slice(low, 2000)
            pairs, contexts, owner = _slots(part.column("u").to_pylist())
            kind = part.column("bad").to_numpy().astype(np.int64)[owner] * 8
            found, n = np.unique(np.concatenate([(kind + k) << 36 | contexts[k] << 18 | pairs[k] for k in range(ORDER + 1)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["key", "n"])


def counts(urls: DataFrame) -> Model:
    """The tables of both models from all of `urls` (u, bad), counted by Spark; the driver gets a row per slot in use (SLOTS an order at most)."""
    each = urls.select("u", "bad").mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    kind = F.expr("(key >> 36) << 18")
    pair = F.struct(F.lit(0).alias("of"), (kind + F.expr("key & 262143")).alias("slot"), "n", F.lit(0).alias("kinds"))
    context = F.struct(F.lit(1).alias("of"), (kind + F.expr("(key >> 18) & 262143")).alias("slot"), "n", F.lit(1).alias("kinds"))
    rows = each.select(F.explode(F.array(pair, context)).alias("p")).groupBy("p.of", "p.slot").agg(F.sum("p.n").alias("n"), F.sum("p.kinds").alias("kinds")).toArrow()
    of, slot, n, kinds = (rows.column(c).to_numpy() for c in ("of", "slot", "n", "kinds"))
    tables = [np.zeros((2, ORDER + 1, SLOTS), np.float32) for _ in range(3)]
    for table_of, values, which in zip(tables, (n, n, kinds), (0, 1, 1), strict=True):
        at = slot[of == which]
        table_of[at >> 21, (at >> 18) & 7, at & (SLOTS - 1)] = values[of == which]
    return Model(*tables, np.inf)


def _rated(shared, text) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches plus the ratio of the URLs that `text` makes of them, under a broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [ratio(shared.value, text(batch.slice(low, 2000))) for low in range(0, batch.num_rows, 2000)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names, "ratio"])

    return run


def train(judged: DataFrame) -> Model:
    """A model of all distinct URLs that rules decide: three quarters are counted, the quarter that a hash picks sets the threshold.

    As `fit`, whatever their number.  A verdict of which the hash picks no URL is calibrated on all it has.
    """
    urls = judged.where("rule_verdict is not null").select(F.concat("host", "path").alias("u"), (F.col("rule_verdict") == "block").cast("int").alias("bad")).distinct()
    urls = urls.withColumn("held", F.pmod(F.xxhash64("u"), F.lit(4)) == 0)
    model = counts(urls.where("not held"))
    held = {r["bad"]: r["held"] for r in urls.groupBy("bad").agg(F.sum(F.col("held").cast("long")).alias("held")).collect()}
    if len(held) < 2:
        return model
    shared = judged.sparkSession.sparkContext.broadcast(model)
    picked = urls.where(F.col("held") | F.col("bad").isin([c for c, n in held.items() if not n])).select("u", "bad")
    rated = picked.mapInArrow(_rated(shared, lambda part: part.column("u").to_pylist()), "u string, bad int, ratio double")
    found = {r["bad"]: r for r in rated.groupBy("bad").agg(F.avg("ratio").alias("mean"), F.percentile_approx("ratio", 1 - MOST_LOST, 1_000_000).alias("high")).collect()}
    shared.destroy(blocking=True)  # its copies on disk go before the judging model's come
    return model._replace(threshold=float(max(found[0]["high"], min(0.0, (found[0]["mean"] + found[1]["mean"]) / 2))))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, ratio, verdict), one row per row of `pages` (page_id, url).

    A URL without host and path (null or malformed) has ratio 0 of an empty text against the
    threshold like any other.  Training reads the urls three times more; judging shuffles nothing.
    """
    judged = by_rules(pages, rules)
    model = train(judged)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # fixed in size by ORDER and SLOTS

    run = _rated(shared, lambda part: [h + p for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist(), strict=True)])
    kept = judged.select("page_id", "host", "path", "rule", "rule_verdict")
    found = kept.mapInArrow(run, StructType([*kept.schema, StructField("ratio", DoubleType())]))
    own = F.when(F.col("ratio") > model.threshold, F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumn("verdict", F.coalesce("rule_verdict", own)).drop("rule_verdict")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of the url of every row of `pages`; see `judge` for nulls and malformed urls."""
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "ratio")
