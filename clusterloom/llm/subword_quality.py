"""Quality classifier: averaged vectors of hashed words and character n-grams, softmax, numpy SGD.

A text is its words between blanks, case and punctuation kept.  Each word gives hashed features: the
word, its character (byte) n-grams with word boundaries, and, if it repeats the word before it, the
word bigram "same again" without the word itself.  The text's vector is the mean of its features'
learned vectors; two outputs go through softmax.

Scoring is linear up to the softmax, so the learned vectors fold into one number per hash bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clusterloom.llm import wordbytes
from clusterloom.llm.labelled import fold, labelled_rows
from clusterloom.llm.tables import fresh, table

FOLDS, HELD = 4, 2
THRESHOLD = 0.7
#: labelled rows that the fit takes of either class
PER_CLASS = 2000
BUCKETS = 1 << 17
DIMENSIONS = 16
NGRAMS = (2, 3, 4)
EPOCHS = 5
RATE = 0.5
_SAME = BUCKETS - 1
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Model(NamedTuple):
    """`weight`: each bucket's share in the difference of the two outputs; `bias`: that of an empty text."""

    weight: np.ndarray
    bias: float


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(BUCKETS - 1)).astype(np.int64)


def features(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word and n-gram features of each word, and how many each word has.

    All n-grams are hashed at once: with H the running sum of byte * P^position, the hash of a span is
    its difference of H, divided by P^start (P is odd, so it has an inverse modulo 2^64).
    """
    n = len(vocabulary)
    offsets = np.frombuffer(vocabulary.buffers()[1], np.int32, n + 1, vocabulary.offset * 4).astype(np.int64)
    raw = vocabulary.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    sizes = np.diff(offsets) + 2
    stops = np.cumsum(sizes)
    starts = stops - sizes
    inner = np.ones(int(stops[-1]) if n else 0, bool)
    inner[starts] = inner[stops - 1] = False
    text = np.full(len(inner), 1, np.uint64)  # word starts
    text[inner] = data.astype(np.uint64) + np.uint64(3)
    text[stops - 1] = 2
    up = np.cumprod(np.full(len(text), _P))
    down = np.cumprod(np.full(len(text), _INVERSE))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text * up)])

    def hashed(at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return _bucket((total[to] - total[at]) * down[at])

    owner = np.repeat(np.arange(n), sizes)
    owners, found = [np.arange(n)], [hashed(starts, stops)]
    for size in NGRAMS:
        at = np.arange(len(text))
        at = at[at + size < stops[owner]] if len(text) else at  # the whole word is there already
        owners.append(owner[at])
        found.append(hashed(at, at + size))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.bincount(owner, minlength=n)


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as places among them, and where each text's words start."""
    found = wordbytes.words(texts)
    coded = wordbytes.as_array(found).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.first


def _repeats(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    same[first[:-1][first[:-1] < len(codes)]] = False
    return same


def score(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 for each text; null counts as empty, and empty texts give the bias alone."""
    vocabulary, codes, first = _coded(texts)
    buckets, counts = features(vocabulary)
    per_word = wordbytes.sums(model.weight[buckets], np.concatenate([[0], np.cumsum(counts)]))
    same = _repeats(codes, first)
    value = wordbytes.sums(per_word[codes] + same * model.weight[_SAME], first)
    size = wordbytes.sums(counts[codes] + same, first)
    return 1 / (1 + np.exp(-np.clip(value / np.maximum(size, 1) + model.bias, -30, 30)))


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the features of a whole text fall into, and the share of each."""
    vocabulary, codes, first = _coded(pa.array([text]))
    buckets, counts = features(vocabulary)
    uses = np.bincount(codes, minlength=len(vocabulary))
    ids, place = np.unique(buckets, return_inverse=True)
    share = np.bincount(place, weights=np.repeat(uses, counts), minlength=len(ids))
    ids, share = np.append(ids, _SAME), np.append(share, _repeats(codes, first).sum())
    used = share > 0
    return ids[used].astype(np.int32), (share[used] / max(1.0, share.sum())).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    return fit_shares([shares(text) for text in texts], labels, seed)


def fit_shares(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Learn bucket vectors and the output layer by stochastic gradient descent on the softmax loss.

    Rows are shuffled each epoch with a fixed seed, and the step falls linearly to zero.  Classes are
    not reweighted, so that scores stay probabilities.  One class only: the bias decides.
    """
    if not rows:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, share = rows[k]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIMENSIONS, np.float32)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[k])] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            if len(ids):
                # The mean spreads the step thinly over many features; scale it back up.
                vectors[ids] -= (rate * 20) * np.outer(share, back)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = PER_CLASS, folds: int = FOLDS, held: int = HELD) -> Model:
    """A model of `labels`.`target`, fitted on the driver to a sample of 2 * per_class labelled rows."""
    rows = labelled_rows(docs, labels, target, folds, held, per_class)
    sample = rows.mapInPandas(_shares_of, "doc_id long, label int, ids binary, share binary").toPandas()
    for column in ("ids", "share"):
        sample[column] = [bytes(x) for x in sample[column]]
    sample = sample.sort_values(["doc_id", "ids", "share"], kind="stable")
    pairs = zip(sample["ids"], sample["share"], strict=True)
    return fit_shares([(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for i, x in pairs], sample["label"].to_numpy())


def _shares_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shares of whole texts, so that the driver gets BUCKETS numbers a row at most, however long its text."""
    for frame in frames:
        found = [shares(text) for text in frame["text"]]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "ids": [i.tobytes() for i, _ in found], "share": [x.tobytes() for _, x in found]})


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """`keep` columns and, last, the score of every row of `docs`; texts come back only if kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    text, own = fresh(list(keep), "scored_text", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordbytes.slices(batches, text):
            rest = [c for c in batch.schema.names if c != text]
            scores = pa.array(score(batch.column(text), shared.value))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), scores], [*rest, own])

    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    return docs.select(*kept.columns, F.col("text").cast("string").alias(text)).mapInArrow(run, StructType([*kept.schema, StructField(own, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, with their columns."""
    found = scored(docs, train(docs, labels), *docs.columns)
    return found.where(F.col(found.columns[-1]) >= threshold).select(*docs.columns)


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every row of `documents`, whole texts: see `score` for nulls and empty texts, `fit_shares` for missing labels."""
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    return found.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        F.col("score").alias("score"),
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
