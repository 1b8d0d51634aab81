"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A text is cut into overlapping windows of several words.  Each window is compressed twice: with the
ordinary dictionary, and with the toxic one in front of the same ordinary one, so that ordinary words
cost the same bytes on both sides and the difference is what toxic text explains better.  A
document's score comes from the bytes that its windows save, through thresholds and a logistic
calibration on labelled documents that the dictionaries have not seen.

Toxic text is mostly ordinary words, so its dictionary is trained in rounds: first on all windows of
toxic documents, then on those that the dictionary of other toxic documents compresses better than
nearly all ordinary windows.  Documents that it does not tell apart yet give the next stage's windows
(other languages, other ways).  Ordinary windows that a toxic dictionary compresses better by mistake
go into the ordinary dictionary.  No window meets a dictionary that its own document helped to train.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clusterloom.llm import wordbytes
from clusterloom.llm.labelled import fold, labelled_rows
from clusterloom.llm.tables import fresh, table

FOLDS, HELD = 3, 1
THRESHOLD = 0.7
#: labelled rows that the fit takes of either class
PER_CLASS = 1500
#: words in a window and from one window to the next, for training and for scoring
TRAINED, SCORED = (6, 1), (12, 6)
#: parts of the labelled rows; each is calibrated with dictionaries made from the others
PARTS = 5
#: stages of the toxic dictionary, and rounds of training in each
STAGES, ROUNDS = 4, 2
#: bytes of the first ordinary dictionary, of what a stage adds to it, and of a stage's toxic dictionary
ORDINARY_BYTES, MISTAKEN_BYTES, TOXIC_BYTES = 512 << 10, 8 << 10, 4 << 10
#: share of ordinary windows that a window's saving must exceed to be trained on, and of ordinary rows that a row must to be told apart
WINDOW_QUANTILE, ROW_QUANTILE = 0.99, 0.995
#: dictionaries are made of segments of so many bytes, valued by their runs of so many
SEGMENT, RUN = 32, 8
LEVEL = 9
#: bytes saved from which on a window is a hit (in scoring) or a mistake (in training)
HIT, MISTAKE = 3, 2


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    key: str


class Windows(NamedTuple):
    """Window k is data[start[k]:stop[k]], a blank at both ends, of text owner[k]."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    owner: np.ndarray

    def take(self, which: np.ndarray) -> Windows:
        return Windows(self.data, self.start[which], self.stop[which], self.owner[which])


def windows(texts: pa.Array, size: int, step: int) -> Windows:
    """All windows of whole texts, in lower case; a text of fewer words is one window, one without words has none.

    The last window of a text ends with its last word, so every word lies in a window.
    """
    found = wordbytes.words(pc.utf8_lower(pc.fill_null(texts, "")))
    counts = np.diff(found.first)
    per = np.where(counts > 0, np.maximum(-(-(counts - size) // step), 0) + 1, 0)
    owner = np.repeat(np.arange(len(texts)), per)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    first = found.first[:-1][owner] + np.minimum(k * step, np.maximum(counts[owner] - size, 0))
    last = np.minimum(first + size, found.first[1:][owner]) - 1
    return Windows(np.concatenate([np.array([0x20], np.uint8), found.text]), found.start[first], found.end[last] + 2, owner)


class Sizes:
    """Compressed sizes of windows under one dictionary."""

    def __init__(self, content: bytes, threads: int = 0):
        held = zstandard.ZstdCompressionDict(content.rjust(64), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.threads = threads

    def of(self, given: Windows, at_once: int = 1 << 17) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for low in range(0, len(given.start), at_once):
            start, stop = given.start[low : low + at_once], given.stop[low : low + at_once]
            base = int(start.min())
            spans = np.stack([start - base, stop - start], axis=1).astype(np.uint64)
            held = zstandard.BufferWithSegments(given.data[base : int(stop.max())].tobytes(), spans.tobytes())
            made = self.compressor.multi_compress_to_buffer(held, threads=self.threads)
            out.append(np.fromiter((len(made[k]) for k in range(len(made))), np.int64, len(made)))
        return np.concatenate(out)


def features(saved: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Per text: one, the bytes saved per window and per root of windows, and the number and share of hits."""
    n = np.maximum(np.bincount(owner, minlength=rows), 1)
    total, hits = np.bincount(owner, weights=saved, minlength=rows), np.bincount(owner[saved >= HIT], minlength=rows)
    return np.stack([np.ones(rows), 10 * np.clip(total / n, -0.2, 0.6), np.clip(total / np.sqrt(n), -1, 4), np.log1p(hits), 5 * np.sqrt(hits / n)], axis=1)


def score(texts: pa.Array, model: Model, sides: tuple[Sizes, Sizes] | None = None) -> np.ndarray:
    """Probability of label 1 for each text; null and empty texts have no windows and get the intercept's."""
    ordinary, toxic = sides or _sides(model)
    given = windows(texts, *SCORED)
    odds = features(ordinary.of(given) - toxic.of(given), given.owner, len(texts)) @ model.weights
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _sides(model: Model) -> tuple[Sizes, Sizes]:
    return Sizes(model.ordinary), Sizes(model.toxic + model.ordinary)


def dictionary(given: Windows, which: np.ndarray, size: int) -> bytes:
    """What zstandard trains from these windows, up to a third of their bytes; empty where they are too few for it.

    It goes through the samples part by part and ends early at a long run of parts that it has covered, so
    they come in a fixed random order and not text by text.
    """
    which = np.random.default_rng(3).permutation(which)
    samples = [given.data[a:z].tobytes() for a, z in zip(given.start[which].tolist(), given.stop[which].tolist(), strict=True)]
    try:
        return zstandard.train_dictionary(max(256, min(size, sum(map(len, samples)) // 3)), samples, k=SEGMENT, d=RUN, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # its way to refuse few or short samples
        return b""


def distinct_rows(rows: list[set[bytes]], bands: int = 8, per_band: int = 3) -> list[int]:
    """Places of the rows with words that are no near copy of an earlier one.

    Copies of one document would make all its words look telling.  Rows count as copies if the smallest
    hashes of their words agree in one of `bands` groups of `per_band` (likely from a similarity of 0.8 on).
    """
    rng = np.random.default_rng(5)
    a = rng.integers(1, 1 << 62, (bands * per_band, 1), dtype=np.uint64) | np.uint64(1)
    seen: set[tuple] = set()
    out = []
    for k, words in enumerate(rows):
        if not words:
            continue
        base = np.fromiter(map(zlib.crc32, words), np.uint64)
        least = ((base[None, :] + np.uint64(1)) * a >> np.uint64(20)).min(axis=1).reshape(bands, per_band)
        marks = {(b, *x) for b, x in enumerate(least.tolist())}
        if marks.isdisjoint(seen):
            out.append(k)
        seen |= marks
    return out


def calibrate(x: np.ndarray, y: np.ndarray, prior: float, strength: float = 0.03) -> np.ndarray:
    """Logistic weights by Newton's method, with a ridge on all but the intercept.

    `prior` is the rate of label 1 among all labels; the intercept is moved there from that of the rows.
    """
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], strength)
    ridge[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    w[0] += math.log(prior / (1 - prior)) - math.log(rate / (1 - rate))
    return w


class _Fold:
    """The dictionaries made without part k (k None: from all parts)."""

    def __init__(self, k: int | None, given: Windows, part: np.ndarray, plain: np.ndarray):
        self.given, self.k = given, k
        self.others = np.ones(len(part), bool) if k is None else part != k
        self.mine = np.flatnonzero(~self.others)
        self.toxic, self.ordinary = b"", dictionary(given, np.flatnonzero(plain & self.others), ORDINARY_BYTES)

    def plain_sizes(self, sizes: np.ndarray) -> None:
        sizes[self.mine] = Sizes(self.ordinary, -1).of(self.given.take(self.mine))

    def saved(self, sizes: np.ndarray, toxic: bytes, which: np.ndarray, out: np.ndarray) -> None:
        mine = self.mine[which[self.mine]]
        out[mine] = sizes[mine] - Sizes(toxic + self.ordinary, -1).of(self.given.take(mine))


def fit(texts: list[str], labels: np.ndarray, prior: float) -> Model:
    """Dictionaries from all rows, and a calibration in which no row meets dictionaries it helped to make.

    One class only, or no rows: the prior decides.
    """
    found = wordbytes.words(pc.utf8_lower(pa.array(texts, pa.string())))
    spelt = wordbytes.as_array(found)
    kept = distinct_rows([set(spelt.slice(a, z - a).to_pylist()) for a, z in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)])
    chosen, y = pa.array([texts[k] for k in kept], pa.string()), labels[kept].astype(int)
    part = np.zeros(len(y), int)
    for c in (0, 1):
        part[y == c] = np.arange((y == c).sum()) % PARTS
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", calibrate(features(np.zeros(0), np.zeros(0, int), len(y)), y.astype(float), prior), "")
    given = windows(chosen, *TRAINED)
    of_part, ordinary = part[given.owner], y[given.owner] == 0
    apart = np.arange(len(given.start)) % (TRAINED[0] // TRAINED[1]) == 0  # windows that share no word
    folds = [_Fold(k, given, of_part, ordinary & apart) for k in [*range(PARTS), None]]
    last = folds[-1]
    sizes, saved = np.zeros(len(apart)), np.zeros(len(apart))
    per_row = np.maximum(np.bincount(given.owner, minlength=len(y)), 1)
    open_rows = y == 1
    for _ in range(STAGES):
        for f in folds[:-1]:
            f.plain_sizes(sizes)
        wanted = open_rows[given.owner]
        picked = wanted
        for _ in range(ROUNDS):
            made = [dictionary(given, np.flatnonzero(picked & f.others), TOXIC_BYTES) for f in folds[:-1]]
            for f, toxic in zip(folds[:-1], made, strict=True):
                f.saved(sizes, toxic, wanted | ordinary & apart, saved)
            picked = wanted & (saved > np.quantile(saved[ordinary & apart], WINDOW_QUANTILE))
        for f, toxic in zip(folds, [*made, dictionary(given, np.flatnonzero(picked), TOXIC_BYTES)], strict=True):
            f.toxic = toxic + f.toxic
            f.saved(sizes, f.toxic, np.ones(len(apart), bool), saved)
        means = np.bincount(given.owner, weights=saved, minlength=len(y)) / per_row
        open_rows = (y == 1) & (means <= np.quantile(means[y == 0], ROW_QUANTILE))
        mistaken = ordinary & apart & (saved >= MISTAKE)
        for f in folds:
            f.ordinary = dictionary(given, np.flatnonzero(mistaken & f.others), MISTAKEN_BYTES) + f.ordinary
    given = windows(chosen, *SCORED)
    saved = np.zeros(len(given.start))
    for f in folds[:-1]:
        mine = np.flatnonzero(part[given.owner] == f.k)
        part_of = given.take(mine)
        saved[mine] = Sizes(f.ordinary, -1).of(part_of) - Sizes(f.toxic + f.ordinary, -1).of(part_of)
    weights = calibrate(features(saved, given.owner, len(y)), y.astype(float), prior)
    return Model(last.toxic, last.ordinary, weights, hashlib.md5(last.toxic + b"|" + last.ordinary + weights.tobytes()).hexdigest())


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = PER_CLASS, folds: int = FOLDS, held: int = HELD) -> Model:
    """A model of `labels`.`target`, fitted on the driver to the whole texts of a sample of 2 * per_class labelled rows."""
    rows = labelled_rows(docs, labels, target, folds, held, per_class).toPandas().sort_values(["label", "doc_id"], kind="stable")
    usable = labels.where((fold(F.col("doc_id"), folds) != held) & F.col(target).isin(0, 1))
    prior = usable.agg(F.avg(F.col(target).cast("double"))).first()[0]
    return fit(rows["text"].tolist(), rows["label"].to_numpy(), 0.0 if prior is None else float(prior))


_known: dict[str, tuple[Sizes, Sizes]] = {}


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """`keep` columns and, last, the score of every row of `docs`; texts are read where they lie and nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size
    text, own = fresh(list(keep), "scored_text", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model.key not in _known:
            _known.clear()
            _known[model.key] = _sides(model)
        for batch in wordbytes.slices(batches, text):
            rest = [c for c in batch.schema.names if c != text]
            scores = pa.array(score(batch.column(text), model, _known[model.key]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), scores], [*rest, own])

    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    return docs.select(*kept.columns, F.col("text").cast("string").alias(text)).mapInArrow(run, StructType([*kept.schema, StructField(own, DoubleType())]))


def op6_toxic_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every row of `documents`, whole texts: see `scored` for nulls and empty texts, `fit` for missing labels."""
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    return found.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        F.col("score").alias("score"),
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
