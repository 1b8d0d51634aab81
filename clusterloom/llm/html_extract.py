"""HTML extraction: a bidirectional LSTM in numpy labels every block of a page as article or not.

A block is read as the sum of learned vectors of the tags (with class and id words) above it, the mean
of learned vectors of its hashed words, and a few numbers (its size, place, links, and the share of
the page's text that stands under the same tags).  The LSTM reads a page's blocks in both
directions, so every decision sees the whole page.  It is trained here, on made-up pages
(``page_samples``) with a fixed seed: no labels of the input are used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from clusterloom.llm import wordbytes
from clusterloom.llm.html_blocks import Block, blocks
from clusterloom.llm.page_samples import MARK, sample
from clusterloom.llm.tables import fresh, table

PATH_SLOTS, WORD_SLOTS = 4096, 2048
PATH_SIZE, WORD_SIZE, NUMBERS = 32, 12, 9
HIDDEN = 24
TRAIN_PAGES, EPOCHS, BATCH, RATE = 2400, 6, 40, 0.015
#: what the mean log-odds of the blocks under the same tags, and of those in the same element, add to a block's own, and their bound
ALIKE_WEIGHT, INSIDE_WEIGHT, ALIKE_MOST = 2.0, 2.0, 3.0


class Model(NamedTuple):
    path: np.ndarray
    word: np.ndarray
    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    wo: np.ndarray
    bo: np.ndarray


@lru_cache(1 << 16)
def _path_slots(path: tuple[str, ...]) -> np.ndarray:
    """Slots of the marks above a block, each once, and of the innermost tag."""
    tags = [m for m in path if m[0] != "."]
    marks = [*dict.fromkeys(path), f"leaf:{tags[-1] if tags else ''}"]
    return np.array([zlib.crc32(m.encode()) % PATH_SLOTS for m in marks], np.int64)


@lru_cache(1 << 17)
def _word_slot(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "replace")) % WORD_SLOTS


class _Read(NamedTuple):
    """Blocks of several pages, one after another: ragged path and word slots, and numbers."""

    path: np.ndarray
    path_n: np.ndarray
    word: np.ndarray
    word_n: np.ndarray
    numbers: np.ndarray


def _features(pages: list[list[Block]]) -> _Read:
    path, word, numbers = [], [], []
    word_n = []
    for page in pages:
        alike: dict[tuple[str, ...], int] = {}
        for block in page:
            alike[block.path] = alike.get(block.path, 0) + len(block.text)
        whole = sum(alike.values())
        for k, block in enumerate(page):
            path.append(_path_slots(block.path))
            words = block.text.split(" ")
            word += map(_word_slot, words)
            word_n.append(len(words))
            chars = len(block.text)
            numbers.append(
                (np.log1p(chars) / 8, np.log1p(len(words)) / 6, min(1.0, block.link_chars / chars), block.text[-1] in ".!?", k / len(page), 1 / (1 + k), 1 / (len(page) - k), len(words) < 4, alike[block.path] / whole)
            )
    path_n = np.fromiter(map(len, path), np.int64, len(path))
    flat = np.concatenate(path) if path else np.zeros(0, np.int64)
    return _Read(flat, path_n, np.array(word, np.int64), np.array(word_n, np.int64), np.array(numbers, np.float32).reshape(-1, NUMBERS))


def _vectors(model: Model, read: _Read) -> np.ndarray:
    """One row per block; every block has a path mark and a word."""
    path = np.add.reduceat(model.path[read.path], np.cumsum(read.path_n) - read.path_n, axis=0) * 0.5
    word = np.empty((len(read.word_n), WORD_SIZE), np.float32)
    stops, step, low = np.cumsum(read.word_n), 1 << 18, 0
    while low < len(stops):  # long texts a part at a time
        base = stops[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(stops, base + step, "right")))
        part = read.word[base : stops[high - 1]]
        word[low:high] = np.add.reduceat(model.word[part], np.concatenate([[0], stops[low : high - 1] - base]), axis=0)
        low = high
    word /= read.word_n[:, None]
    return np.concatenate([path, word, read.numbers], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(model: Model, d: int, x: np.ndarray, there: np.ndarray, tape: list | None = None) -> np.ndarray:
    """Hidden states (time, page, HIDDEN) of direction d over padded x (time, page, size)."""
    times, pages, _ = x.shape
    given = x @ model.wx[d] + model.b[d]
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out = np.zeros((times, pages, HIDDEN), np.float32)
    for t in range(times) if d == 0 else range(times - 1, -1, -1):
        z = given[t] + h @ model.wh[d]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = there[t][:, None]
        c_new = (f * c + i * g) * m
        squashed = np.tanh(c_new)
        h_new = o * squashed * m
        if tape is not None:
            tape.append((t, h, c, i, f, o, g, squashed, m))
        h, c = h_new, c_new
        out[t] = h
    return out


def _back(model: Model, d: int, tape: list, dout: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of wx, wh, b and x for direction d, from those of its states."""
    dz_all = np.zeros((*dout.shape[:2], 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(model.wh[d])
    dh, dc = np.zeros(dout.shape[1:], np.float32), np.zeros(dout.shape[1:], np.float32)
    for t, h, c, i, f, o, g, squashed, m in reversed(tape):
        dh = (dout[t] + dh) * m
        dc = dc + dh * o * (1 - squashed**2)
        dc = dc * m
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        dz_all[t] = dz
        dwh += h.T @ dz
        dh = dz @ model.wh[d].T
        dc = dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0), dz_all @ model.wx[d].T


def _padded(vectors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors by (time, page), where there is one, and each vector's time and page."""
    page = np.repeat(np.arange(len(sizes)), sizes)
    time = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = np.zeros((int(sizes.max()), len(sizes), vectors.shape[1]), np.float32)
    x[time, page] = vectors
    there = np.zeros(x.shape[:2], np.float32)
    there[time, page] = 1
    return x, there, time, page


def probabilities(model: Model, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page the probability of each block to be article.

    Pages are read together with pages of like length, so padding stays small.
    """
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        wide = max(1, min(128, 20_000 // len(pages[order[min(at + 127, len(order) - 1)]])))
        part = order[at : at + wide]
        at += wide
        sizes = np.array([len(pages[k]) for k in part])
        x, there, time, page = _padded(_vectors(model, _features([pages[k] for k in part])), sizes)
        states = np.concatenate([_run(model, d, x, there) for d in range(2)], axis=2)
        p = _sigmoid(states[time, page] @ model.wo + model.bo)
        for k, values in zip(part, np.split(p, np.cumsum(sizes)[:-1]), strict=True):
            out[k] = values
    return out


@lru_cache(1)
def train(seed: int = 11, n_pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Model:
    """The labeller, by Adam on the log loss over made-up pages; the same on every machine and run up to rounding."""
    rng = np.random.default_rng(seed)
    pages, labels = [], []
    for k in range(n_pages):
        found = blocks(sample(seed * 1_000_003 + k))
        if found and len(found) <= 150:
            pages.append([b._replace(text=b.text.replace(MARK, "").strip() or "x") for b in found])
            labels.append(np.array([MARK in b.text for b in found], np.float32))
    size = PATH_SIZE + WORD_SIZE + NUMBERS
    draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
    bias = np.zeros((2, 4 * HIDDEN), np.float32)
    bias[:, HIDDEN : 2 * HIDDEN] = 1
    model = Model(draw(PATH_SLOTS, PATH_SIZE) * 16, draw(WORD_SLOTS, WORD_SIZE) * 4, draw(2, size, 4 * HIDDEN), draw(2, HIDDEN, 4 * HIDDEN), bias, draw(2 * HIDDEN, 1)[:, 0], np.zeros(1, np.float32))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in model]
    steps, done = epochs * -(-len(pages) // BATCH), 0
    for _ in range(epochs):
        mixed = rng.permutation(len(pages))
        for low in range(0, len(mixed), BATCH):
            part = mixed[low : low + BATCH]
            done += 1
            read = _features([pages[k] for k in part])
            y = np.concatenate([labels[k] for k in part])
            sizes = np.array([len(pages[k]) for k in part])
            vectors = _vectors(model, read)
            x, there, time, page = _padded(vectors * (rng.random(vectors.shape) > 0.1), sizes)
            tapes: list[list] = [[], []]
            states = np.concatenate([_run(model, d, x, there, tapes[d]) for d in range(2)], axis=2)
            seen = states[time, page]
            wrong = (_sigmoid(seen @ model.wo + model.bo) - y) / len(y)
            dstates = np.zeros_like(states)
            dstates[time, page] = wrong[:, None] * model.wo
            sides = [_back(model, d, tapes[d], dstates[:, :, d * HIDDEN : (d + 1) * HIDDEN], x) for d in range(2)]
            dx = (sides[0][3] + sides[1][3])[time, page]
            dpath, dword = np.zeros_like(model.path), np.zeros_like(model.word)
            np.add.at(dpath, read.path, np.repeat(dx[:, :PATH_SIZE] * 0.5, read.path_n, axis=0))
            np.add.at(dword, read.word, np.repeat(dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / read.word_n[:, None], read.word_n, axis=0))
            gradients = (dpath, dword, *(np.stack([s[k] for s in sides]) for k in range(3)), seen.T @ wrong, np.array([wrong.sum()]))
            rate = RATE * (1 - done / (steps + 1))
            for w, g, (m, v) in zip(model, gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + 1e-7)
    return model


def _element(path: tuple[str, ...]) -> tuple[str, ...]:
    """The tags above the innermost one."""
    return path[: max((k for k, m in enumerate(path) if m[0] != "."), default=0)]


def labels(page: list[Block], p: np.ndarray) -> np.ndarray:
    """Which blocks are article, from their probabilities.

    Blocks under the same tags are mostly of one kind, and so are neighbours in one element whatever their
    own tag.  A block's log-odds are joined by the means of both, weighted by the root of their lengths:
    a short line within an article goes with its neighbours.
    """
    odds = np.clip(np.log(p + 1e-6) - np.log(1 - p + 1e-6), -8, 8)
    weight = np.sqrt([len(b.text) for b in page])
    total = odds.copy()
    for share, key in ((ALIKE_WEIGHT, [b.path for b in page]), (INSIDE_WEIGHT, [_element(b.path) for b in page])):
        names = {x: k for k, x in enumerate(dict.fromkeys(key))}
        which = np.array([names[x] for x in key])
        means = np.bincount(which, weights=weight * odds) / np.bincount(which, weights=weight)
        total += share * np.clip(means, -ALIKE_MOST, ALIKE_MOST)[which]
    return total >= 0


def article(model: Model, pages: list[list[Block]]) -> list[str]:
    found = probabilities(model, pages)
    return ["\n\n".join(b.text for b, x in zip(page, labels(page, p), strict=True) if x) if page else "" for page, p in zip(pages, found, strict=True)]


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` without the column `html`, plus text and n_chars (in place of columns so named), one row per row.

    A null or empty page, and one without an article, has the empty text.  Pages are read where they
    lie, whole, a few megabytes at a time.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train())  # fixed in size by its slots
    rest = [c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    (name,) = fresh(rest, "read_html")
    kept = pages.select(*(F.col(f"`{c}`") for c in rest))
    given = pages.select(*kept.columns, F.col(f"`{html}`").cast("string").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordbytes.slices(batches, name, 2 << 20):
            texts = article(shared.value, [blocks(x) for x in batch.column(name).to_pylist()])
            columns = [*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "text", "n_chars"])

    return given.mapInArrow(run, StructType([*kept.schema, StructField("text", StringType()), StructField("n_chars", LongType())]))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page, from the whole html; see `extract`."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
