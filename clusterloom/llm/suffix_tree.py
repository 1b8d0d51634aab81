"""Probabilistic suffix tree over words: how likely each text is after the words of the training texts.

A context is the last one, two, ... words of a text.  It becomes a state of the tree if what follows it
diverges enough from what follows its own shorter suffix, which is a state already; the root is the
empty context.  A token's probability comes from the longest state that ends before it.

The divergence test weighs evidence against description: a word is spelled out in a context if
c * ln((c / n) / p) exceeds ln(N), with c its count there, n the context's, p its probability in the
suffix and N all training tokens; the context is retained if the spelled-out words and all others as
one class gain more than ln(N) for each word spelled out.  So whatever was seen once never counts, and
words whose counts rule out such a gain are not asked about.  In tests -ln(p) is rounded to a tenth.  A
context of several words also occurs LEAST times, and its counts let its last word be spelled out behind its
first ones.  Distributions are smoothed by absolute discounting: a spelled-out word has (c - d) / n, and the mass that
is left is spread as in the suffix, for all words.  The root is additive.  Each of them sums to one.

Texts are cut into chunks of bounded size that are kept as word codes.  For every level, a chunk asks
about its distinct (context, next word); the questions of all chunks on one context meet in a bucket,
which counts, tests and answers to each chunk what it asked.  No table of the model is ever
broadcast or read whole: every task sees the states that its own texts touch.  Contexts that are very
frequent (a common word) are spread over buckets by the next word, and only their sums are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm import wordbytes
from clusterloom.llm.labelled import fold
from clusterloom.llm.tables import table
from clusterloom.plans.scratch import Scratch

#: words of the longest contexts, and how often one of two words or more has to occur
DEPTH, LEAST = 2, 4
#: added to every count at the root, taken from every count at a state
ADDED, DISCOUNT = 0.1, 0.5
#: bytes of text in a chunk, about, and questions in a bucket
CHUNK_BYTES, BUCKET_ASKS = 6 << 20, 1 << 21
#: a context that holds more than this share of a bucket's tokens is spread over buckets
HOT_SHARE = 0.25
FOLDS, HELD = 10, 0

_ASKS = "bucket long, chunk long, asks binary"
_ANSWERS = "level int, bucket long, chunk long, counts binary, states binary, ctx long, gain double, mass double, likely double, spelled long, total long"
_ANSWER_NAMES = [x.split()[0] for x in _ANSWERS.split(", ")]
_ANSWER_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in _ANSWERS.split(", "))])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of one length, the bytes of a place in the number together, compressed."""
    parts = [a.tobytes() if a.itemsize == 1 else np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level).compress(b"".join(parts))


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


class Texts(NamedTuple):
    """A chunk: `codes` are places among its distinct words, which are in order of their hashes; document d has the
    tokens first[d] to first[d + 1] - 1.
    """

    codes: np.ndarray
    distinct: int
    first: np.ndarray
    train: np.ndarray


def read_texts(texts: pa.Array, train: np.ndarray) -> tuple[Texts, np.ndarray]:
    """Lower-cased words of each text and, behind them, its end, which is the empty word, and all distinct hashes; null is an empty text."""
    found = wordbytes.words(texts, lower=True)
    coded = wordbytes.as_array(found).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in [*coded.dictionary.to_pylist(), b""]), np.uint64, len(coded.dictionary) + 1)
    words, place = np.unique(hashes, return_inverse=True)
    n_docs, n = len(texts), len(found.start)
    first = found.first + np.arange(n_docs + 1)
    codes = np.full(n + n_docs, place[-1], np.int64)
    codes[np.arange(n) + np.repeat(np.arange(n_docs), np.diff(found.first))] = place[coded.indices.to_numpy(zero_copy_only=False)]
    return Texts(codes, len(words), first, train), words


_CHUNK = "chunk long, docs long, tokens long, ids array<long>, sizes binary, train binary, codes binary, places binary, words binary"
_CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("ids", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("sizes", "train", "codes", "places", "words")])


def _chunks(most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in wordbytes.slices(batches, "text", most_bytes):
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            found, words = read_texts(batch.column("text"), train)
            # Frequent words get small codes, which packs better.
            rank = np.argsort(-np.bincount(found.codes, minlength=len(words)), kind="stable")
            code = np.empty(len(rank), np.uint32)
            code[rank] = np.arange(len(rank))
            packed = pack(np.diff(found.first)), pack(train.astype(np.uint8)), pack(code[found.codes], level=3), pack(rank.astype(np.uint32)), pack(_steps(words))
            row = (number, len(train), len(found.codes), batch.column("doc_id").to_pylist(), *packed)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CHUNK_SCHEMA, strict=True)], schema=_CHUNK_SCHEMA)

    return run


def _restored(row: dict) -> Texts:
    (sizes,), (train,), (codes,), (places,) = unpack(row["sizes"], np.int64), unpack(row["train"], np.uint8), unpack(row["codes"], np.uint32), unpack(row["places"], np.uint32)
    return Texts(places.astype(np.int64)[codes], len(places), np.concatenate([[0], np.cumsum(sizes)]), train.astype(bool))


class Asked(NamedTuple):
    """What a chunk asks at one level: distinct (context, word), in order of buckets; at[t] is token t's question or -1."""

    at: np.ndarray
    ctx: np.ndarray
    word: np.ndarray
    n: np.ndarray
    tenths: np.ndarray
    total: np.ndarray
    bucket: np.ndarray


class Numbers(NamedTuple):
    """What all tasks know: buckets, training tokens and distinct ones."""

    buckets: int
    tokens: int = 0
    distinct: int = 0

    @property
    def hot(self) -> float:
        """Contexts with more occurrences are spread over buckets."""
        return HOT_SHARE * self.tokens / self.buckets

    @property
    def price(self) -> float:
        return float(np.log(max(self.tokens, 2)))


def _top(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the upper bits, so hashes in order are in order of buckets too."""
    bits = buckets.bit_length() - 1
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def bucket_of(own: np.ndarray, ctx: np.ndarray, word: np.ndarray, total: np.ndarray, numbers: Numbers) -> np.ndarray:
    """A context's `own` bucket; words behind one that is very frequent are spread over all."""
    return np.where((total > numbers.hot) & (word > 0), _top(mix(mix(ctx) ^ word), numbers.buckets), own)


def contexts(level: int, before: Asked | None, word_ids: np.ndarray, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Names and own buckets of the contexts of a level: words, or the (context, word) of the level before.

    Word ids hold their word's bucket.  Two words of 32-bit ids are named by both, so contexts that begin
    alike lie together and pack well, unless so many do; other contexts are named by a hash.
    """
    if level == 1:
        return word_ids, (word_ids & np.uint64(numbers.buckets - 1)).astype(np.int64)
    named = mix(before.ctx * np.uint64(0x9E3779B97F4A7C15) + mix(before.word))
    if level > 2:
        return named, _top(named, numbers.buckets)
    short = np.uint64(1 << 32)
    name = np.where((before.ctx < short) & (before.word < short), before.ctx << np.uint64(32) | before.word, named)
    return name, np.where(before.total > numbers.hot, _top(mix(name), numbers.buckets), (before.ctx & np.uint64(numbers.buckets - 1)).astype(np.int64))


def in_tenths(p: np.ndarray) -> np.ndarray:
    """-ln(p) in tenths."""
    return np.minimum(np.round(-10 * np.log(p)), 255).astype(np.uint8)


def _ranks(values: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(values), np.int64)
    ranks[np.argsort(values)] = np.arange(len(values))
    return ranks


def _questions(where: np.ndarray, item: np.ndarray, ctx_of: np.ndarray, own_of: np.ndarray, total_of: np.ndarray, word: np.ndarray, word_ids: np.ndarray, tenths: np.ndarray, learns: np.ndarray, numbers: Numbers) -> Asked:
    """Distinct questions of the tokens `where`: `item` names their contexts (places in ctx_of, own_of, total_of), `word` the next word or -1.

    They are in order of bucket, context and word id.  Each context that is spread is also asked about itself.
    """
    by_id = np.append(_ranks(word_ids) + 1, 0)
    key = _ranks(ctx_of)[item] * np.int64(len(by_id)) + by_id[word]
    order = np.argsort(key)
    new = np.diff(key[order], prepend=-1) != 0
    first = order[new]
    items, words = item[first], word[first]
    ctx, own, total = ctx_of[items], own_of[items], total_of[items]
    ids = np.where(words >= 0, np.append(word_ids, 0)[words], 0).astype(np.uint64)
    hot = total > numbers.hot
    more, place = np.unique(ctx[hot], return_index=True)
    missing = ~np.isin(more, ctx[hot & (ids == 0)])
    more, place = more[missing], np.flatnonzero(hot)[place[missing]]
    ctx, own, total, ids = np.append(ctx, more), np.append(own, own[place]), np.append(total, total[place]), np.append(ids, np.zeros(len(more), np.uint64))
    likely = np.append(np.where(words >= 0, tenths[first], 0), np.zeros(len(more), np.uint8)).astype(np.uint8)
    bucket = bucket_of(own, ctx, ids, total, numbers)
    # The new ones are few; all others are in order of context and word already.
    dealt = np.lexsort((ids, ctx, bucket)) if len(more) else np.argsort(bucket.astype(np.uint16 if numbers.buckets <= 1 << 16 else np.uint32), kind="stable")
    back = np.empty(len(dealt), np.int64)
    back[dealt] = np.arange(len(dealt))
    places = np.full(len(learns), -1, np.int64)
    places[where[order]] = back[np.cumsum(new) - 1]
    n = np.bincount(places[where], weights=learns[where], minlength=len(dealt)).astype(np.uint32)
    n[ids[dealt] == 0] = 0
    return Asked(places, ctx[dealt], ids[dealt], n, likely[dealt], total[dealt].astype(np.uint64), bucket[dealt])


class Reading(NamedTuple):
    """What a chunk knows after some levels: p per token, whether its context is a state, and the last level's questions with counts."""

    count: np.ndarray
    root: np.ndarray
    p: np.ndarray
    state: np.ndarray
    asked: Asked | None
    counts: np.ndarray | None


def _runs(bucket: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Whether a question is the first on its context in its bucket."""
    opens = np.ones(len(ctx), bool)
    opens[1:] = (ctx[1:] != ctx[:-1]) | (bucket[1:] != bucket[:-1])
    return opens


def _answers_of(rows: list[dict], level: int, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each question its count, whether its context is a state, and what that leaves to its suffix."""
    mine = sorted((r for r in rows if r["level"] == level and r["counts"] is not None), key=lambda r: r["bucket"])
    counts = np.concatenate([np.zeros(0, np.uint64), *(unpack(r["counts"], np.uint64)[0] for r in mine)])
    none = np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    spelled, mass = (np.concatenate(c) for c in zip(none, *(unpack(r["states"], np.uint32, np.uint64) for r in mine), strict=True))
    run = np.cumsum(_runs(asked.bucket, asked.ctx)) - 1
    state, left = spelled[run] > 0, 1 - (mass[run] - DISCOUNT * spelled[run]) / np.maximum(asked.total, 1)
    spread = {r["ctx"]: r["mass"] for r in rows if r["level"] == level and r["counts"] is None}
    if spread:
        names = np.sort(np.array(list(spread), np.int64).view(np.uint64))
        lefts = np.array([spread[x] for x in names.view(np.int64).tolist()])
        at = np.minimum(np.searchsorted(names, asked.ctx), len(names) - 1)
        hit = names[at] == asked.ctx
        state, left = state | hit, np.where(hit, lefts[at], left)
    return counts, state, left


def replay(texts: Texts, rows: list[dict], upto: int, numbers: Numbers, asks: bool = True) -> tuple[Reading, Asked | None]:
    """The chunk as the answers to the levels 0 .. upto - 1 leave it, and with `asks` its questions on level `upto` (from 1)."""
    learns = np.repeat(texts.train, np.diff(texts.first))
    place = np.arange(len(texts.codes)) - np.repeat(texts.first[:-1], np.diff(texts.first))
    mine = sorted((r for r in rows if r["level"] == 0), key=lambda r: r["bucket"])
    ids, totals = (np.concatenate([np.zeros(0, np.uint64), *c]) for c in zip(*([unpack(r["counts"], np.uint64, np.uint64) for r in mine] or [[[], []]]), strict=True))
    word_ids, word_n = ids.astype(np.uint64), totals.astype(np.int64)
    count = word_n[texts.codes]
    root = (count + ADDED) / (numbers.tokens + ADDED * (numbers.distinct + 1))
    now = Reading(count, root, root, np.ones(len(count), bool), None, None)
    known = (word_ids > 0)[texts.codes]
    for level in range(1, upto + asks):
        before = np.arange(len(count)) - 1
        if level == 1:
            fit = (place >= 1) & known[before]
            item, total_of, most = texts.codes[before], word_n, np.where(known, count, 0)
        else:
            at, most = np.flatnonzero(now.asked.at >= 0), np.zeros(len(count), np.int64)
            most[at] = np.where(now.asked.word > 0, now.counts, 0)[now.asked.at[at]]
            fit = (place >= level) & now.state & (most[before] >= LEAST)
            item, total_of = now.asked.at[before], now.counts.astype(np.int64)
        where = np.flatnonzero(fit)
        tenths, total = in_tenths(now.p[where]), total_of[item[where]].astype(float)
        word = np.where(spelled_out(np.minimum(most[where], total), total, tenths, numbers), texts.codes[where], -1)
        asked = _questions(where, item[where], *contexts(level, now.asked, word_ids, numbers), total_of, word, word_ids, tenths, learns, numbers)
        if level == upto:
            return now, asked
        counts, is_state, left = _answers_of(rows, level, asked)
        of = asked.at[where]
        state = np.zeros(len(count), bool)
        state[where] = is_state[of]
        p = now.p.copy()
        inside = where[is_state[of]]
        q = asked.at[inside]
        spelled = (asked.word[q] > 0) & spelled_out(counts[q].astype(float), asked.total[q].astype(float), asked.tenths[q], numbers)
        p[inside] = np.where(spelled, (counts[q] - DISCOUNT) / asked.total[q], 0.0) + left[q] * now.p[inside]
        now = Reading(count, root, p, state, asked, counts)
    return now, None


def spelled_out(c: np.ndarray, n: np.ndarray, tenths: np.ndarray, numbers: Numbers) -> np.ndarray:
    """Whether a word with `c` of the context's `n` occurrences gains more than its price over its probability in the suffix.

    Where that holds for a count it holds for larger ones, so a bound of the count gives a bound here.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        return (c >= 2) & (c * (np.log(c / n) + tenths / 10.0) > numbers.price)


def _words_asked(numbers: Numbers):
    """Questions of level 0: distinct words and how often training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = _restored(row)
                learns = np.repeat(texts.train, np.diff(texts.first))
                n = np.bincount(texts.codes, weights=learns, minlength=texts.distinct).astype(np.uint64)
                words = np.cumsum(unpack(row["words"], np.uint64)[0], dtype=np.uint64)
                yield from _cut(row["chunk"], _top(words, numbers.buckets), [words, n])

    return run


def _inner(bucket: np.ndarray, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Words as steps from the one before in the same bucket and context."""
    same = np.zeros(len(ctx), bool)
    same[1:] = (ctx[1:] == ctx[:-1]) & (bucket[1:] == bucket[:-1])
    return np.where(same, _steps(word), word)


def _outer(ctx: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """`_inner` undone, for one bucket."""
    opens = np.ones(len(ctx), bool)
    opens[1:] = ctx[1:] != ctx[:-1]
    total = np.cumsum(steps, dtype=np.uint64)
    start = np.maximum.accumulate(np.where(opens, np.arange(len(ctx)), 0))
    return total - (total[start] - steps[start])


def _cut(chunk: int, bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row of packed questions for each bucket; the first column is in order in each and is packed as steps."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    stops = [*starts[1:].tolist(), len(bucket)][: len(starts)]
    rows = [pack(_steps(columns[0][a:b]), *(c[a:b] for c in columns[1:])) for a, b in zip(starts.tolist(), stops, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array(rows, pa.binary())], ["bucket", "chunk", "asks"])


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist([dict.fromkeys(_ANSWER_NAMES) | r for r in rows], _ANSWER_SCHEMA)


def _gathered(found: pa.Table, kinds: list[type]) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """Chunks, where their questions end, and the questions of all of them."""
    parts = [unpack(x.as_py(), *kinds) for x in found.column("asks")]
    sizes = [len(p[0]) for p in parts]
    for p in parts:
        p[0] = np.cumsum(p[0], dtype=np.uint64)
        if len(p) > 2:
            p[1] = _outer(p[0], p[1])
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return found.column("chunk").to_pylist(), np.cumsum(sizes), columns


def _count_words(numbers: Numbers):
    """A bucket's words: counts of all training texts, and an id from 1 for those seen twice."""

    def run(key: tuple, found: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        chunks, stops, (words, n) = _gathered(found, [np.uint64, np.uint64])
        distinct, at = np.unique(words, return_inverse=True)
        total = np.bincount(at, weights=n, minlength=len(distinct)).astype(np.uint64)
        # Frequent words get small ids, which pack better.
        ids, often = np.zeros(len(total), np.uint64), np.argsort(~total, kind="stable")[: int((total >= 2).sum())]
        ids[often] = np.arange(1, len(often) + 1, dtype=np.uint64) * np.uint64(numbers.buckets) + np.uint64(bucket)
        rows = [{"level": 0, "bucket": bucket, "chunk": c, "counts": pack(ids[at[a:b]], total[at[a:b]])} for c, a, b in zip(chunks, [0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        return _table([*rows, {"level": -1, "bucket": bucket, "total": int(total.sum()), "spelled": int((total > 0).sum())}])

    return run


_LEVEL = [np.uint64, np.uint64, np.uint32, np.uint8, np.uint64]


def _test_contexts(level: int, numbers: Numbers):
    """A bucket's contexts: counts of (context, word), the test, and answers to each chunk; sums for contexts that are spread."""

    def run(key: tuple, found: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        chunks, stops, (ctx, word, n, tenths, total) = _gathered(found, _LEVEL)
        order = np.lexsort((word, ctx))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(ctx[order]) != 0) | (np.diff(word[order]) != 0)
        gram = np.empty(len(order), np.int64)
        gram[order] = np.cumsum(new) - 1
        first = order[new]
        c = np.bincount(gram, weights=n, minlength=len(first))
        g_ctx, g_word, g_n, g_tenths = ctx[first], word[first], total[first].astype(float), tenths[first]
        spelled = (g_word > 0) & spelled_out(c, g_n, g_tenths, numbers)
        opens = np.flatnonzero(np.diff(g_ctx, prepend=~g_ctx[0]))
        of = np.cumsum(np.diff(g_ctx, prepend=~g_ctx[0]) != 0) - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(spelled, c * (np.log(c / g_n) + g_tenths / 10.0) - numbers.price, 0.0)
        sums = lambda x: np.bincount(of, weights=np.where(spelled, x, 0.0), minlength=len(opens))
        gain, mass, likely_mass, k = sums(gain), sums(c), sums(np.exp(g_tenths / -10.0)), sums(1.0)
        names, totals = g_ctx[opens], g_n[opens]
        hot = totals > numbers.hot
        state = ~hot & (k > 0) & (gain + rest_gain(totals, mass, likely_mass) > 0)
        told_k, told_mass = np.where(state, k, 0).astype(np.uint32), np.where(state, mass, 0).astype(np.uint64)
        rows = []
        for chunk, a, b in zip(chunks, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            mine = of[gram[a:b]][_runs(np.zeros(b - a), ctx[a:b])]
            rows.append({"level": level, "bucket": bucket, "chunk": chunk, "counts": pack(c[gram[a:b]].astype(np.uint64)), "states": pack(told_k[mine], told_mass[mine])})
            itself = ctx[a:b][(word[a:b] == 0) & (total[a:b] > numbers.hot)]
            rows += [{"level": level, "chunk": chunk, "ctx": x} for x in itself.view(np.int64).tolist()]
        for x in np.flatnonzero(hot & (k > 0)).tolist():
            rows.append({"level": level, "ctx": int(names[x : x + 1].view(np.int64)[0]), "gain": float(gain[x]), "mass": float(mass[x]), "likely": float(likely_mass[x]), "spelled": int(k[x]), "total": int(totals[x])})
        return _table(rows)

    return run


def rest_gain(n: np.ndarray, mass: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """What the words that are not spelled out gain as one class."""
    rest = n - mass
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(rest > 0, rest * np.log(rest / n / np.maximum(1 - likely, 1e-12)), 0.0)


def _asking(level: int, numbers: Numbers):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            row = left.to_pylist()[0]
            _, asked = replay(_restored(row), right.to_pylist(), level, numbers)
            out = list(_cut(row["chunk"], asked.bucket, [asked.ctx, _inner(asked.bucket, asked.ctx, asked.word), asked.n, asked.tenths, asked.total]))
        return pa.Table.from_batches(out, pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("asks", pa.binary())]))

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scoring(depth: int, numbers: Numbers) -> Callable:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCORED.empty_table()
        row = left.to_pylist()[0]
        texts = _restored(row)
        last, _ = replay(texts, right.to_pylist(), depth + 1, numbers, asks=False)
        per = lambda x: np.add.reduceat(x, texts.first[:-1])  # noqa: E731  every text has a token at least
        columns = [row["ids"], texts.train, np.diff(texts.first), per((last.count > 0).astype(np.int64)), np.full(len(texts.train), numbers.tokens), per(np.log10(last.root)), per(np.log10(last.p))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORED, strict=True)], schema=_SCORED)

    return run


def score(docs: DataFrame, train: Column, depth: int = DEPTH, scratch: Scratch | None = None, chunk_bytes: int = CHUNK_BYTES, bucket_asks: int = BUCKET_ASKS) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs` (doc_id, text).

    Rows where `train` holds are learnt from, all rows are scored.  Scores are log10 probabilities of a
    text's lower-cased words and its end: `base_score` after the root alone, `score` after the tree with
    contexts of up to `depth` words.  n_known counts tokens that training texts have, train_tokens is
    their number.  A null text is empty (one token, its end), a null `train` is false; null and shared
    doc_ids are rows like any other.  Nothing to learn from: every probability is the root's.  Words are told
    apart by 64-bit hashes.  An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffix-tree")
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks = scratch.save(given.mapInArrow(_chunks(chunk_bytes), _CHUNK), "chunks")
    size = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    numbers = Numbers(1 << max(0, (size // bucket_asks).bit_length()))

    asks = chunks.mapInArrow(_words_asked(numbers), _ASKS)
    answers = scratch.save(asks.groupBy("bucket").applyInArrow(_count_words(numbers), _ANSWERS), "level0", "uncompressed")
    seen = answers.where("level = -1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("spelled"), F.lit(0))).first()
    numbers = numbers._replace(tokens=seen[0], distinct=seen[1])
    answers = answers.where("level = 0")
    chunks = chunks.drop("words")
    for level in range(1, depth + 1):
        asks = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_asking(level, numbers), _ASKS)
        found = scratch.save(asks.groupBy("bucket").applyInArrow(_test_contexts(level, numbers), _ANSWERS), f"level{level}", "uncompressed")
        answers = answers.unionByName(found.where("counts is not null")).unionByName(_spread_states(found, level))
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scoring(depth, numbers), ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'double' if f.type == pa.float64() else 'long'}" for f in _SCORED))


def _spread_states(found: DataFrame, level: int) -> DataFrame:
    """Answers on contexts that are spread over buckets: those whose sums pass the test, to the chunks that have them."""
    sums = found.where("chunk is null").groupBy("ctx").agg(*(F.sum(c).alias(c) for c in ("gain", "mass", "likely", "spelled")), F.max("total").alias("total"))
    rest = F.col("total") - F.col("mass")
    gain = F.col("gain") + F.when(rest > 0, rest * F.log(rest / F.col("total") / F.greatest(1 - F.col("likely"), F.lit(1e-12)))).otherwise(0.0)
    left = 1 - (F.col("mass") - DISCOUNT * F.col("spelled")) / F.col("total")
    states = sums.where(gain > 0).select("ctx", left.alias("mass"))
    asking = found.where("counts is null and chunk is not null").select("chunk", "ctx")
    rows = asking.join(states, "ctx").withColumn("level", F.lit(level))
    kinds = dict(x.split() for x in _ANSWERS.split(", "))
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in _ANSWER_NAMES))


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of `documents`, learnt from all but fold HELD; see `score`."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fold(F.col("doc_id"), FOLDS) != HELD)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
