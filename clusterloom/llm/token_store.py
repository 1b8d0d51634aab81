"""Token ids in Huffman-coded block files, written in order of doc_id and read back.

Format: a folder with two Parquet tables that Spark writes and reads in any of its stores.
``codes`` (id, length) is the canonical code, taken from the counts of all ids.  ``blocks`` has a row
per block (shard, block, start, data): ids of about BLOCK_IDS, `start` counted from the shard's
first id.  ``data`` stands alone, little-endian: magic, documents, checkpoints, then per document
its id, whether it has one, and its number of ids, then the checkpoints' bit offsets, then the bits.
A document begins on a byte and lies in one block.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterloom.llm import huffman, wordbytes
from clusterloom.llm.tables import table
from clusterloom.plans.scratch import Scratch

END_ID = 1
#: ids in a block, about; a longer document makes a longer block
BLOCK_IDS = 1 << 19
#: ids in a shard, about
SHARD_IDS = 1 << 26
MAGIC = 0x314B4C42
#: bytes of text that a worker encodes at a time; a longer text stands alone (up to 2 GB)
TEXT_BYTES = 8 << 20
#: pieces whose ids a worker keeps; beyond, those that only one batch has used are forgotten first
KNOWN_WORDS = 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ",.!?;:*#$%&()"]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, through a memory of the ids of single words.

    For tokenizers that cut a text at white space and between a run of letters and a run of marks, such
    as word_bpe_49k: the ids of a text are then those of its pieces one after another, and each distinct
    piece is encoded once.  A-Z are folded before the lookup if the piece is plain ASCII, as this
    tokenizer folds case itself; pieces with "<" keep theirs, as special tokens are matched by case.
    """

    def __init__(self, path: str, known: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), known
        suffix = json.loads(self.tokenizer.model.__getstate__())["end_of_word_suffix"]
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.stops = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the pieces that two batches or more have used, if that frees half of the memory; else none."""
        kept = np.flatnonzero(self.uses >= 2)
        if 2 * len(kept) > self.most:
            self.clear()
            return
        often = set(kept.tolist())
        names = sorted((place, piece) for piece, place in self.places.items() if place in often)
        sizes = np.diff(self.stops)[kept]
        stops = np.cumsum(sizes)
        where = np.arange(int(sizes.sum())) + np.repeat(self.stops[kept] - (stops - sizes), sizes)
        self.places = {piece: k for k, (_, piece) in enumerate(names)}
        self.ids, self.uses = self.ids[where], np.ones(len(kept), np.int32)
        self.stops = np.concatenate([[0], stops])

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces; those of letters alone go many at a time, parted by blanks.

        A run of letters is one unit of the tokenizer, and a unit's last id is one of a word's end, so
        the ends tell the pieces apart.  Where there are more ends than pieces (a letter whose lower case
        is more than a letter), the group is encoded piece by piece.
        """
        texts = [p.decode("utf-8", "replace") for p in pieces]
        alone, whole = [], []
        for k, t in enumerate(texts):
            (whole if self.ends is not None and t.isalpha() else alone).append(k)
        order, found, sizes = [], [self.ids], []
        for low in range(0, len(whole), 512):
            group = whole[low : low + 512]
            ids = np.array(self._batch([" ".join(texts[k] for k in group)])[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group):
                order += group
                found.append(ids)
                sizes.append(np.diff(stops, prepend=0))
            else:
                alone += group
        for k, x in zip(alone, self._batch([texts[k] for k in alone]), strict=True):
            order.append(k)
            found.append(np.array(x.ids, np.uint32))
            sizes.append([len(x.ids)])
        self.places.update(zip(map(pieces.__getitem__, order), range(len(self.places), len(self.places) + len(order)), strict=True))
        self.ids = np.concatenate(found)
        self.stops = np.concatenate([self.stops, np.cumsum(np.concatenate(sizes)) + self.stops[-1]])
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), np.int32)])

    def _batch(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's END_ID behind them, and the number of ids per text."""
        pieces, first = _pieces(texts)
        coded = pieces.dictionary_encode()
        values = coded.dictionary.to_pylist()
        if len(self.places) + len(values) > self.most:
            self._forget()
        place = np.fromiter(map(self.places.get, values, repeat(-1)), np.int32, len(values))
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new = [values[k] for k in unknown.tolist()]
            self._learn(new)
            place[unknown] = np.fromiter(map(self.places.__getitem__, new), np.int32, len(new))
        self.uses[place] += 1
        # The end id is a piece of its own, put behind the pieces of each text.
        begin = np.append(self.stops[place], self.stops[-1]).astype(np.int32)
        sizes = np.append(self.stops[place + 1] - self.stops[place], 1).astype(np.int32)
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False), first[1:], len(values))
        size = sizes[codes]
        stops = np.cumsum(size, dtype=np.int32)
        where = np.repeat(begin[codes] - (stops - size), size)
        where += np.arange(len(where), dtype=np.int32)
        per = np.diff(stops[first[1:] + np.arange(len(texts))].astype(np.int64), prepend=0)
        return np.append(self.ids, np.uint32(END_ID))[where], per


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    found = wordbytes.words(texts)
    data = found.text
    if not len(data):
        return pa.array([], pa.binary()), found.first
    plain = ~np.logical_or.reduceat((data >= 0x80) | (data == ord("<")), found.start)
    fold = np.repeat(plain, found.end - found.start + 1)
    fold &= data >= 0x41
    fold &= data <= 0x5A
    data = data + fold.view(np.uint8) * np.uint8(32)
    cut = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
    owner = np.searchsorted(found.end, cut, side="right")
    start = np.concatenate([found.start, cut])
    order = np.argsort(start, kind="stable")
    start = start[order]
    word = np.concatenate([np.arange(len(found.start)), owner])[order]
    stop = np.minimum(np.append(start[1:], len(data)), found.end[word])
    solid = np.ones(len(data), bool)
    solid[found.end] = False
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
    upto = np.searchsorted(word, found.first, side="left")
    return pieces, upto


_encoders: dict[str, Encoder] = {}


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row; ids are little-endian unsigned 32-bit integers, the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        for batch in wordbytes.slices(batches, "text", TEXT_BYTES):
            ids, per = _encoders[tokenizer].encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(per), _ragged(ids.astype("<u4"), per)], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _ragged(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind: str) -> np.ndarray:
    """All bytes of a binary column, one after another, as numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    raw = column.buffers()[2]
    return np.frombuffer(raw[int(offsets[0]) : int(offsets[-1])], kind) if raw and len(column) else np.zeros(0, kind)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in wordbytes.slices(batches, "ids", 16 << 20):
        now = np.bincount(_values(batch.column("ids"), "<u4"))
        if len(now) > len(total):
            now[: len(total)] += total
            total = now
        else:
            total[: len(now)] += now
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])


def write(docs: DataFrame, folder: str, tokenizer: str, scratch: Scratch, shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of `docs` (doc_id, text; null texts are empty) below `folder`, in ascending doc_id order.

    Texts are tokenized once, into the shared folder.  The driver sees the counts per id (as many rows
    as the vocabulary), one quantile per shard, and no documents.  Shards are ranges of doc_id; a task
    writes one as a stream of sorted rows, so a shard of any size takes the memory of a block.
    A null doc_id comes first; rows that share a doc_id follow each other in order of their codes.
    """
    spark = docs.sparkSession
    ids = scratch.save(tokenized(docs, tokenizer), "ids", compression="zstd")
    rows = ids.mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    symbols, counts = (rows.column(c).to_numpy() for c in ("id", "n"))
    code = huffman.build(symbols, counts)
    lengths = code.lengths[symbols] if len(symbols) else symbols
    spark.createDataFrame(list(zip(symbols.tolist(), lengths.tolist(), strict=True)), "id long, length int").coalesce(1).write.parquet(f"{folder}/codes")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // shard_ids)) if len(counts) else 1
    cuts = ids.approxQuantile("doc_id", [i / shards for i in range(1, shards)], max(0.1 / shards, 1e-5)) if shards > 1 else []
    shared = spark.sparkContext.broadcast((code, np.unique(np.array(cuts, np.int64))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, cuts = shared.value
        for batch in wordbytes.slices(batches, "ids", 8 << 20):
            sizes = batch.column("n_tokens").to_numpy()
            data, starts, marks = huffman.encode(code, _values(batch.column("ids"), "<u4"), sizes)
            doc_id = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            shard = np.searchsorted(cuts, doc_id, side="right").astype(np.int32)
            columns = [pa.array(shard), batch.column("doc_id"), batch.column("n_tokens")]
            columns += [_ragged(data, np.diff(starts)), _ragged(marks.astype("<u8"), -(-sizes // huffman.EVERY))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "n_tokens", "bits", "marks"])

    coded = ids.mapInArrow(encode, "shard int, doc_id long, n_tokens long, bits binary, marks binary")
    dealt = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n_tokens", "bits")
    schema = "shard int, block int, start long, n_tokens long, data binary"
    dealt.mapInArrow(lambda batches: _pack(batches, block_ids), schema).write.option("compression", "none").parquet(f"{folder}/blocks")
    scratch.drop("ids")


def _pack(batches: Iterator[pa.RecordBatch], block_ids: int) -> Iterator[pa.RecordBatch]:
    shard, block, start, held, size = None, 0, 0, [], 0

    def flush() -> pa.RecordBatch:
        n = np.concatenate([x[1] for x in held]).astype("<i8")
        doc_id = pa.concat_arrays([x[0] for x in held])
        there = np.asarray(doc_id.is_valid()).astype("u1")
        marks, bits = (b"".join(x[k] for x in held) for k in (2, 3))
        head = np.array([MAGIC, len(n), len(marks) // 8], "<i8").tobytes()
        ends = np.concatenate([x[4] for x in held]).astype("<i8")
        data = b"".join([head, doc_id.fill_null(0).to_numpy().astype("<i8").tobytes(), n.tobytes(), ends.tobytes(), marks, there.tobytes(), bits])
        columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([data])]
        return pa.RecordBatch.from_arrays(columns, ["shard", "block", "start", "n_tokens", "data"])

    for batch in batches:
        shards, sizes = batch.column("shard").to_numpy(), batch.column("n_tokens").to_numpy()
        at = 0
        while at < batch.num_rows:
            if held and (shards[at] != shard or size >= block_ids):
                yield flush()
                block, start, held, size = block + 1, start + size, [], 0
            if shards[at] != shard:
                shard, block, start = int(shards[at]), 0, 0
            stop = int(np.searchsorted(shards, shard, "right"))
            stop = min(stop, at + 1 + int(np.searchsorted(np.cumsum(sizes[at:stop]), block_ids - size, "left")))
            part = batch.slice(at, stop - at)
            bits = part.column("bits")
            offsets = np.frombuffer(bits.buffers()[1], np.int32, len(bits) + 1, bits.offset * 4).astype(np.int64)
            held.append((part.column("doc_id"), sizes[at:stop], _values(part.column("marks"), "u1").tobytes(), _values(bits, "u1").tobytes(), np.diff(offsets)))
            size += int(sizes[at:stop].sum())
            at = stop
    if held:
        yield flush()


def unpack(data: bytes, code: huffman.Code) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_id, number of ids, and all ids of a block, from the block and the code alone."""
    magic, docs, marks = np.frombuffer(data, "<i8", 3).tolist()
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = 24
    doc_id, sizes, lengths = (np.frombuffer(data, "<i8", docs, at + 8 * docs * k) for k in range(3))
    at += 24 * docs
    offsets = np.frombuffer(data, "<u8", marks, at).astype(np.int64)
    at += 8 * marks
    there = np.frombuffer(data, "u1", docs, at).astype(bool)
    bits = np.frombuffer(data, np.uint8, -1, at + docs)
    per = -(-sizes // huffman.EVERY)
    owner = np.repeat(np.arange(docs), per)
    lane = np.arange(marks) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(lengths) - lengths) * 8
    ids = huffman.decode(code, bits, offsets + begin[owner], np.minimum(huffman.EVERY, sizes[owner] - lane * huffman.EVERY))
    return pa.array(doc_id, mask=~there), sizes, ids


def read_code(spark: SparkSession, folder: str) -> huffman.Code:
    rows = spark.read.schema("id long, length int").parquet(f"{folder}/codes").orderBy("id").toArrow()
    return huffman.canonical(rows.column("id").to_numpy(), rows.column("length").to_numpy().astype(np.int64))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, decoded from the files in `folder`.

    Blocks are decoded on their own, in any order.  A document's start is the sum of the shards before
    (one row each), the block's start within its shard, and the place in the block.
    """
    shared = spark.sparkContext.broadcast(read_code(spark, folder))
    blocks = spark.read.schema("shard int, block int, start long, n_tokens long, data binary").parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, sizes, ids = unpack(batch.column("data")[k].as_py(), shared.value)
                stops = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]
                shard = pa.array(np.full(len(sizes), batch.column("shard")[k].as_py(), np.int32))
                start = pa.array(stops - sizes + batch.column("start")[k].as_py())
                yield pa.RecordBatch.from_arrays([shard, doc_id, start, pa.array(sizes), pa.array(sums, pa.int64())], ["shard", "doc_id", "inner", "n_tokens", "ids_crc32"])

    found = blocks.select("shard", "start", "data").mapInArrow(run, "shard int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    joined = found.join(shards, "shard")
    return joined.select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def store(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write `docs` to `folder` (by default below the shared folder) and return what `read` finds there."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-store")
    folder = folder or scratch.path("files")
    write(docs, folder, tokenizer or default_tokenizer(), scratch)
    return read(spark, folder)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading the token files of all `documents` back gives, per document; see `write` for nulls and ties."""
    return store(table(spark, sf_dir, "documents"))
