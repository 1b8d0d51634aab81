"""Benchmark decontamination: BM25 over test items, block-max WAND, then a check of the overlap.

The test items are the index, every passage of every training document is a query.  A posting holds
the item's BM25 weight of the term as a share of the item's score against its own text, so a passage
that holds all of an item scores 1 and one threshold serves items of any length.

Terms are runs of letters and digits in lower case: markup, punctuation and case do not hide a leak.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm import wordbytes
from clusterloom.llm.tables import fresh, table
from clusterloom.plans.scratch import Scratch

K1, B = 1.2, 0.75
#: share of an item's own BM25 score that a passage must reach to be looked at
THRESHOLD = 0.5
#: share of three-word shingles of the question, and of the answer, that must stand in the passage
LEAST_QUESTION = 0.6
LEAST_ANSWER = 0.5
SHINGLE = 3
#: least words in a passage; passages are twice as long as the longest item and overlap by half
LEAST_PASSAGE = 128
#: postings in a block of a term's list
BLOCK = 8
#: ranges of items with a bound of their own, for all words of all passages and then for distinct words
RANGES = 32
FINE_RANGES = 512
#: bytes of test items in one index, which bounds its memory: some 100 bytes for each word of the items, and
#: 4 * RANGES for each distinct one; a larger set of items is taken in several indexes
INDEX_BYTES = 8 << 20


class Item(NamedTuple):
    item_id: int
    question: list[str]
    answer: list[str]


class Index(NamedTuple):
    """`lists`: per term (items, weights, last item of each block, largest weight of each block).

    `bounds` has the largest weight of each term in each of RANGES ranges of items; `fine` those in
    FINE_RANGES ranges, where there is one: a term's are fine[first[term]:first[term + 1]] as (ranges,
    weights), no more than it has postings.
    """

    items: list[Item]
    terms: list[str]
    lists: list[tuple[list[int], list[float], list[int], list[float]]]
    bounds: np.ndarray
    first: np.ndarray
    fine: tuple[np.ndarray, np.ndarray]
    half: int

    def most(self, query: np.ndarray) -> float:
        """No item scores more than this for the distinct terms `query`."""
        sizes = self.first[query + 1] - self.first[query]
        stops = np.cumsum(sizes)
        where = np.arange(int(sizes.sum())) + np.repeat(self.first[query] - (stops - sizes), sizes)
        return float(np.bincount(self.fine[0][where], weights=self.fine[1][where], minlength=1).max())


class Statistics(NamedTuple):
    """Of all items with a term: how many hold each term, their number, their words and the longest's."""

    df: dict[str, int]
    items: int
    words: int
    longest: int


def terms_of(text: str | None) -> list[str]:
    found = wordbytes.words(pa.array([(text or "").lower()]), between=wordbytes.NO_WORD)
    return [x.decode() for x in wordbytes.as_array(found).to_pylist()]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last line, or the last sentence of a single line.

    A text of one sentence is cut before its last quarter of words.
    """
    pieces = [x for x in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if re.search(r"\w", x)]
    if len(pieces) > 1:
        return " ".join(pieces[:-1]), pieces[-1]
    found = text.split()
    cut = len(found) - max(1, len(found) // 4)
    return " ".join(found[:cut]), " ".join(found[cut:])


def build(rows: list[tuple[int, str | None]], whole: Statistics | None = None) -> Index:
    """The inverted index of (item_id, text) rows; items without a term can't match and are left out.

    `whole` has the statistics of all items where this index holds a part of them; its df needs the
    terms of these rows only.
    """
    kept = [(i, text, words) for i, text in rows if (words := terms_of(text))]
    if whole is None:
        lengths = [len(words) for _, _, words in kept]
        whole = Statistics(Counter(t for _, _, words in kept for t in set(words)), len(kept), sum(lengths), max(lengths, default=0))
    df, n, mean = whole.df, whole.items, whole.words / max(1, whole.items)
    items, postings = [], {}
    for place, (item_id, text, words) in enumerate(kept):
        question, answer = split_item(text)
        items.append(Item(item_id, terms_of(question), terms_of(answer)))
        norm = K1 * (1 - B + B * len(words) / mean)
        weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in Counter(words).items()}
        own = sum(weight.values())
        for t, w in weight.items():
            postings.setdefault(t, []).append((place, w / own))
    terms = sorted(postings)
    # The last row is for words of no item.
    bounds = np.zeros((len(terms) + 1, RANGES), np.float32)
    coarse, narrow = (max(1, -(-len(items) // n)) for n in (RANGES, FINE_RANGES))
    lists, fine, first = [], ([], []), [0]
    for k, t in enumerate(terms):
        where, weights = (list(x) for x in zip(*postings[t], strict=True))
        cuts = range(0, len(where), BLOCK)
        lists.append((where, weights, [where[min(c + BLOCK, len(where)) - 1] for c in cuts], [max(weights[c : c + BLOCK]) for c in cuts]))
        held = np.array(weights, np.float32)
        np.maximum.at(bounds[k], np.array(where) // coarse, held)
        ranges, starts = np.unique(np.array(where) // narrow, return_index=True)
        fine[0].append(ranges)
        fine[1].append(np.maximum.reduceat(held, starts))
        first.append(first[-1] + len(ranges))
    joined = (np.concatenate([np.zeros(0, np.int64), *fine[0]]), np.concatenate([np.zeros(0, np.float32), *fine[1]]))
    return Index(items, terms, lists, bounds, np.array(first, np.int64), joined, max(LEAST_PASSAGE // 2, whole.longest))


def wand(index: Index, query: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
    """(item place, score) of all items that score `threshold` or more for the distinct terms `query`.

    Lists are kept in order of their current item.  The pivot is the first item at which the lists'
    largest weights add up to the threshold; the largest weights of the blocks that hold the pivot
    decide whether it is scored or whether all lists move past the nearest block end.
    """
    slack = threshold - 1e-9
    cursors = [[lists[0][0], max(lists[3]), 0, lists] for lists in (index.lists[t] for t in query)]
    out, end = [], len(index.items)

    def seek(c: list, item: int) -> None:
        where, lasts = c[3][0], c[3][2]
        at, block = c[2], c[2] // BLOCK
        while block < len(lasts) and lasts[block] < item:
            block += 1
            at = block * BLOCK
        while at < len(where) and where[at] < item:
            at += 1
        c[2], c[0] = at, where[at] if at < len(where) else end

    while cursors:
        cursors = sorted((c for c in cursors if c[0] < end), key=lambda c: c[0])
        bound, pivot = 0.0, None
        for k, c in enumerate(cursors):
            bound += c[1]
            if bound >= slack:
                pivot = k
                break
        if pivot is None:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        inside, nearest = 0.0, end
        for c in cursors[: pivot + 1]:
            lasts = c[3][2]
            block = c[2] // BLOCK
            while block < len(lasts) and lasts[block] < item:
                block += 1
            if block < len(lasts):
                inside += c[3][3][block]
                nearest = min(nearest, lasts[block] + 1)
        if inside >= slack:
            if cursors[0][0] == item:
                score = sum(c[3][1][c[2]] for c in cursors[: pivot + 1])
                if score >= slack:
                    out.append((item, score))
                for c in cursors[: pivot + 1]:
                    seek(c, item + 1)
            else:
                for c in cursors[: pivot + 1]:
                    if c[0] < item:
                        seek(c, item)
        else:
            if pivot + 1 < len(cursors):
                nearest = min(nearest, cursors[pivot + 1][0])
            for c in cursors[: pivot + 1]:
                seek(c, max(nearest, item + 1))
    return out


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the shingles of `part` that stand in `passage`; a part without words is always there."""
    size = min(SHINGLE, len(part))
    if not size:
        return 1.0
    there = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
    wanted = [tuple(part[i : i + size]) for i in range(len(part) - size + 1)]
    return sum(x in there for x in wanted) / len(wanted)


def search(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item place, score, question share, answer share) for each leak found in a text.

    A passage is two halves of index.half words, and every half is in two passages, so each run of an
    item's length lies within one.  The first pass adds up, per range of items, the largest weights of
    a passage's words, then those of its distinct words in finer ranges; passages that reach the
    threshold in no range can't have a pivot and go no further.  The others are searched by `wand`, and what it finds is compared word by word.
    """
    if not index.items:
        return
    found = wordbytes.words(pc.utf8_lower(pc.fill_null(texts, "")), between=wordbytes.NO_WORD)
    spelt = wordbytes.as_array(found)
    vocabulary = pa.array([t.encode() for t in index.terms], pa.binary())
    codes = pc.fill_null(pc.index_in(spelt, value_set=vocabulary), len(index.terms)).to_numpy(zero_copy_only=False)
    for row in range(len(texts)):
        a, z = int(found.first[row]), int(found.first[row + 1])
        if a == z:
            continue
        halves = np.arange(a, z, index.half)
        sums = np.add.reduceat(index.bounds[codes[a:z]], halves - a, axis=0)
        both = sums if len(sums) == 1 else sums[:-1] + sums[1:]
        for k in np.flatnonzero(both.max(axis=1) >= THRESHOLD - 1e-3).tolist():
            low, stop = int(halves[k]), min(z, int(halves[k]) + 2 * index.half)
            query = np.unique(codes[low:stop])
            query = query[query < len(index.terms)]
            if index.most(query) < THRESHOLD - 1e-3:
                continue
            passage = None
            for place, score in wand(index, query.tolist()):
                passage = passage or [x.decode() for x in spelt[low:stop].to_pylist()]
                item = index.items[place]
                asked, answered = overlap(item.question, passage), overlap(item.answer, passage)
                if asked >= LEAST_QUESTION and answered >= LEAST_ANSWER:
                    yield row, place, score, asked, answered


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, items, words, longest) per term of a batch; the null term stands for all its items."""
    for batch in wordbytes.slices(batches, "text"):
        df, lengths = Counter(), []
        for text in batch.column("text").to_pylist():
            if words := terms_of(text):
                df.update(set(words))
                lengths.append(len(words))
        if lengths:
            none = [None] * len(df)
            columns = [[None, *df], [len(lengths), *df.values()], [sum(lengths), *none], [max(lengths), *none]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 3), strict=True)], ["term", "items", "words", "longest"])


def indexes(benchmark: DataFrame, most_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes of all items, of about `most_bytes` of text each; null and empty items are passed over.

    Only one index is on the driver at a time.  Items are read in order of item_id through
    toLocalIterator, so a large benchmark never arrives whole.  Term statistics are those of all items,
    counted on the executors; the driver gets the counts of one index's terms, so results do not
    depend on where the items are cut.
    """
    spark = benchmark.sparkSession
    given = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    counted = given.select("text").mapInArrow(_count_terms, "term string, items long, words long, longest long")
    counted = counted.groupBy("term").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest"))
    scratch = Scratch(spark, "decontaminate")
    counted = scratch.save(counted, "terms")
    total = counted.where("term is null").first()

    def part(rows: list[tuple[int, str]]) -> Index:
        terms = sorted({t for _, text in rows for t in terms_of(text)})
        if not terms:
            return build(rows)
        wanted = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}))
        df = {r.term: r["items"] for r in counted.join(wanted, "term", "left_semi").select("term", "items").toLocalIterator()}
        return build(rows, Statistics(df, total["items"], total.words, total.longest))

    rows, size = [], 0
    for item_id, text in given.orderBy("item_id", "text").toLocalIterator():
        rows.append((item_id, text))
        size += len(text.encode())
        if size >= most_bytes:
            yield part(rows)
            rows, size = [], 0
    if rows:
        yield part(rows)
    scratch.drop("terms")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row per document and item found in it.

    The best passage of a document stands for the pair.  Null and empty texts hold nothing; an empty
    benchmark gives no rows.  Documents are read once, where they lie: where there are several indexes,
    a row goes from one search to the next, each of which holds one index.  Only the pairs are shuffled.
    """
    spark = docs.sparkSession
    hit = "struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>"
    kind = pa.list_(pa.struct([("item_id", pa.int64()), *((c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap"))]))
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.array().cast(f"array<{hit}>").alias("hits"))
    shared_all = [spark.sparkContext.broadcast(index) for index in indexes(benchmark)]
    for shared in shared_all:

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=shared is shared_all[-1]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in wordbytes.slices(batches, "text"):
                found: dict[int, list] = {}
                for row, place, *numbers in search(index, batch.column("text")):
                    found.setdefault(row, []).append((index.items[place].item_id, *numbers))
                if found:
                    hits = batch.column("hits").to_pylist()
                    for row, more in found.items():
                        hits[row] = [*(hits[row] or []), *(dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), x, strict=True)) for x in more)]
                    batch = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(hits, kind)], ["doc_id", "text", "hits"])
                if last:  # texts have done their work, and rows without a hit too
                    batch = batch.filter(pc.greater(pc.list_value_length(batch.column("hits")), 0))
                    batch = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.nulls(batch.num_rows, pa.string()), batch.column("hits")], ["doc_id", "text", "hits"])
                yield batch

        out = out.mapInArrow(run, f"doc_id long, text string, hits array<{hit}>")
    each = out.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return each.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that hold a test item; columns stay as they are and nothing is shuffled."""
    columns = docs.columns
    (name,) = fresh(columns, "searched_text")
    out = docs.withColumn(name, F.col("text").cast("string"))
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in wordbytes.slices(batches, name):
                clean = np.ones(batch.num_rows, bool)
                clean[[hit[0] for hit in search(shared.value, batch.column(name))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, out.schema)
    return out.select(*columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items of `benchmark` in every row of `documents`, whole texts; see `leaks`."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
