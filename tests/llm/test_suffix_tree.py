"""The suffix tree against a plain one over dictionaries, and its probabilities."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.llm import suffix_tree
from clusterloom.llm.suffix_tree import ADDED, DISCOUNT, LEAST, pack, score, unpack

SCHEMA = "doc_id long, text string, train boolean"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]


class Plain:
    """The same tree from counts in dictionaries."""

    def __init__(self, texts, depth):
        self.depth = depth
        docs = [words_of(t) for t in texts]
        self.grams = [Counter() for _ in range(depth + 2)]
        for d in docs:
            for size in range(1, depth + 2):
                self.grams[size].update(tuple(d[i : i + size]) for i in range(len(d) - size + 1))
        self.n, self.v = sum(self.grams[1].values()), len(self.grams[1])
        price = math.log(max(self.n, 2))
        self.states, self.asked = {}, set()
        for size in range(1, depth + 1):
            follow = defaultdict(dict)
            for g, c in self.grams[size + 1].items():
                follow[g[:-1]][g[-1]] = c
            for s, n in self.grams[size].items():
                # A longer context has a state as its suffix, and its last word might be spelled out behind its first ones.
                if n < (2 if size == 1 else LEAST) or size > 1 and (s[1:] not in self.states or s not in self.asked):
                    continue
                spelled, gain, likely = {}, 0.0, 0.0
                for w, c in follow[s].items():
                    tenths = min(255.0, float(np.round(-10 * np.log(self.p(s[1:], w)))))
                    most = min(n, self.grams[size][(*s[1:], w)] if size == 1 or (*s[1:], w) in self.asked else 0)
                    pays = lambda c: c >= 2 and c * (math.log(c / n) + tenths / 10) > price  # noqa: B023, E731
                    assert not pays(c) or pays(most)
                    if pays(most):
                        self.asked.add((*s, w))
                    if pays(c):
                        spelled[w] = c
                        gain += c * (math.log(c / n) + tenths / 10) - price
                        likely += math.exp(-tenths / 10)
                rest = n - sum(spelled.values())
                gain += rest * math.log(rest / n / max(1 - likely, 1e-12)) if rest else 0.0
                if spelled and gain > 0:
                    self.states[s] = n, spelled

    def p(self, s, w):
        """Probability of w behind s, from the longest suffix of s that is a state."""
        while s and s not in self.states:
            s = s[1:]
        if not s:
            return (self.grams[1][(w,)] + ADDED) / (self.n + ADDED * (self.v + 1))
        n, spelled = self.states[s]
        left = 1 - (sum(spelled.values()) - DISCOUNT * len(spelled)) / n
        return (spelled[w] - DISCOUNT) / n * (w in spelled) + left * self.p(s[1:], w) if w in spelled else left * self.p(s[1:], w)

    def score(self, text):
        d = words_of(text)
        total = 0.0
        for i, w in enumerate(d):
            # A state is only used behind shorter states, as they are what it was tested against.
            s = ()
            for size in range(1, min(i, self.depth) + 1):
                if tuple(d[i - size : i]) not in self.states:
                    break
                s = tuple(d[i - size : i])
            total += math.log10(self.p(s, w))
        return total


def corpus(seed, docs=60):
    rng = random.Random(seed)
    phrases = ["the big old house of Cards", "once upon a time there was", "Lorem ipsum dolor sit amet", "a b a b a c", "x " * 9]
    out = []
    for k in range(docs):
        parts = [rng.choice(phrases) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        out.append((k, rng.choice([" ", "\n", "\t "]).join(parts), k % 5 != 0))
    return [*out, (None, None, True), (7, "", False), (7, "unseen words only", None), (90, "the big old house " * 200, True)]


@pytest.mark.parametrize("depth, chunk_bytes, bucket_asks", [(2, 1 << 20, 1 << 19), (2, 300, 40), (3, 500, 100), (1, 2000, 30)])
def test_against_plain_tree(spark, depth, chunk_bytes, bucket_asks):
    rows = corpus(depth)
    plain = Plain([r[1] for r in rows if r[2]], depth)
    assert any(len(s) == min(depth, 2) for s in plain.states)
    found = score(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("train"), depth, chunk_bytes=chunk_bytes, bucket_asks=bucket_asks).collect()
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6))
    expected = [(r[0], bool(r[2]), len(words_of(r[1])), plain.score(r[1])) for r in rows]
    got = [(r.doc_id, r.train, r.n_tokens, r.score) for r in found]
    assert sorted(map(key, got)) == sorted(map(key, expected))
    base = {r[0]: sum(math.log10(plain.p((), w)) for w in words_of(r[1])) for r in rows if r[0] != 7}
    for r in found:
        assert r.train_tokens == plain.n
        if r.doc_id != 7:
            assert r.base_score == pytest.approx(base[r.doc_id], rel=1e-9)


def test_distributions_sum_to_one():
    """What the tree computes is what the plain one does (above); that one's distributions are whole."""
    plain = Plain([r[1] for r in corpus(2) if r[2]], 2)
    vocabulary = [g[0] for g in plain.grams[1]]
    assert len(plain.states) > 10
    for s in [(), *plain.states]:
        unknown = plain.p(s, "never seen")
        assert sum(plain.p(s, w) for w in vocabulary) + unknown == pytest.approx(1.0)


def test_nothing_to_learn_and_nothing_to_score(spark):
    found = score(spark.createDataFrame([(1, "a b", False), (2, None, None)], SCHEMA), F.col("train")).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found} == {(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)}
    assert score(spark.createDataFrame([], SCHEMA), F.col("train")).count() == 0


def test_one_word_and_one_long_text(spark):
    """A word that is nearly all of the corpus is spread over buckets; a text of a million words is one chunk."""
    rows = [(k, "same " * 3000 + f"w{k} w{k % 3}", True) for k in range(12)] + [(100, "long text " * 500_000, False)]
    found = {r.doc_id: r for r in score(spark.createDataFrame(rows, SCHEMA), F.col("train"), bucket_asks=500, chunk_bytes=1 << 16).collect()}
    assert len(found) == 13 and found[100].n_tokens == 1_000_001 and found[100].n_known == 1
    assert found[0].score > found[0].base_score


def test_packing():
    rng = np.random.default_rng(0)
    arrays = [rng.integers(0, 1 << 62, 50).astype(np.uint64), rng.random(50).astype(np.float16), np.arange(50, dtype=np.uint8)]
    for some in (arrays, [a[:0] for a in arrays]):
        for a, b in zip(some, unpack(pack(*some), np.uint64, np.float16, np.uint8), strict=True):
            assert np.array_equal(a, b)


def test_op12_base_and_gain(spark, sf):
    """The counted columns by hand, and held-out texts that the tree finds likelier than the root does."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, t in docs if i not in held for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in suffix_tree.op12_suffix_tree(spark, sf).collect()}
    assert len(found) == len(docs)
    for i, t in docs:
        words = words_of(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(words), sum(w in counts for w in words), n)
        assert r.base_score == pytest.approx(base)
    assert sum(found[i].score for i in held) > sum(found[i].base_score for i in held)
