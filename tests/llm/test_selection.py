"""Mixing, host rules, classifiers and decontamination."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import rows_of, rows_of_sql

from clusterloom.llm import decontaminate, host_rules, registry, source_mix, subword_quality, toxic_compression
from clusterloom.llm.labelled import labelled_rows
from clusterloom.llm.tables import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Nulls in all columns, empty, blank and very long texts, ties, repeated rows, names of our own."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n", None, None, 3), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (4, long, "en", "b", len(long)), (5, "\u00e9 \U0001f600 x\x00y", "xx", "B", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("rate", "copy", "of_source", "n", "chosen", "rank", "score", "scored_text", "searched_text", "component_id"):
        frame = frame.withColumn(name, frame["doc_id"])
    return frame


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert rows_of(registry.queries()[name](spark, sf)) == rows_of_sql(sf, registry.oracle_sql()[name])


def test_mix_targets(spark):
    rows = [("a", 1000), ("b", 10), ("c", 500), (None, 40), ("d", 0)]
    got = {r.source: r.target for r in source_mix.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    sizes = dict(rows)
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(["a", "b", "c", "d", None])}
    target, open_sources, left = {}, set(sizes), sum(sizes.values())
    while True:  # reshare until no source is above its limit
        share = {s: left * weights[s] / sum(weights[x] for x in open_sources) for s in open_sources}
        above = {s for s in open_sources if share[s] > 3 * sizes[s]}
        if not above:
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        open_sources -= above
        left -= sum(3 * sizes[s] for s in above)
    target |= share
    assert {s: pytest.approx(t) for s, t in target.items()} == got


def test_mix_follows_targets(spark, sf):
    rows = source_mix.op2_source_mix(spark, "/root/testdata/sf0.1").collect()
    taken, target = {}, {}
    for r in rows:
        assert r.size <= 0 or r.taken % r.size == 0 and r.taken <= 3 * r.size
        key = (r.source_size, r.target)
        taken[key], target[key] = taken.get(key, 0) + r.taken, r.target
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))
    assert all(abs(taken[k] - target[k]) <= 0.2 * target[k] for k in target)


def test_mix_rows(spark):
    docs = odd_documents(spark)
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns
    planned = source_mix.plan_mix(docs).collect()
    assert mixed.count() == sum(r.copies for r in planned) and len(planned) == docs.count()
    assert source_mix.mix(docs.where("false")).count() == 0


def test_host_rules_edge_cases(spark):
    rows = [("w" * 10 + " a a a a a a",), ("x y z x y z",), (None,), ("",), ("a\na\n\n \na b",), ("|a| <b>",)]
    docs = spark.createDataFrame([(k, None if k % 2 else "s", t) for k, (t,) in enumerate(rows)], "doc_id long, source string, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in host_rules.judge(docs).collect()}
    assert got == {0: (7, 16, 0, 0, 6, True), 1: (6, 6, 0, 0, 6, True), 2: (0, 0, 0, 0, 0, True), 3: (0, 0, 0, 0, 0, True), 4: (4, 4, 0, 1, 0, True), 5: (2, 6, 4, 0, 0, True)}
    assert host_rules.judge(docs.where("false")).count() == 0
    assert host_rules.judge(odd_documents(spark)).count() == 7


def test_bad_host_is_rejected(spark):
    good = " ".join(f"word{k}" for k in range(80))
    bad = " ".join(f"word{k}###" for k in range(80))
    rows = [(k, "bad" if k % 2 else "good", bad if k % 2 and k > 20 else good) for k in range(400)]
    found = host_rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert all(r.kept == (r.source == "good") for r in found) and not any(r.base_failed for r in found)


def labelled(spark, target, folds, held):
    docs = table(spark, "/root/testdata/sf0.1", "documents").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").toPandas()
    out = np.array([zlib.crc32(str(i).encode()) % folds == held for i in docs.doc_id])
    return docs, docs[target].to_numpy(), out


def auc(y, s):
    rank = np.empty(len(s))
    rank[np.argsort(s, kind="stable")] = np.arange(len(s))
    return (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


def test_quality_held_out(spark):
    docs, y, held = labelled(spark, "quality", 4, 2)
    fitted = np.flatnonzero(~held)[:1500]
    model = subword_quality.fit(docs.text[fitted].tolist(), y[fitted])
    score = subword_quality.score(pa.array(docs.text[held]), model)
    assert auc(y[held], score) > 0.97 and (score[y[held] == 1] >= subword_quality.THRESHOLD).mean() > 0.98
    assert (score[y[held] == 0] < subword_quality.THRESHOLD).mean() > 0.9


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs, y, held = labelled(spark, "toxic", 3, 1)
    rows = np.flatnonzero(~held)
    return toxic_compression.fit(docs.text[rows].tolist(), y[rows], float(y[rows].mean()))


def test_toxic_held_out(spark, toxic_model):
    """Held-out documents at the threshold, by language; most toxic ones are English in the tables of this size."""
    docs, y, held = labelled(spark, "toxic", 3, 1)
    score, y, lang = toxic_compression.score(pa.array(docs.text[held]), toxic_model), y[held], docs.lang[held].to_numpy()
    hit, english = score >= toxic_compression.THRESHOLD, lang == "en"
    assert hit[english & (y == 1)].mean() > 0.85 and hit[y == 1].mean() > 0.5 and auc(y, score) > 0.82
    assert all(hit[(y == 0) & (lang == x)].mean() < 0.01 for x in set(lang))


def test_toxic_score_is_of_windows(spark, toxic_model):
    """The same words in another order, so in other company, mostly have another score (few bytes saved can be equal)."""
    docs, y, held = labelled(spark, "toxic", 3, 1)
    texts = [t for t in docs.text[held & (y == 1) & (docs.lang == "en").to_numpy()] if 100 < len(t.split()) < 500]
    rng = random.Random(4)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]
    one, other = (toxic_compression.score(pa.array(x), toxic_model) for x in (texts, mixed))
    assert len(texts) > 20 and (np.abs(one - other) > 1e-6).mean() > 0.5


def test_toxic_windows():
    texts = ["", None, "a", "A b c d e f g", " ".join(map(str, range(40)))]
    found = toxic_compression.windows(pa.array(texts), 4, 3)
    spelt = [bytes(found.data[a:z]).decode() for a, z in zip(found.start, found.stop)]
    assert spelt[:4] == [" a ", " a b c d ", " d e f g ", " 0 1 2 3 "] and found.owner.tolist()[:3] == [2, 3, 3]
    assert spelt[-1] == " 36 37 38 39 " and {w for x in spelt for w in x.split()} == {w for t in texts for w in (t or "").lower().split()}


@pytest.mark.parametrize("module", [subword_quality, toxic_compression])
def test_classifier_edge_cases(spark, module):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 1), (None, 0, 0), (4, 7, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        found = module.scored(docs, module.train(docs, labels), *docs.columns)
        assert found.columns[:-1] == docs.columns
        assert all(0 <= r[-1] <= 1 for r in found.collect()) and found.count() == 7
    assert module.scored(docs.where("false"), module.train(docs, none), "doc_id").count() == 0


def test_fits_read_whole_texts(spark):
    """Words of long rows count wherever they stand."""
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")

    def docs(word, at, n):
        rows = [(k, " ".join(word if k % 2 and i in at else f"r{k}w{i}" for i in range(n))) for k in range(60)]
        return spark.createDataFrame(rows, "doc_id long, text string")

    model = toxic_compression.train(docs("grawlix", range(5900, 6000, 7), 6000), labels)
    assert b"grawlix" in model.toxic and b"grawlix" not in model.ordinary
    one, other = (subword_quality.train(docs(w, range(60, 100), 3000), labels) for w in ("quokka", "wombat"))
    assert not np.array_equal(one.weight, other.weight)


def test_sample_is_bounded_under_repeats(spark):
    """A doc_id counts once, whatever its number of labels and documents."""
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(300)] + [(3, "a"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 3, k % 3 % 2) for k in range(60)] + [(3, 0), (3, 1), (4, 1), (None, 1)], "doc_id long, toxic int")
    found = labelled_rows(docs, labels, "toxic", 3, 99, 50).collect()
    assert sorted(map(tuple, found)) == [(0, "text 0", 0), (1, "text 1", 1), (2, "text 101", 0)]
    assert labelled_rows(docs, labels.where("doc_id < 3"), "toxic", 3, 99, 1).count() == 2


def test_wand_equals_scoring_all(spark, sf):
    rows = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    index = decontaminate.build(rows)
    rng = random.Random(1)
    for threshold in (0.1, 0.3, 0.5):
        for _ in range(60):
            item = rng.randrange(len(index.items))
            query = {t for t, x in enumerate(index.lists) if item in x[0] and rng.random() < 0.7} | set(rng.sample(range(len(index.lists)), 50))
            scores = np.zeros(len(index.items))
            for t in query:
                scores[index.lists[t][0]] += index.lists[t][1]
            want = {k: pytest.approx(scores[k]) for k in np.flatnonzero(scores >= threshold - 1e-9).tolist()}
            assert dict(decontaminate.wand(index, sorted(query), threshold)) == want


def test_leaks_against_brute_force(spark, sf):
    """Every item in every document, by the shares of shingles in any place of the text."""
    found = {(r.doc_id, r.item_id) for r in decontaminate.op10_decontaminate(spark, sf).collect()}
    items = [(r.item_id, [decontaminate.terms_of(x) for x in decontaminate.split_item(r.text)]) for r in table(spark, sf, "benchmark").collect()]
    want = set()
    for r in table(spark, sf, "documents").collect():
        words = decontaminate.terms_of(r.text)
        there = {tuple(words[k : k + 3]) for k in range(len(words))}
        for item, (question, answer) in items:
            share = sum(tuple(question[k : k + 3]) in there for k in range(len(question) - 2)) / max(1, len(question) - 2)
            if share >= 0.6 and decontaminate.overlap(answer, words) >= 0.5:
                want.add((r.doc_id, item))
    assert want and found == want


def test_leaks_in_disguise(spark):
    item = "Which of these rivers flows through the old town of Marbach? It is the river Neckar, by all accounts known."
    words = [f"filler{k}" for k in range(1000)]
    rng = random.Random(2)
    hidden = " ".join(words[:500]) + " " + item.upper().replace(" ", "  ") + " " + " ".join(words[500:])
    quote = "the old town of Marbach " + " ".join(words)
    rows = [(1, hidden), (2, quote), (3, None), (4, ""), (None, item), (5, " ".join(rng.choice(words + item.split()) for _ in range(3000)))]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, searched_text int, score int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == [("1", 7), ("None", 7)]
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0 and decontaminate.drop_leaks(docs, bench.where("false")).count() == 6
    assert decontaminate.leaks(docs.where("false"), bench).count() == 0
    assert len(list(decontaminate.indexes(bench.unionByName(bench), most_bytes=1))) > 1


def test_several_indexes(spark, sf, monkeypatch):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    small = list(decontaminate.indexes(bench, most_bytes=3000))
    monkeypatch.setattr(decontaminate, "indexes", lambda b: iter(small))
    assert len(small) > 1 and {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == whole


def test_cuts_leave_results_alone(spark, sf, monkeypatch):
    """Items of one template, then a lone one, then others: a cut changes neither weights nor passages."""
    rng = random.Random(3)
    rows = [(k, f"In the year of the survey how many sheep grazed near farm{k} by the river? There were {k} sheep there.") for k in range(40)]
    rows += [(50, "Name the alloy of copper and tin. Bronze"), (51, " ".join(f"long{k}" for k in range(300)) + ". The end of it"), (52, "..."), (52, None)]
    rows += [(60 + k, " ".join(rng.choices([f"v{x}" for x in range(200)], k=20)) + f". Answer number{k} is given") for k in range(40)]
    bench = spark.createDataFrame(rows, "item_id long, text string")

    def weights(found):
        return {(x.items[i].item_id, t): w for x in found for t, each in zip(x.terms, x.lists, strict=True) for i, w in zip(*each[:2], strict=True)}

    whole, parts = (list(decontaminate.indexes(bench, most_bytes=n)) for n in (1 << 20, 600))
    assert len(whole) == 1 and len(parts) > 5 and {x.half for x in parts} == {whole[0].half}
    assert weights(whole) == weights(parts) == weights([decontaminate.build(rows)])
    texts = [text for _, text in rows if text]
    docs = [(k, " ".join(rng.choices([f"filler{x}" for x in range(99)], k=60) + [w for w in t.split() if rng.random() < 0.8])) for k, t in enumerate(texts * 4)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = [sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))]
    monkeypatch.setattr(decontaminate, "indexes", lambda b: iter(parts))
    found.append(sorted(map(tuple, decontaminate.leaks(docs, bench).collect())))
    assert found[0] and [x[:2] for x in found[0]] == [x[:2] for x in found[1]]
