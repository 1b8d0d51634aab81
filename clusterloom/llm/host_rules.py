"""Host-level quality rules, with DataFrame functions only.

Every document is measured; rule failures are counted per host (the column ``source``), the failure
rates are shrunk towards a beta prior fitted to all hosts, and the verdict on a host is joined back
to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm.tables import BLANK, WORD, table
from clusterloom.plans.scratch import Scratch

SYMBOLS = "#*$%&|<>"
#: base rule: fewer words than this fail
LEAST_WORDS = 50
#: base rule: a larger share (in percent) of words in repeated windows fails
MOST_REPEATED = 50
#: further rules that count against a host, in percent
MOST_SYMBOLS = 10
MOST_DUP_LINES = 30
#: a host whose shrunk failure rate of any rule exceeds this is rejected
HOST_RATE = 0.5
#: bounds of the prior's weight, in documents
PRIOR_WEIGHT = (1.0, 10000.0)
RULES = ("base", "symbols", "lines")


def _bind(value: Column, body) -> Column:
    """`body` of `value`, with `value` computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that the array holds twice or more.

    Windows are compared by a 64-bit hash chained over the three words.  Sorting brings equal ones
    together, so a text of n words takes n log n steps and no shuffle.
    """

    def covered(w: Column) -> Column:
        windows = F.transform(
            F.when(F.size(w) >= 3, F.sequence(F.lit(1), F.size(w) - 2)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i")),
        )
        twice = _bind(
            F.sort_array(windows),
            lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
        )
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            places,
            zero,
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n")),
            lambda acc: acc["n"],
        )

    return _bind(words, covered)


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed.

    A null text counts as empty: no words, and so it fails the base rule.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    found = docs.select(
        *keep,
        _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    found = found.select(
        *keep,
        F.col("w.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        F.col("l.n").alias("n_lines"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def _prior(n: float | None, hosts: float, fails: float, squares: float) -> tuple[float, float]:
    """Mean and weight of the beta prior; no documents: any prior does."""
    if not n:
        return 0.0, PRIOR_WEIGHT[0]
    m = fails / n
    v = squares / n - m * m - m * (1 - m) * hosts / n
    weight = m * (1 - m) / v - 1 if v > 0 else PRIOR_WEIGHT[1]
    return m, min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(source, n_docs, rate_<rule>..., host_ok), one row per host; null is a host of its own.

    The prior of a rule has the mean m of all documents and the weight m(1-m)/v - 1, where v is the
    variance of the hosts' rates, weighted by documents, beyond what sampling explains.  A rule that
    nobody or everybody fails keeps that rate.  All sums start as counts per host with map-side
    combine; the moments of all hosts are one row, which the driver reads.
    """
    fails = {
        "base": F.col("base_failed"),
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"),
    }
    hosts = measured.groupBy("source").agg(F.count("*").alias("n_docs"), *(F.count_if(x).alias(f"f_{k}") for k, x in fails.items()))
    moments = hosts.agg(
        F.sum("n_docs").cast("double").alias("n"),
        F.count("*").cast("double").alias("hosts"),
        *(F.sum(f"f_{k}").cast("double").alias(f"sum_{k}") for k in RULES),
        *(F.sum(F.col(f"f_{k}").cast("double") * F.col(f"f_{k}") / F.col("n_docs")).alias(f"sq_{k}") for k in RULES),
    )
    row = moments.first()
    out = ["source", "n_docs"]
    ok = F.lit(True)
    for k in RULES:
        m, weight = _prior(row["n"], row["hosts"], row[f"sum_{k}"], row[f"sq_{k}"])
        rate = (F.col(f"f_{k}") + m * weight) / (F.col("n_docs") + weight)
        out.append(rate.alias(f"rate_{k}"))
        ok = ok & (rate <= HOST_RATE)
    return hosts.select(*out, ok.alias("host_ok"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, source, text): the measures, base_failed and kept.

    The measures are written to the shared folder once (a few numbers per document), so the texts
    are read and split once for both the host counts and the result.  The join back is an equi-join
    on the host: AQE broadcasts the verdicts if they are small, else it splits a hot host.
    """
    measured = Scratch(docs.sparkSession, "host-rules").save(measure(docs, "doc_id", "source"), "measured")
    verdicts = host_verdicts(measured).select(F.col("source").alias("host"), "host_ok")
    joined = measured.join(verdicts, F.col("source").eqNullSafe(F.col("host")))
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("host", "host_ok")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdicts of every row of `documents`, whole texts; see `judge` for nulls and hosts."""
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rate(k: str) -> str:
    m, n = f"(sum_{k} / n)", "n"
    v = f"(sq_{k} / {n} - {m} * {m} - {m} * (1 - {m}) * hosts / {n})"
    weight = f"least(greatest(CASE WHEN {v} > 0 THEN {m} * (1 - {m}) / {v} - 1 ELSE {PRIOR_WEIGHT[1]} END, {PRIOR_WEIGHT[0]}), {PRIOR_WEIGHT[1]})"
    return f"(f_{k} + {m} * {weight}) / (n_docs + {weight})"


OP8_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM texts),
windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS t(d) GROUP BY rid),
measured AS (
  SELECT s.doc_id, s.source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (rid)),
judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM measured),
hosts AS (
  SELECT source, count(*) AS n_docs, count(*) FILTER (base_failed) AS f_base,
    count(*) FILTER (100 * n_symbols > {MOST_SYMBOLS} * word_chars) AS f_symbols,
    count(*) FILTER (100 * n_dup_lines > {MOST_DUP_LINES} * n_lines) AS f_lines FROM judged GROUP BY source),
moments AS (
  SELECT sum(n_docs)::DOUBLE AS n, count(*)::DOUBLE AS hosts,
    {", ".join(f"sum(f_{k})::DOUBLE AS sum_{k}, sum(f_{k}::DOUBLE * f_{k} / n_docs) AS sq_{k}" for k in RULES)} FROM hosts),
verdicts AS (
  SELECT source, {" AND ".join(f"{_rate(k)} <= {HOST_RATE}" for k in RULES)} AS host_ok FROM hosts, moments)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""
