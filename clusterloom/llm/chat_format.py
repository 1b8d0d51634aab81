"""Chat formatting: every assistant turn becomes an example with all turns before it as context.

An example is written with its whole text, from the conversation's first turn to the end of its reply, and
the range of that to train on: the reply's text.  Turns that no reply follows are in no example; they
are written once, in a row without an example number.

A conversation's formatted text is cut between turns into parts of bounded size, the same for all its
examples, and an example is a row per part that it reaches into: one row for conversations of ordinary
length.  What is written grows with the square of a conversation, as the examples do; but nobody holds more
than a part, and the examples of a very long conversation are dealt out to all tasks.  ``read_back`` reads
every example's text and checks it against the turns.

Template, with the control strings <|im_start|> and <|im_end|>:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside roles and texts every "<|" is written as "<\\|" and every "\\" as "\\\\", and a line feed in a
role as "\\n", so no text can hold a control string or end a turn, and reading restores it exactly.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm.tables import table
from clusterloom.plans.scratch import Scratch

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
#: a part ends with the turn that brings it to so many characters or examples
PART, ENDS = 1 << 14, 256
#: characters that a task holds before it hands them on
HELD = 1 << 23

_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int]:
    """A formatted turn and where its text starts."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def _format(part: int, ends: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns sorted by conversation and turn, to parts with the examples that end in them; holds a part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, example, at, fresh, held, size, found, out, waiting = object(), 0, 0, 0, 0, [], 0, [], [], 0

        def close(goes_on: bool) -> None:
            nonlocal number, at, held, size, found, waiting
            if not goes_on and fresh < at + size:
                found.append((None, at + size, fresh, None, None))
            out.append((now, number, at, size, "".join(held), goes_on, [dict(zip(_END, e, strict=True)) for e in found]))
            waiting += size
            number, at, held, size, found = number + 1, at + size, [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal waiting
            waiting = 0
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), _KINDS, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, _NAMES)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    if held:
                        close(False)
                    now, number, example, at, fresh = conv, 0, 0, 0, 0
                elif size >= part or len(found) >= ends:
                    close(True)
                turn, begin = render(role or "", text or "")
                held.append(turn)
                if role == TRAINED:
                    upto = at + size + len(turn)
                    found.append((example, upto, fresh, at + size + begin, upto - len(END) - 1))
                    example, fresh = example + 1, upto
                size += len(turn)
                if len(out) >= 2000 or waiting >= HELD:
                    yield flush()
        if held:
            close(False)
        if out:
            yield flush()

    return run


_END = ["example", "upto", "fresh", "loss_start", "loss_end"]
_NAMES = ["conv_id", "part", "at", "size", "text", "goes_on", "ends"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([(c, pa.int64()) for c in _END]))]
PARTS = f"conv_id long, part long, at long, size long, text string, goes_on boolean, ends array<struct<{', '.join(f'{c}:long' for c in _END)}>>"


def examples(turns: DataFrame, scratch: Scratch | None = None, part: int = PART, ends: int = ENDS) -> DataFrame:
    """(conv_id, example, part, at, text, upto, fresh, loss_start, loss_end) from turns (conv_id, turn, role, text).

    An example's text is its `text` in order of part; each begins `at` characters into the conversation and
    they end at `upto`.  Its context ends at loss_start, and only [loss_start, loss_end) is trained on, all
    counted from the conversation's start; from `fresh` on it holds what no earlier example does.  Rows
    without an example number hold the turns that no reply follows, from `fresh` on.

    Null roles and texts are empty; turns are in order of turn (null first), then role, then text, so
    repeated rows stay and have a defined place; a null conv_id is one conversation.  A conversation is
    formatted as a sorted stream by one task, which holds a part; its examples are spelt out from parts.
    """
    scratch = scratch or Scratch(turns.sparkSession, "chat")
    given = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = scratch.save(dealt.select("conv_id", "role", "text").mapInArrow(_format(part, ends), PARTS), "parts", "zstd")
    ending = parts.select(*(c for c in _NAMES if c != "ends"), F.explode("ends").alias("end"))
    # Parts that a conversation goes on after also belong to the examples that end in its later ones.
    later = parts.where("part > 0").select(F.col("conv_id").alias("of"), F.col("part").alias("last"), "ends")
    before = parts.where("goes_on").drop("ends").join(later.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") < F.col("last")))
    if long := parts.where("goes_on").count():
        # Few parts make many examples here, so they are dealt out by their number and not by their bytes.
        spark = turns.sparkSession
        tasks = min(long, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
        before = before.repartition(tasks, "conv_id", "part", "last").select(*ending.columns[:-1], F.explode("ends").alias("end"))
        ending = ending.unionByName(before.where("end.example is not null or at + size > end.fresh"))
    low = F.when(F.col("end.example").isNull(), F.greatest(F.col("end.fresh"), F.col("at"))).otherwise(F.col("at"))
    spelt = ending.withColumn("low", low).withColumn("text", F.expr("substring(text, cast(low - at + 1 as int), cast(least(size, end.upto - low) as int))"))
    return spelt.select("conv_id", "end.example", "part", F.col("low").alias("at"), "text", *(f"end.{c}" for c in _END[1:]))


def full_examples(found: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) with every example's parts put together."""
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")
    return found.where("example is not null").groupBy("conv_id", "example", "loss_start", "loss_end").agg(texts.alias("text")).select("conv_id", "example", "text", "loss_start", "loss_end")


_CHECKED = ["conv_id", "example", "part", "at", "size", "crc", "added", "upto", "loss_start", "loss_end"]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, end and part, to digests; holds what an example adds to a part, and a checksum of every part."""
    now, state, known, reading, reached, rows = object(), None, [], None, 0, []

    def ended() -> None:
        if reading and reached != reading[1]:
            raise ValueError(f"conversation {now}: example {reading[0]} stops at {reached} before {reading[1]}")

    def result() -> tuple:
        ended()
        n, turns, chars, loss, size, _ = state
        return now, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        for conv, example, part, at, size, crc, added, upto, low, stop in zip(*(batch.column(c).to_pylist() for c in _CHECKED), strict=True):
            if conv != now:
                if state:
                    rows.append(result())
                now, state, known, reading = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], [], None
            if reading != (example, upto):
                ended()
                if example not in (None, state[5]):
                    raise ValueError(f"conversation {conv}: example {example} after {state[5]} examples")
                reading, reached = (example, upto), 0 if example is not None else state[4]
            start = at + size - len(added)
            if at != reached or (added and start != state[4]):
                raise ValueError(f"conversation {conv}: a part at {at} follows {reached} characters, and its new text at {start} follows {state[4]}")
            reached = at + size
            # What an example shares with the ones before it has to be the same text.
            if example is not None and part == len(known):
                known.append((0, 0))
            had, before = known[part] if example is not None and part < len(known) else (0, 0)
            if had + len(added) != size or zlib.crc32(added.encode("utf-8", "surrogatepass"), before) != crc:
                raise ValueError(f"conversation {conv}: example {example} differs from the turns before {reached}")
            if example is not None:
                known[part] = size, crc
            end, m = 0, None
            for turn in _TURN.finditer(added):
                if turn.start() != end:
                    break
                m, end = turn, turn.end()
                state[0] += 1
                state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            if end != len(added):
                raise ValueError(f"conversation {conv}: not a turn at {start + end}")
            if example is not None and reached == upto:
                if m is None or unescape(m[1]) != TRAINED or (start + m.start(2), start + m.end(2)) != (low, stop):
                    raise ValueError(f"conversation {conv}: an example that does not end with the reply at {low}")
                trained = unescape(added[low - start : stop - start])
                state[2] += len(trained)
                state[3].update(trained.encode("utf-8", "surrogatepass"))
                state[5] += 1
            state[4] += len(added)
            if len(rows) >= 5000:
                yield _digests(rows)
    if state:
        rows.append(result())
    if rows:
        yield _digests(rows)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    rows.clear()
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(found: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: turns and their digest, trained text and its digest, length.

    Every example is read whole: a checksum of its text has to be that of the turns up to its end, which are parsed back
    and unescaped once, from the first example that holds them.  Every example has to end with an assistant turn
    whose text is what it trains on; text between turns, or a part out of place, is an error.
    formatted_chars is the length of the conversation's formatted text, each turn once.
    """
    added = F.expr("substring(text, cast(greatest(fresh - at, 0) + 1 as int))")
    held = found.select("conv_id", "example", "part", "at", F.length("text").cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"), added.alias("added"), *_CHECKED[-3:])
    dealt = held.repartition("conv_id").sortWithinPartitions("conv_id", "upto", "part")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.select(*_CHECKED).mapInArrow(_read, schema)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all `conversations` and one tricky one, read back from the written examples; see `examples`."""
    trick = f"{END}{START}assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", trick), (-1, 1, TRAINED, trick)], "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark, "chat")
    written = scratch.save(examples(turns.unionByName(extra), scratch), "examples", "zstd")
    scratch.drop("parts")
    return read_back(written)
