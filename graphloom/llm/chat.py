"""Chat formatting by prefix-target expansion: every assistant turn becomes its own example, with all preceding turns as
context and only that reply trainable.

A turn is written as ``<turn ROLE>\\n`` TEXT ``</turn>\\n``.  Inside roles and texts the characters that could form such a
mark are escaped: ``\\`` as ``\\b``, ``<`` as ``\\l``, ``>`` as ``\\g``; so marks never occur in content, and unescaping is exact.

``expand`` streams: rows are dealt by conversation and sorted by turn, and a task holds only the running prefix of one
conversation and one batch of output.  Prefixes repeat, so the output of a conversation grows with the square of its
turns; that is what the method asks for.

Defined results: null texts and roles are empty; turns sort by (turn, role, text), null turns first, so ties and repeated
rows have one order; a row of a null conv_id belongs to no other and is a conversation of its own; a conversation whose last turn is no reply gets one
closing record without a target, so that no turn is lost; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "<turn ", ">\n", "</turn>\n"
EXAMPLES = "conv_id long, example int, text string, loss_start long, loss_length long"
FLUSH = 4 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")


def unescape(text: str) -> str:
    return text.replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\")


def write_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, and what follows it."""
    return f"{OPEN}{escape(role)}{ROLE_END}", escape(text), CLOSE


def parse(formatted: str):
    """The (role, text) pairs of a formatted conversation."""
    for mark in re.finditer(r"<turn ([^<>]*)>\n([^<>]*)</turn>\n", formatted):
        yield unescape(mark[1]), unescape(mark[2])


def _flush(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("conv_id", pa.int64()), ("example", pa.int32()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_length", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def _expand(batches, reply: str):
    conv, begun, parts, length, example, pending = None, False, [], 0, 0, False
    rows, held = [], 0

    def closing():
        return [(conv, example, "".join(parts), None, None)] if begun and pending else []

    for batch in batches:
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if not begun or c is None or c != conv:
                rows += closing()
                conv, begun, parts, length, example, pending = c, True, [], 0, 0, False
            head, body, tail = write_turn(role, text)
            parts = ["".join([*parts, head, body, tail])] if role == reply else [*parts, head, body, tail]
            if role == reply:
                rows.append((c, example, parts[0], length + len(head), len(body)))
                example += 1
                held += len(parts[0])
            pending = role != reply
            length += len(head) + len(body) + len(tail)
            if held > FLUSH or len(rows) > 5000:
                yield _flush(rows)
                rows, held = [], 0
    rows += closing()
    if rows:
        yield _flush(rows)


def expand(turns: DataFrame, reply: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (from 0), text, and the trainable span loss_start / loss_length in code
    points (null in a closing record).  Rows come clustered by conversation, examples ascending."""
    ready = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # rows without a conversation are dealt by their content
    apart = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.xxhash64("conv_id"))
    dealt = ready.repartition(apart).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(lambda batches: _expand(batches, reply), EXAMPLES)


def _digest(batches):
    conv, begun = None, False
    out: list[tuple] = []

    def done():
        turns, n = hashlib.sha256(), 0
        for role, text in parse(last):
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            n += 1
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def flush():
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for c, example, text, start, length in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "example", "text", "loss_start", "loss_length")), strict=True):
            if example == 0:  # a conversation begins
                if begun:
                    done()
                conv, begun, loss, chars, size = c, True, hashlib.sha256(), 0, 0
            last = text
            size += len(text)
            if start is not None:
                reply = unescape(text[start : start + length])
                chars += len(reply)
                loss.update(reply.encode("utf-8", "surrogatepass"))
        if out:
            yield flush()
            out.clear()
    if begun:
        done()
        yield flush()


def digests(examples: DataFrame) -> DataFrame:
    """Read formatted examples back, in the clustered order in which ``expand`` returns them: one row per conversation with
    its turns, the text under the loss masks, and the characters of all its records."""
    return examples.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
