"""Chat formatting: conversations rendered by a compiled template.

A turn is written as ``### role:``, a line break, the text and ``</turn>`` with a
line break. Inside texts every ``#``, ``<`` and backslash gets a backslash before
it (in roles also ``:``), so no text can hold a control string and the escape can
be undone. Assistant texts are marked as generated; that is the loss mask.

Rows of a conversation are brought together in order (turn, then role, then
text) by one shuffle and sort, and stream through the template one turn at a
time: a conversation of any length needs the memory of two turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.llm.common import lean
from sectio.llm.template import Template, as_messages

TEMPLATE = (
    "{% for message in messages %}### {{ message.role | protect('#<:') }}:\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | protect('#<') }}{% endgeneration %}"
    "{% else %}{{ message.text | protect('#<') }}{% endif %}"
    "</turn>\n{% endfor %}"
)
TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*):\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def read_back(pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, str, str, str]]:
    """Turns of a formatted conversation as ``(role, text, generated, raw)``, read
    from the output itself; at most a turn is held."""
    raw, mask = "", []
    for text, generated in pieces:
        if generated:
            mask.append(text)
        raw += text
        while raw.endswith("</turn>\n") and (m := TURN.match(raw)):
            yield unescape(m[1]), unescape(m[2]), unescape("".join(mask)), m[0]
            raw, mask = raw[m.end():], []
    if raw:
        raise ValueError("the output does not end with a turn")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))


def _sorted(conversations: DataFrame) -> DataFrame:
    return (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))


def render(conversations: DataFrame, template: str = TEMPLATE, part_chars: int = 1 << 20) -> DataFrame:
    """``(conv_id, part, formatted, loss_start, loss_end)``: each conversation's
    text in parts of about ``part_chars`` characters (most have one), and the
    ranges in the part that are generated.

    Null texts and roles count as empty; rows with a null conv_id form one
    conversation; turns that repeat are ordered by role, then text (nulls first).
    An empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Template(template)
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for conv, rows in groupby(_rows(batches), lambda r: r[0]):
            part, text, a, b, at = 0, [], [], [], 0

            def flush():
                return pa.record_batch([pa.array([v], k) for v, k in zip((conv, part, "".join(text), a, b), kinds)],
                                       ["conv_id", "part", "formatted", "loss_start", "loss_end"])

            for piece, generated in own.pieces(messages=as_messages((r, t) for _, r, t in rows)):
                if at >= part_chars:
                    yield flush()
                    part, text, a, b, at = part + 1, [], [], [], 0
                if generated and piece:
                    if b and b[-1] == at:
                        b[-1] = at + len(piece)
                    else:
                        a.append(at)
                        b.append(at + len(piece))
                text.append(piece)
                at += len(piece)
            yield flush()

    return _sorted(conversations).mapInArrow(lean(run), "conv_id long, part int, formatted string, loss_start array<long>, loss_end array<long>")


def digests(conversations: DataFrame) -> DataFrame:
    """Digest columns per conversation, read back from the formatted output."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = Template(TEMPLATE), []
        for conv, rows in groupby(_rows(batches), lambda r: r[0]):
            turns, loss, n, lost, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text, generated, raw in read_back(own.pieces(messages=as_messages((r, t) for _, r, t in rows))):
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(generated.encode())
                n, lost, chars = n + 1, lost + len(generated), chars + len(raw)
            out.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
            if len(out) >= 1024:
                yield table(out)
                out = []
        if out:
            yield table(out)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    table = lambda rows: pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
    return _sorted(conversations).mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
