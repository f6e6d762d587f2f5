"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case; every run of other characters than letters
and digits is one space) and framed by spaces. An item leaks into a document if
some substring of the document is within the item's error budget, a share
``error_rate`` of its length, in edit distance. The item is split into budget
plus one pieces; by the pigeonhole principle one piece occurs unchanged, which
an Aho-Corasick automaton over the pieces of all items finds. A hit is verified
with Myers' bit-parallel distance on growing parts of the item: of two halves
with j and l pieces under j + l - 1 errors, one has fewer errors than pieces, so
a true match passes at every part on the way from its exact piece to the item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.llm.common import carry, lean, quoted, sized_batches, texts, typed, unpack

GAP = re.compile(r"[\W_]+")
ERROR_RATE = 0.08
BLOCK_CHARS = 4 << 20


# The same rule for one-byte characters, as a byte table.
NARROW = bytes(ord(GAP.sub(" ", chr(i).lower())) for i in range(256))


def normalise(text: str) -> str:
    """Framed by one space on either side; empty if there is nothing to compare."""
    try:
        body = b" ".join(text.encode("latin-1").translate(NARROW).split()).decode("latin-1")
    except UnicodeEncodeError:
        body = GAP.sub(" ", text.lower()).strip()
    return f" {body} " if body else ""


def budget(item: str, error_rate: float) -> int:
    return int(len(item) * error_rate)


def edges(item: str, errors: int) -> list[int]:
    """Edges of ``errors + 1`` consecutive pieces, as even as can be."""
    n = min(errors, len(item) - 1) + 1
    return [i * len(item) // n for i in range(n + 1)]


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and a substring of ``text``, and
    where the first such substring ends. Columns of the distance matrix are kept
    as bit vectors of their vertical steps up and down."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, now = full, 0, size
    best, end = size, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise = down | (full & ~(diagonal | up))
        fall = up & diagonal
        if rise & top:
            now += 1
        elif fall & top:
            now -= 1
            if now < best:
                best, end = now, i
        rise, fall = rise << 1 & full, fall << 1 & full
        up = fall | (full & ~(diagonal | rise))
        down = rise & diagonal
    return best, end


class Part:
    """A run of an item's pieces, to be found with fewer errors than pieces."""

    def __init__(self, item: str, edges: list[int], parent: Part | None):
        self.start, self.end, self.errors, self.parent = edges[0], edges[-1], len(edges) - 2, parent
        self.size = self.end - self.start
        self.masks = letter_masks(item[self.start:self.end])

    def near(self, body: str, diagonal: int) -> tuple[int, int]:
        """Least distance, and where the match ends, around a diagonal of ``body``."""
        begin = max(0, diagonal + self.start - self.errors)
        d, end = myers(self.masks, self.size, body[begin:diagonal + self.end + self.errors])
        return d, begin + end


def leaves(item: str, edges: list[int], parent: Part | None) -> list[tuple[int, str, Part | None]]:
    """Place, text and parent part of each piece between ``edges``."""
    if len(edges) == 2:
        return [(edges[0], item[edges[0]:edges[1]], parent)]
    part, mid = Part(item, edges, parent), len(edges) // 2
    return leaves(item, edges[:mid + 1], part) + leaves(item, edges[mid:], part)


class Matcher:
    """Items of one block with their automaton."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(i, t, budget(t, error_rate)) for i, t in items]
        at: dict[str, list[tuple[int, int, Part | None]]] = {}
        for k, (_, t, errors) in enumerate(self.items):
            for place, piece, part in leaves(t, edges(t, errors), None):
                at.setdefault(piece, []).append((k, place, part))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def leaks(self, text: str) -> list[tuple[int, int, int]]:
        """``(item id, distance, end)`` of every item within its budget."""
        body = normalise(text)
        if not body or not self.items:
            return []
        best: dict[int, tuple[int, int]] = {}
        done: set[tuple[int, int]] = set()  # parts and diagonals that were tried
        for end, (size, where) in self.automaton.iter(body):
            for k, place, part in where:
                diagonal = end + 1 - size - place
                d, stop = 0, end + 1
                while part is not None:
                    key = (id(part), diagonal)
                    if key in done:
                        break
                    done.add(key)
                    d, stop = part.near(body, diagonal)
                    if d > part.errors:
                        break
                    part = part.parent
                else:
                    if k not in best or d < best[k][0]:
                        best[k] = (d, stop)
        return [(self.items[k][0], d, stop) for k, (d, stop) in best.items()]


def find_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and leaked item: id, item id, ``distance`` (the
    least), ``budget`` and ``match_end`` (in the normalised document).

    Null and empty texts and items without letters or digits match nothing; an
    item too short for one error must occur exactly, in whole words. Repeated
    rows give repeated results, one row per document row and item id. The items
    are a stated query set: they go to all documents in blocks of at most
    ``block_chars`` characters of item text, each block in its own scan."""
    if not 0 <= error_rate < 0.5:
        raise ValueError("error_rate must be at least 0 and below 0.5")
    spark = docs.sparkSession
    wanted = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null").distinct()
    total = wanted.agg(F.sum(F.length("t") + 64)).first()[0] or 0
    number = -(-total // block_chars) or 1
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = typed(held, ["id"], "item_id long, distance int, budget int, match_end long")
    out = None
    for b in range(number):
        own = wanted if number == 1 else wanted.where(F.pmod(F.xxhash64("t"), F.lit(number)) == b)
        block = sorted((r.i, n) for r in own.collect() if (n := normalise(r.t)) and r.i is not None)
        shared = spark.sparkContext.broadcast((block, error_rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in sized_batches(batches, "text"):
                rows, found = [], []
                for r, t in enumerate(texts(batch.column("text"))):
                    own = matcher.leaks(t)
                    rows += [r] * len(own)
                    found += own
                if rows:
                    limit = {i: e for i, _, e in matcher.items}
                    yield pa.record_batch([
                        batch.column("id").take(pa.array(rows, pa.int64())), pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.int32()), pa.array([limit[f[0]] for f in found], pa.int32()),
                        pa.array([f[2] for f in found], pa.int64())], ["id", "item_id", "distance", "budget", "match_end"])

        part = held.mapInArrow(lean(run), kind)
        out = part if out is None else out.union(part)
    return out.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "distance", "budget", "match_end")


def keep_clean(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``docs`` into which no item leaks; all columns stay."""
    row = carry(docs, docs.columns, text=quoted(text_col).cast("string"))
    wanted = items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").distinct()
    total = wanted.agg(F.sum(F.length("t") + 64)).first()[0] or 0
    number = -(-total // block_chars) or 1
    kind = row.schema
    for b in range(number):
        own = wanted if number == 1 else wanted.where(F.pmod(F.xxhash64("t"), F.lit(number)) == b)
        block = sorted((r.i or 0, n) for r in own.collect() if (n := normalise(r.t)))
        shared = row.sparkSession.sparkContext.broadcast((block, error_rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in sized_batches(batches, "text"):
                yield batch.filter(pa.array([not matcher.leaks(t) for t in texts(batch.column("text"))], pa.bool_()))

        row = row.mapInArrow(lean(run), kind)
    return unpack(row, docs.columns)
