"""Filter interaction audit: what each filter removes in every order of filters.

Five filters are applied to whole texts. A document is described by the set of
filters that it fails (a mask of five bits), so all that the orders can show
follows from counts per part and mask. Removing documents is a cooperative game:
the worth of a coalition of filters is the number of documents that fail at
least one of them. The Hart-Mas-Colell potential of that game is computed
recursively over the 32 coalitions,

    P(S) = (worth(S) + sum of P(S without i) over i in S) / |S|,

and a filter's Shapley value is ``P(all) - P(all without it)``. Differences of
worths between coalitions give the steps of every order.

Plan. One pass reads the texts and leaves a row of about 70 bytes a document. A
text equal to one of a smaller id is found by the hash of the whole text: rows
are counted per (text, part, mask, labels) with partial aggregation first, so a
text that a third of all documents share arrives as a few counts, and only the
rows that hold the smallest id are set apart. What reaches one task at the end
is at most 32 masks a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectio.llm.common import cut, lean, sized_batches, text_bytes

LETTERS = "ABCDE"
COPY = 16
COALITIONS = 1 << len(LETTERS)
REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")
NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)


@dataclass(frozen=True)
class Rules:
    """Failure conditions: A fewer words than ``min_words``; B less than
    ``distinct_percent`` of the words distinct; C more than ``capital_percent``
    of the code points in A-Z; D any character of ``signs`` (ASCII); E the text
    of a smaller id."""

    min_words: int = 50
    distinct_percent: int = 65
    capital_percent: int = 5
    signs: str = "#$%&*|"

    def mask(self, text: bytes) -> int:
        """Bits of A to D for one UTF-8 text; words end at ASCII white space."""
        words = text.split()
        points = len(text) - sum(map(text.count, CONTINUED)) if not text.isascii() else len(text)
        capitals = len(text.translate(None, NOT_CAPITAL))
        return ((len(words) < self.min_words) | (100 * len(set(words)) < self.distinct_percent * len(words)) << 1
                | (100 * capitals > self.capital_percent * points) << 2
                | any(s in text for s in self.signs.encode("ascii")) << 3)


CONTINUED = [bytes([b]) for b in range(0x80, 0xC0)]


def failures(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(id, part, mask, key)`` per row: the bits of A to D and the SHA-256 of
    the text. Null texts count as empty, a null part as the empty string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            body = text_bytes(batch.column("text"))
            yield pa.record_batch([
                batch.column("id"), batch.column("part"), pa.array([rules.mask(b) for b in body], pa.int32()),
                pa.array([hashlib.sha256(b).digest() for b in body], pa.binary())], ["id", "part", "mask", "key"])

    held = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(text_col).cast("string").alias("text"))
    return held.mapInArrow(lean(run), "id long, part string, mask int, key binary")


def label_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, good, toxic)`` of the ids with either label; several rows of an id
    count together."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("int")
    return (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
            .agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).where("good = 1 or toxic = 1"))


def mask_counts(failed: DataFrame, flags: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of a part that fail exactly
    the filters of the mask, bit 16 for copies of a smaller id's text, and how
    many of them carry the labels. A row without an id is no copy and makes
    none."""
    failed, one = cut(failed), F.count(F.lit(1))  # texts are read once, for rows with and without an id
    lone = failed.where("id is null").groupBy("part", "mask").agg(one.alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    # Rows that repeat an id with its text are one row with a count from here on.
    rows = failed.where("id is not null").groupBy("id", "key", "part", "mask").agg(one.alias("c")).join(flags, "id", "left")
    rows = rows.select("id", "key", "part", "mask", "c", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    cells = (rows.groupBy("key", "part", "mask", "good", "toxic").agg(F.sum("c").alias("n"), F.min(F.struct("id", "c")).alias("first"))
             .withColumn("lowest", F.min("first.id").over(Window.partitionBy("key"))))
    first = F.when(F.col("first.id") == F.col("lowest"), F.col("first.c")).otherwise(0)
    split = cells.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), first.alias("n")),
        F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), (F.col("n") - first).alias("n")))).alias("x"))
    known = split.where("x.n > 0").groupBy("part", "x.mask").agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))
    return lone.union(known).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def worths(counts: dict[int, int]) -> list[int]:
    """Worth of every coalition: documents whose mask meets it."""
    return [sum(n for mask, n in counts.items() if mask & s) for s in range(COALITIONS)]


def potentials(worth: list[int], scale: int = 120) -> list[int]:
    """Hart-Mas-Colell potential of every coalition, times ``scale``; with the
    120 orders of five filters as the scale all are whole numbers."""
    out = [0] * len(worth)
    for s in range(1, len(worth)):
        members = [1 << i for i in range(s.bit_length()) if s >> i & 1]
        out[s] = (scale * worth[s] + sum(out[s ^ m] for m in members)) // len(members)
    return out


def part_report(cells: list[dict]) -> list[tuple]:
    """600 rows (order, step, counts) of one part from its mask counts."""
    by = {c: worths({r["mask"]: r[c] for r in cells}) for c in ("n", "good", "toxic")}
    total, every = sum(r["n"] for r in cells), COALITIONS - 1
    potential = potentials(by["n"])
    out = []
    for order in permutations(range(len(LETTERS))):
        before, name = 0, "".join(LETTERS[i] for i in order)
        for step, i in enumerate(order, 1):
            bit = 1 << i
            gone = {c: w[before | bit] - w[before] for c, w in by.items()}
            out.append((name, step, total - by["n"][before | bit], gone["n"], by["n"][bit] - gone["n"],
                        by["n"][every] - by["n"][every ^ bit], gone["good"], gone["toxic"], potential[every] - potential[every ^ bit]))
            before |= bit
    return out


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in REPORT.split(", ")]
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
            rows = list(zip(*part_report(cells)))
            yield pa.record_batch([pa.array([part] * len(rows[0])), pa.array(rows[0]), pa.array(rows[1], pa.int32()),
                                   *(pa.array(c, pa.int64()) for c in rows[2:])], names)


def audit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """600 rows a part (120 orders of the filters, five steps): documents
    ``kept`` after the step and ``removed`` by it, ``redundant`` (fail its
    filter, gone before), ``unique_fails`` (fail its filter only), labelled good
    or toxic ones lost, and ``shapley``, the filter's removals summed over all
    orders.

    Null texts are empty, null parts the part ``""``; every row counts, also one
    that repeats an id (then it is no copy of itself) or has none. Labels
    without a document, null labels and null ids are ignored, several labels of
    an id count together. Other columns are ignored; an empty table gives no
    rows."""
    counts = mask_counts(failures(docs, rules, id_col, text_col, part_col), label_flags(labels, id_col))
    return (counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
            .mapInArrow(lean(_reports), REPORT))
