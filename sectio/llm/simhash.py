"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints are linked
if they differ in at most three bits; the smallest id of a connected component
names it.

Candidate keys. The fingerprint is cut into segments A, B, C of 22, 21 and 21
bits. A segment, padded to 23 bits, is decoded with the perfect binary Golay
code (23, 12, 7): its fuzzy keys are the indices of all codewords within
distance four (one key, or six). Words at distance two or less share a key,
because the codeword next to a word between them (distance one from both) lies
within four of both. With three errors over three segments:

* some segment is free of errors: one of the keys (A, fuzzy B), (B, fuzzy C),
  (C, fuzzy A) is shared -- if the fuzzy segment of the error-free one had three
  errors, the third segment would have none and its own key would apply;
* no segment is free of errors: each has exactly one, so one half of each is
  exact and one of the eight keys made of a half of A, of B and of C is shared.

Keys carry 32 to 34 bits, so chance buckets stay small, and every candidate is
verified on the 64 bits. Only distinct fingerprints are keyed, so a group of
exact copies is one row. A bucket above ``bucket_limit`` is dealt out again by
four more blocks of bits (three errors leave one of four blocks exact), level by
level; nothing is dropped. Buckets give spanning links, not all pairs.

Every joined side grows with the rows, so no join is a broadcast: a side that
shuffles to a few MB is ten times that as a hash table in the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectio.llm.common import carry, cut, lean, quoted, sized_batches, texts, unpack
from sectio.llm.components import components

MAX_BITS = 3
WORD = re.compile("[^ \t-\r]+")
# Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LOWER = {c: c + 32 for c in range(65, 91)}
# (offset, length) of the segments, low bit first, and where each is halved.
SEGMENTS = ((0, 22, 11), (22, 21, 10), (43, 21, 10))
LEVELS = 3


def word_shingles(text: str, size: int) -> list[str]:
    """Shingles of ``size`` words with repeats; the whole sequence if shorter."""
    words = WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower())
    if len(words) <= size:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(size)))))


def simhash(text: str, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint; zero for a text without words."""
    grams = word_shingles(text, size)
    if not grams:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # a very long text goes in blocks
        block = np.ascontiguousarray(h[at:at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` per row; ``fp`` is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            fps = np.array([simhash(t, size, seed) for t in texts(batch.column("text"))], np.uint64)
            yield pa.record_batch([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(lean(run), "id long, fp long"))


def golay_syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes, the message parts of all error patterns
    of weight four or less that lead to a codeword (padded by repeating the
    first), and how many there are (one or six)."""
    bits = 1 << np.arange(23)
    errors = [np.zeros(1, np.int64)]
    for _ in range(4):
        errors.append(np.unique((errors[-1][:, None] | bits[None, :]).ravel()))
    patterns = np.unique(np.concatenate(errors))
    found: list[list[int]] = [[] for _ in range(2048)]
    for p, s in zip(patterns.tolist(), golay_syndrome(patterns).tolist()):
        found[s].append(p >> 11)
    # (Two error patterns of one syndrome differ by a codeword, so their message parts differ.)
    lists = [list(dict.fromkeys(f)) for f in found]
    width = max(map(len, lists))
    table = np.array([f + [f[0]] * (width - len(f)) for f in lists], np.int64)
    return table, np.array([len(f) for f in lists])


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codeword indices of the fuzzy keys of 23-bit words."""
    table, number = golay_tables()
    s = golay_syndrome(words)
    keys = (words >> 11)[:, None] ^ table[s]
    real = np.arange(table.shape[1])[None, :] < number[s][:, None]
    return np.nonzero(real)[0], keys[real]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit bucket keys of unsigned fingerprints."""
    seg = [(fps >> np.uint64(o) & np.uint64((1 << n) - 1)).astype(np.int64) for o, n, _ in SEGMENTS]
    rows, keys = [], []
    for family in range(3):
        exact, fuzzy = seg[family], seg[(family + 1) % 3]
        r, k = golay_keys(fuzzy)
        rows.append(r)
        keys.append(np.int64(family) << 40 | exact[r] << 12 | k)
    halves = [(s & (1 << cut_at) - 1, s >> cut_at) for s, (_, _, cut_at) in zip(seg, SEGMENTS)]
    for pick in range(8):
        a, b, c = (halves[i][pick >> i & 1] for i in range(3))
        rows.append(np.arange(len(fps)))
        keys.append(np.int64(3 + pick) << 40 | a << 22 | b << 11 | c)
    return np.concatenate(rows), np.concatenate(keys)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _spanning(fps: np.ndarray, ids: np.ndarray, bits: int, block: int = 1024) -> list[tuple[int, int]]:
    """Links of a spanning forest of the within-``bits`` graph of one bucket;
    distances are taken against ``block`` members at a time."""
    left = np.arange(len(fps))
    links: list[tuple[int, int]] = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            hit = np.full(len(left), -1)
            for at in range(0, len(front), block):
                part = front[at:at + block]
                for lo in range(0, len(left), block):
                    near = _popcount(fps[left[lo:lo + block], None] ^ fps[None, part]) <= bits
                    got = near.any(axis=1) & (hit[lo:lo + block] < 0)
                    hit[lo:lo + block][got] = part[near.argmax(axis=1)[got]]
            new = hit >= 0
            links += zip(ids[left[new]].tolist(), ids[hit[new]].tolist())
            front, left = left[new], left[~new]
    return links


def _bucket_links(bits: int):
    """Sorted ``(key, fp, id)`` rows -> links of each bucket."""
    def of(key, fp, ids) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        a, b = [], []
        two = start[size == 2]
        near = two[_popcount(fp[two] ^ fp[two + 1]) <= bits]
        a.append(ids[near])
        b.append(ids[near + 1])
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            if links := _spanning(fp[s:s + n], ids[s:s + n], bits):
                x = np.array(links, np.int64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        return pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "id")]
            if not len(now[0]):
                continue
            rest.append(now)
            last = np.searchsorted(now[0], now[0][-1])  # rows of the last bucket may go on in the next batch
            if last == 0 and (len(rest) == 1 or rest[0][0][0] == now[0][0]):
                continue
            whole = [np.concatenate(c) for c in zip(*rest)]
            end = int(np.searchsorted(whole[0], whole[0][-1]))
            if end:
                yield of(*(c[:end] for c in whole))
            rest = [[c[end:] for c in whole]]
        if rest:
            yield of(*(np.concatenate(c) for c in zip(*rest)))

    return run


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        ids = batch.column("id").to_numpy()
        for at in range(0, len(fp), 1 << 15):
            rows, keys = bucket_keys(fp[at:at + (1 << 15)].view(np.uint64))
            rows = rows + at
            yield pa.record_batch([pa.array(keys), pa.array(fp[rows]), pa.array(ids[rows])], ["key", "fp", "id"])


def _finer_keys(rows: DataFrame, level: int) -> DataFrame:
    """Deal large buckets out by four blocks of 16 bits; the order of the bits
    is another one on each level."""
    order = np.random.default_rng(level).permutation(64)
    blocks = F.array(*(
        F.xxhash64("key", F.lit(j), F.col("fp").bitwiseAND(F.lit(int(sum(1 << int(b) for b in order[j::4]) + 2**63) % 2**64 - 2**63)))
        for j in range(4)))
    return rows.select(F.explode(blocks).alias("key"), "fp", "id")


def links(nodes: DataFrame, bits: int = MAX_BITS, bucket_limit: int = 512) -> DataFrame:
    """``nodes(id, fp)`` with distinct fingerprints -> links ``(a, b)`` that
    connect exactly the components of "differ in at most ``bits`` bits"."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"bits must be 0 to {MAX_BITS}")
    rows, out = nodes.select("fp", "id").mapInArrow(lean(_first_keys), "key long, fp long, id long"), None
    for level in range(LEVELS + 1):
        number = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = cut(rows.join(number.hint("merge"), "key"))
        fine = shared if level == LEVELS else shared.where(F.col("n") <= bucket_limit)
        found = (fine.select("key", "fp", "id").repartition("key").sortWithinPartitions("key")
                 .mapInArrow(lean(_bucket_links(bits)), "a long, b long"))
        out = found if out is None else out.union(found)
        large = shared.where(F.col("n") > bucket_limit)
        if level == LEVELS or large.isEmpty():
            return out
        rows = _finer_keys(large, level + 1)
    return out


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = MAX_BITS, seed: int = 42, bucket_limit: int = 512,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` (signed long) and
    ``component_id``, the smallest id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null id have a fingerprint but link to nothing (component null).
    Rows that repeat an id are linked through it. Other columns are ignored;
    an empty table gives no rows."""
    fps = cut(fingerprints(docs, size, seed, id_col, text_col))
    named = fps.where("id is not null")
    nodes = named.groupBy("fp").agg(F.min("id").alias("id"))
    # One id with several texts (repeated ids) ties their fingerprints together.
    same = (named.groupBy("id").agg(F.min("fp").alias("f1"), F.max("fp").alias("f2"), F.count(F.lit(1)).alias("n"))
            .where("n > 1 and f1 <> f2").select("id"))
    ties = named.join(same.hint("merge"), "id").join(nodes.withColumnRenamed("id", "root").hint("merge"), "fp").select(F.col("id").alias("a"), F.col("root").alias("b"))
    comp = components(links(nodes, bits, bucket_limit).union(ties))
    roots = nodes.join(comp.hint("merge"), nodes.id == comp.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return (fps.join(roots.hint("merge"), "fp", "left")
            .select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame, size: int = 3, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, all columns
    kept. Of rows that repeat an id, the first in the order of their columns
    stays; rows with a null id stay."""
    found = near_duplicates(docs, size, bits, id_col=id_col, text_col=text_col)
    found = found.select(F.col(id_col).alias("id"), "component_id").where("id is not null").groupBy("id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n"))
    marks = cut(found.where("id = c").select("id", "n"))
    rows = carry(docs, docs.columns, id=quoted(id_col).cast("long"))
    # The same join at every size: marks grow with the rows, and each text moves once.
    kept = rows.join(marks.hint("merge"), "id")
    order = Window.partitionBy("id").orderBy(*(F.col("rest").getField(f"f{i}").cast("string") for i in range(len(docs.columns))))
    again = kept.where("n > 1").withColumn("r", F.row_number().over(order)).where("r = 1").select("rest")
    return unpack(kept.where("n = 1").select("rest").union(again).union(rows.where("id is null").select("rest")), docs.columns)
