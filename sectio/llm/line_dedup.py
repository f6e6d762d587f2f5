"""Line dedup: lines found in many documents go, everywhere.

A line's key is the line without ASCII white space at both ends, A-Z in lower
case; keys travel as 128-bit hashes, lines never do.

1. Distinct keys are counted over all documents (a partial aggregate of hashes).
2. The distinct hashes are dealt to shards of about ``SHARD_KEYS``. Each shard is
   a minimal perfect hash (levels of bit arrays: a key rests on the first level
   on which it falls on a place alone, its number is the rank of that bit) over
   two compact arrays in the order of the numbers: fingerprints (64 bits) and
   document counts (32 bits, they stop at the largest value).
3. Keys in at least a ``HEAVY``-th of all (document, key) pairs are at most
   ``HEAVY`` in number, whatever the input; they get one small index of their
   own that every task has. Documents probe it in place, so a key of a third of
   all documents is never shuffled as such.
4. For other keys documents send 32 bytes a line to the key's shard, where they
   probe the arrays: a shuffle without a join of lines, in which no key has more
   than a ``HEAVY``-th of the rows. Keys found often enough go back, once to a text.
5. Texts meet the keys they lose by a hash of the row. Whether a key goes holds
   everywhere, so rows that share such a hash only share answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.llm.common import cut, lean, sized_batches, text_bytes, typed

SPACE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 13
HEAVY = 1 << 16
ROOM = 1.6
# Increment and multipliers of the splitmix64 mixing function.
GOLDEN = 0x9E3779B97F4A7C15
MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
INDEX = "sizes array<int>, bits binary, prints binary, counts binary"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def hashed(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """Hash of each line's key; ``None`` for keys under ``min_chars`` code points."""
    keys = map(line_key, lines)
    if min_chars <= 1:
        return [key_hash(k) if len(k) >= min_chars else None for k in keys]
    return [key_hash(k) if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars else None for k in keys]


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1 + h2 * np.uint64(2 * level + 1) + np.uint64(level * GOLDEN % 2**64)
    x = (x ^ x >> np.uint64(30)) * MIX[0]
    x = (x ^ x >> np.uint64(27)) * MIX[1]
    return ((x ^ x >> np.uint64(31)) % np.uint64(size)).astype(np.int64)


@dataclass
class LineIndex:
    """Minimal perfect hash over distinct 128-bit hashes, with a fingerprint and
    a count in the place of each."""

    sizes: list[int]
    bits: np.ndarray
    prints: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.rank = np.cumsum(self.bits, dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, number: np.ndarray) -> LineIndex:
        left, sizes, bits = np.arange(len(h1)), [], []
        while len(left):
            size = max(8, int(len(left) * ROOM))
            at = _place(h1[left], h2[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        out = cls(sizes, np.concatenate(bits) if bits else np.zeros(0, bool), np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.uint32))
        at = out.number(h1, h2)
        out.prints[at] = h1
        out.counts[at] = np.minimum(number, 2**32 - 1)
        return out

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Number of each key, 0 to n - 1; a key that was not built in may get
        the number of another one, or -1."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.start[level] + _place(h1[left], h2[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]] - 1
            left = left[~hit]
        return out

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents of each key; zero where the fingerprint differs."""
        at = self.number(h1, h2)
        if not len(self.counts):
            return np.zeros(len(at), np.uint32)
        return np.where((at >= 0) & (self.prints[at] == h1), self.counts[at], 0)

    def row(self) -> tuple:
        return self.sizes, np.packbits(self.bits).tobytes(), self.prints.tobytes(), self.counts.tobytes()

    @classmethod
    def of(cls, sizes: list[int], bits: bytes, prints: bytes, counts: bytes) -> LineIndex:
        return cls(sizes, np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool), np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32))


def _key_rows(min_chars: int):
    """Texts -> ``(h1, h2)`` of the distinct keys of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 2 << 20):
            held = []
            for body in text_bytes(batch.column("text")):
                held += set(hashed(body.split(b"\n"), min_chars)) - {None}
            h1, h2 = halves(held)
            yield pa.record_batch([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["h1", "h2"])

    return run


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> one row of arrays for each shard."""
    def one(shard: int, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        h1, h2, n = (np.concatenate(c) for c in zip(*parts))
        sizes, *body = LineIndex.build(h1.view(np.uint64), h2.view(np.uint64), n).row()
        return pa.record_batch([pa.array([shard]), pa.array([sizes], pa.list_(pa.int32())), *(pa.array([b], pa.binary()) for b in body)],
                               ["shard", "sizes", "bits", "prints", "counts"])

    now, held = None, []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cols = [batch.column(c).to_numpy() for c in ("h1", "h2", "n")]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]).tolist() if len(shard) else [0]
        for a, b in zip(edges, edges[1:]):
            if shard[a] != now and held:
                yield one(now, held)
                held = []
            now = int(shard[a])
            held.append([c[a:b] for c in cols])
    if held:
        yield one(now, held)


def _probe_rows(heavy, min_chars: int, shards: int):
    """``(carrier, text)`` -> keys that the index of frequent keys does not hold,
    with the shard of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex.of(*heavy.value)
        for batch in sized_batches(batches, "text", 2 << 20):
            held, of = [], []
            for i, body in enumerate(text_bytes(batch.column("text"))):
                own = set(hashed(body.split(b"\n"), min_chars)) - {None}
                held += own
                of += [i] * len(own)
            h1, h2 = halves(held)
            rest = index.count(h1, h2) == 0
            h1, h2, of = h1[rest].view(np.int64), h2[rest].view(np.int64), np.array(of, np.int64)[rest]
            yield pa.record_batch([pa.array(np.mod(h2, shards)), pa.array(batch.column("carrier").to_numpy()[of]), pa.array(h1), pa.array(h2)], ["shard", "carrier", "h1", "h2"])

    return run


def _answers(min_docs: int):
    """Rows sorted by shard, its arrays before its probes -> probes whose key has
    at least ``min_docs`` documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            heads = np.flatnonzero(~batch.column("probe").to_numpy(zero_copy_only=False))
            edges = np.concatenate([heads, [batch.num_rows]]).tolist()
            spans = [(0, edges[0])] if edges[0] else []
            for a, b in [*spans, *zip(edges, edges[1:])]:
                if a in edges[:-1]:
                    index = LineIndex.of(*(batch.column(c)[a].as_py() for c in ("sizes", "bits", "prints", "counts")))
                    a += 1
                if a < b:
                    own = batch.slice(a, b - a)
                    h1, h2 = (own.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
                    hit = np.flatnonzero(index.count(h1, h2) >= min_docs)
                    yield pa.record_batch([own.column(c).take(pa.array(hit)) for c in ("carrier", "h1", "h2")], ["carrier", "h1", "h2"])

    return run


def _strip(heavy, min_docs: int, min_chars: int):
    """``(id, text, lost)`` -> number of lines, lines dropped, text that stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex.of(*heavy.value)
        for batch in sized_batches(batches, "text", 2 << 20):
            number, dropped, kept = [], [], []
            for body, lost in zip(text_bytes(batch.column("text")), batch.column("lost").to_pylist()):
                lines = body.split(b"\n")
                hashes = hashed(lines, min_chars)
                own = [x for x in hashes if x is not None]
                gone = {x for x, c in zip(own, index.count(*halves(own)).tolist()) if c >= min_docs}
                gone |= {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in lost or ()}
                stay = [line for line, x in zip(lines, hashes) if x not in gone]
                number.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay).decode("utf-8", "replace"))
            yield pa.record_batch([batch.column("id"), pa.array(number, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "kept"])

    return run


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shard_keys: int = SHARD_KEYS, heavy: int = HEAVY,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_lines, n_dropped, kept)`` for every row: lines (split at ``\\n``)
    whose key has at least ``min_chars`` code points and stands in at least
    ``min_docs`` rows go, the others stay, joined by ``\\n``.

    Every row is a document, also one that repeats an id or has none; a key
    counts once a row. Null and empty texts are one empty line. Other columns
    are ignored; an empty table gives no rows. Keys are told apart by 128-bit
    hashes, and a probe of a key that the small index does not hold is refused
    by a 64-bit fingerprint."""
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars are at least 1")
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    body = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("carrier"))
    keys = body.select("text").mapInArrow(lean(_key_rows(min_chars)), "h1 long, h2 long")
    counts = cut(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")))
    size = counts.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).first()
    # At most ``heavy`` keys can have a ``heavy``-th of the pairs each.
    often = counts.where(F.col("n") >= max(min_docs, -(-size.pairs // heavy))).toPandas()
    common = spark.sparkContext.broadcast(LineIndex.build(*(often[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2")), often["n"].to_numpy(np.int64)).row())

    shards = max(1, -(-size.keys // shard_keys))
    arrays = (counts.withColumn("shard", F.pmod("h2", F.lit(shards))).repartition("shard").sortWithinPartitions("shard")
              .mapInArrow(lean(_shard_rows), f"shard long, {INDEX}"))
    probes = body.select("carrier", "text").mapInArrow(lean(_probe_rows(common, min_chars, shards)), "shard long, carrier long, h1 long, h2 long")
    both = arrays.withColumn("probe", F.lit(False)).unionByName(probes.withColumn("probe", F.lit(True)), allowMissingColumns=True)
    lost = (both.repartition("shard").sortWithinPartitions("shard", "probe").mapInArrow(lean(_answers(min_docs)), "carrier long, h1 long, h2 long")
            .distinct().groupBy("carrier").agg(F.collect_list(F.struct("h1", "h2")).alias("lost")))
    held = body.join(cut(lost), "carrier", "left").select("id", "text", "lost")
    done = held.mapInArrow(lean(_strip(common, min_docs, min_chars)), typed(held, ["id"], "n_lines long, n_dropped long, kept string"))
    return done.withColumnRenamed("id", id_col)
