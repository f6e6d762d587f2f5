"""Text vectors and similarity.

T6 is re-aimed: a text's vector is its character-trigram count vector
(lower case), kept sparse as rows (key, gram, n).

``best_similarity`` reads an inverted index over the known positives with a
score bound per list, list by list, until no positive that has not been met can
beat the best one so far (MaxScore); only those whose bound still reaches it get
an exact dot product. Where a candidate's lists are short in all, they are read in
full for many candidates at a time. Executors build the index in blocks of bounded size, which
are a table and never in the driver. Candidate texts are deduplicated before, so
a phrase that recurs across articles is scored once.

``pair_stats`` takes the self-product of the positives block by block; a task
keeps a histogram of its similarities, and only that leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectio.functions.frames import materialize, sized_batches, with_scalars
from sectio.functions.grams import SLICE_BYTES, count_slice
from sectio.functions.text import trigrams
from sectio.operators import encoders as EN

NEG_THRESHOLD = 0.85  # keep a candidate whose best similarity is at most this


def gram_vectors(df: DataFrame, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """Rows (key, keep..., gram, n, norm): trigram counts of the whole text
    and the vector's L2 norm. One shuffle: rows are clustered by key, so the
    (key, gram) count and the per-key norm window need no further exchange.
    A text without any trigram keeps one row with a null gram (norm null)."""
    k = list(keep or [])
    ex = df.select(key, *k, F.explode_outer(trigrams(F.col(text))).alias("gram")).repartition(key)
    counts = ex.groupBy(key, *k, "gram").agg(F.count("gram").alias("n"))
    w = Window.partitionBy(key)
    return counts.withColumn("norm", F.sqrt(F.sum(F.col("n") * F.col("n")).over(w))).withColumn(
        "n", F.when(F.col("gram").isNotNull(), F.col("n")))


def cosine_pairs(a: DataFrame, akey: str, b: DataFrame, bkey: str, ordered: bool = False) -> DataFrame:
    """(akey, bkey, cos) for every pair sharing at least one gram. With
    ``ordered`` (self-similarity) only pairs with akey < bkey. Inputs come
    from ``gram_vectors`` (norms carried on the rows)."""
    ra = a.where(F.col("gram").isNotNull()).select(F.col(akey).alias("__a"), "gram", F.col("n").alias("na"), F.col("norm").alias("norm_a"))
    rb = b.where(F.col("gram").isNotNull()).select(F.col(bkey).alias("__b"), "gram", F.col("n").alias("nb"), F.col("norm").alias("norm_b"))
    j = ra.join(rb, "gram")
    if ordered:
        j = j.where(F.col("__a") < F.col("__b"))
    dots = j.groupBy("__a", "__b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"),
                                       F.max("norm_a").alias("norm_a"), F.max("norm_b").alias("norm_b"))
    return dots.select(F.col("__a").alias(akey if akey != bkey else f"{akey}_a"),
                       F.col("__b").alias(bkey if akey != bkey else f"{bkey}_b"),
                       F.round(F.col("dot") / (F.col("norm_a") * F.col("norm_b")), 6).alias("cos"))


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Half-up rounding of non-negative numbers as Spark's ``round`` does it, on
    their shortest decimal form."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6).tolist():  # near a half
        out[i] = int(Decimal(repr(float(x[i]))).scaleb(digits).to_integral_value(ROUND_HALF_UP))
    return out / 10.0**digits


# Items of one side of a block of the self-product.
SIDE = 512


def _counts(grams: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Rows of gram lists -> (row, gram code, count) of their distinct grams in
    row order, and the grams that the codes stand for."""
    row = np.repeat(np.arange(len(grams)), np.diff(grams.offsets.to_numpy()))
    coded = grams.flatten().dictionary_encode()
    width = max(1, len(coded.dictionary))
    pair, n = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
    return pair // width, pair % width, n, coded.dictionary


def _block_histogram(table: pa.Table) -> pa.Table:
    """All pairs of a block's two sides (of one side, the pairs in order) ->
    distinct rounded cosines and how many pairs have each."""
    table = table.combine_chunks()
    side = table.column("side").to_numpy()
    row, gram, n, names = _counts(table.column("grams").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.string())))
    x = np.zeros((table.num_rows, max(1, len(names))))
    x[row, gram] = n
    norm = np.sqrt((x**2).sum(1))
    if table.column("own")[0].as_py():
        a, b = np.triu_indices(len(x), 1)
        cos = (x @ x.T)[a, b] / (norm[a] * norm[b])
    else:
        cos = ((x[side == 0] @ x[side == 1].T) / (norm[side == 0][:, None] * norm[side == 1][None, :])).ravel()
    value, freq = np.unique(rounded(cos), return_counts=True)
    return pa.table({"cos": pa.array(value, pa.float64()), "freq": pa.array(freq, pa.int64())})


def pair_histogram(items: DataFrame, key: str, text: str, side: int = SIDE) -> DataFrame:
    """(cos, freq): how many unordered pairs of items have each cosine (6
    digits). Items are dealt to blocks of about ``side``; each pair of blocks is
    one group of at most two blocks' items, whatever the grams they share. A text
    without trigrams is no item."""
    held = items.select(F.col(key).alias("k"), trigrams(F.col(text)).alias("grams")).where(F.size("grams") > 0)
    total = held.count()
    blocks = max(1, -(-total // side))
    own = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = held.select("grams", own.alias("b"), other.alias("o")).select(
        "grams", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"), (F.col("b") == F.col("o")).alias("own"))
    found = dealt.groupBy("i", "j").applyInArrow(_block_histogram, "cos double, freq long")
    return found.groupBy("cos").agg(F.sum("freq").alias("freq"))


def pair_stats(items: DataFrame, key: str, text: str, side: int = SIDE) -> DataFrame:
    """Number of items and of unordered pairs, minimum and median cosine
    over all pairs. Pairs are counted by value inside the tasks, so at most one
    row per task and distinct 6-digit similarity (about 10^6) is merged."""
    hist = materialize(pair_histogram(items, key, text, side))
    n = items.where(F.size(trigrams(F.col(text))) > 0).groupBy().agg(F.count(F.lit(1)).alias("n_items"))
    stats = hist.groupBy().agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("n_pairs"), F.min("cos").alias("min_sim"), F.percentile("cos", 0.5, F.col("freq")).alias("median_sim"))
    return with_scalars(n, stats).select("n_items", "n_pairs", F.round("min_sim", 6).alias("min_sim"), F.round("median_sim", 6).alias("median_sim"))


# Postings of one block of the index (24 bytes each: about 24 MB); candidates of one
# slice, and of a slice at least as many as a part of its block's postings, so that
# the copies of the index stay small beside the candidates.
BLOCK_POSTINGS = 1_000_000
SLICE_ROWS = 2_000
SLICE_SHARE = 20
CHUNK = 8
# A candidate whose lists hold fewer postings in all (with the positives, whose scores
# are a row) has them read in full, many candidates at a time: cheaper than bounds.
FULL_READ = 20_000
FULL_CHUNK = 1 << 20
SAFE = 1 + 1e-9  # room for sums in another order
INDEX = "vocab array<string>, starts binary, ids binary, counts binary, norms binary"


class PositiveIndex:
    """Inverted index of a block of positives: per gram the positives that hold
    it, their counts, and the largest weight (count over norm) of the list."""

    def __init__(self, vocab: pa.Array, starts: np.ndarray, ids: np.ndarray, counts: np.ndarray, norms: np.ndarray):
        self.vocab, self.starts, self.ids, self.counts, self.norms = vocab, starts, ids, counts, norms
        self.weights = counts / norms[ids]
        self.bounds = np.maximum.reduceat(self.weights, starts[:-1]) if len(ids) else np.zeros(0)
        # The same counts by positive, for exact dots.
        order = np.argsort(ids, kind="stable")
        self.own_gram = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[order]
        self.own_count = counts[order]
        self.own_start = np.searchsorted(ids[order], np.arange(len(norms) + 1))
        self.score, self.wanted = np.zeros(len(norms)), np.zeros(len(starts) - 1)

    @classmethod
    def build(cls, grams: pa.Array) -> PositiveIndex:
        row, gram, n, names = _counts(grams)
        order = np.argsort(gram, kind="stable")
        starts = np.searchsorted(gram[order], np.arange(len(names) + 1))
        norms = np.sqrt(np.bincount(row, n * n, len(grams)))
        return cls(names, starts, row[order], n[order], norms)

    def row(self) -> list:
        return [self.vocab.to_pylist(), self.starts.astype("<i8").tobytes(), self.ids.astype("<i4").tobytes(), self.counts.astype("<i4").tobytes(), self.norms.astype("<f8").tobytes()]

    @classmethod
    def of(cls, vocab: list[str], starts: bytes, ids: bytes, counts: bytes, norms: bytes) -> PositiveIndex:
        ints = lambda b, kind: np.frombuffer(b, kind).astype(np.int64)
        return cls(pa.array(vocab, pa.string()), ints(starts, "<i8"), ints(ids, "<i4"), ints(counts, "<i4"), np.frombuffer(norms, "<f8"))

    def dots(self, found: np.ndarray) -> np.ndarray:
        """Exact dots of the positives ``found`` with the counts in ``wanted``."""
        size = self.own_start[found + 1] - self.own_start[found]
        at = np.repeat(self.own_start[found] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(np.repeat(np.arange(len(found)), size), self.wanted[self.own_gram[at]] * self.own_count[at], len(found))

    def best_of_all(self, row: np.ndarray, gram: np.ndarray, n: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Highest cosine of each candidate to any positive by all its lists: its
        exact dots with all positives. ``row`` says whose grams they are."""
        size = self.starts[gram + 1] - self.starts[gram]
        at = np.repeat(self.starts[gram] - np.cumsum(size) + size, size) + np.arange(size.sum())
        place = np.repeat(row * len(self.norms), size) + self.ids[at]
        dots = np.bincount(place, np.repeat(n, size) * self.counts[at], len(norm) * len(self.norms)).reshape(len(norm), -1)
        return (dots / (np.maximum(norm, 1.0)[:, None] * self.norms)).max(1)  # no grams: all dots are zero

    def best_of(self, row: np.ndarray, gram: np.ndarray, n: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of many candidates, whose grams come in the order of ``row``. Those
        with few postings are taken together, without bounds."""
        rows = len(norm)
        value, read, dots = np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        edge = np.searchsorted(row, np.arange(rows + 1))
        total = np.concatenate([[0], np.cumsum(self.starts[gram + 1] - self.starts[gram])])
        postings = total[edge[1:]] - total[edge[:-1]]
        cost = postings + len(self.norms)
        few = cost <= FULL_READ
        read[few] = postings[few]
        own, mine = np.flatnonzero(few), few[row]
        at, gram_, n_ = (np.cumsum(few) - 1)[row[mine]], gram[mine], n[mine]
        part = np.cumsum(cost[own]) // FULL_CHUNK
        for lo, hi in zip(*(np.searchsorted(part, np.unique(part), side=s).tolist() for s in ("left", "right"))):
            a, b = np.searchsorted(at, [lo, hi]).tolist()
            value[own[lo:hi]] = self.best_of_all(at[a:b] - lo, gram_[a:b], n_[a:b], norm[own[lo:hi]])
        for i in np.flatnonzero(~few).tolist():
            a, b = edge[i], edge[i + 1]
            value[i], read[i], dots[i] = self.best(gram[a:b], n[a:b], norm[i])
        return value, read, dots

    def best(self, gram: np.ndarray, n: np.ndarray, norm: float) -> tuple[float, int, int]:
        """Highest cosine of a candidate (known grams with their counts, the norm
        of all) to any positive; how many postings were read, and how many exact
        dots were taken."""
        if not len(gram):
            return 0.0, 0, 0
        most = n * self.bounds[gram]
        size = self.starts[gram + 1] - self.starts[gram]
        # Lists that bound much by few entries are read first.
        order = np.argsort(-most / size, kind="stable")
        left = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0.0]]) * SAFE
        self.wanted[gram] = n
        high, met, i, dots, read = 0.0, [], 0, 0, 0

        def next_list() -> np.ndarray:
            g = gram[order[i]]
            own = self.ids[self.starts[g]:self.starts[g + 1]]
            self.score[own] += n[order[i]] * self.weights[self.starts[g]:self.starts[g + 1]]
            return own

        while i < len(order) and left[i] > high:  # a positive not met so far could still be the best
            own = next_list()
            high = max(high, float(self.score[own].max()))
            met.append(own)
            read, i = read + len(own), i + 1
        alive = np.unique(np.concatenate(met))
        touched = [alive]
        # The exact dots of those ahead raise what the others are held against.
        ahead = alive[np.argsort(-self.score[alive], kind="stable")[:CHUNK]]
        best = self.dots(ahead) / self.norms[ahead]
        dots, top = len(ahead), float(best.max())
        tried = set(ahead.tolist())
        alive = alive[(self.score[alive] + left[i]) * SAFE >= top]
        while i < len(order) and len(alive) > CHUNK:  # more lists leave fewer that can reach it
            touched.append(next_list())
            read, i = read + len(touched[-1]), i + 1
            alive = alive[(self.score[alive] + left[i]) * SAFE >= top]
        value = float((self.dots(ahead) / (norm * self.norms[ahead])).max())
        rest = np.array([p for p in alive.tolist() if p not in tried], np.int64)
        rest = rest[np.argsort(-self.score[rest], kind="stable")]
        for lo in range(0, len(rest), CHUNK):
            part = rest[lo:lo + CHUNK]
            if (self.score[part[0]] + left[i]) * SAFE < top:
                break
            exact = self.dots(part)
            dots += len(part)
            top = max(top, float((exact / self.norms[part]).max()))
            value = max(value, float((exact / (norm * self.norms[part])).max()))
        self.wanted[gram] = 0.0
        for own in touched:
            self.score[own] = 0.0
        return value, read, dots


def _index_rows(table: pa.Table) -> pa.Table:
    """The positives of a block -> one row, its index."""
    table = table.combine_chunks()
    made = PositiveIndex.build(table.column("grams").combine_chunks()).row()
    kinds = [pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), *(pa.array([v], k) for v, k in zip(made, kinds))], ["block", "vocab", "starts", "ids", "counts", "norms"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, slice), the index before its candidates -> the best
    cosine of each candidate in the block."""
    index = None
    for batch in batches:
        heads = np.flatnonzero(batch.column("t_null").is_null().to_numpy(zero_copy_only=False)).tolist()
        for a, b in zip([-1, *heads], [*heads, batch.num_rows]):
            if a >= 0:
                index = PositiveIndex.of(*(batch.column(c)[a].as_py() for c in ("vocab", "starts", "ids", "counts", "norms")))
            for own in sized_batches([batch.slice(a + 1, b - a - 1)], "g", SLICE_BYTES):
                row, gram, n, names = count_slice(own.column("g"))
                norm = np.sqrt(np.bincount(row, n * n, own.num_rows))
                known = pc.index_in(names, index.vocab).fill_null(-1).to_numpy(zero_copy_only=False)
                at = known[gram] if len(gram) else gram
                found = index.best_of(row[at >= 0], at[at >= 0], n[at >= 0], norm)
                yield pa.record_batch([own.column("t"), *map(pa.array, found)], ["t", "max_sim", "n_read", "n_dots"])


def positive_index(pos: DataFrame, ptext: str, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The index of the positives as a table of blocks, dealt by a hash of the
    text; equal positives are one."""
    held = pos.select(F.col(ptext).alias("p")).distinct().select("p", trigrams(F.col("p")).alias("grams")).where(F.size("grams") > 0)
    total = held.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // block_postings))
    dealt = held.select(F.pmod(F.xxhash64("p"), F.lit(blocks)).cast("int").alias("block"), "grams")
    return materialize(dealt.groupBy("block").applyInArrow(_index_rows, f"block int, {INDEX}"))


def best_similarity(cand: DataFrame, ctext: str, pos: DataFrame, pkey: str, ptext: str, block_postings: int = BLOCK_POSTINGS,
                    slice_rows: int = SLICE_ROWS, counters: bool = False) -> DataFrame:
    """For every distinct candidate text, its highest cosine to any positive
    (0 when it shares no gram with any). With ``counters`` also ``n_read``, the
    postings read, and ``n_dots``, the exact dots taken one by one.

    The positives are a stated query set. Candidates are dealt to slices by a
    hash of their text and go to every block of the index once; a slice's rows
    stream past one block at a time. Dots are integer sums and are divided by the
    same product of norms as in SQL; the quotient is rounded once, by Spark, so
    neither blocks nor slices change a value."""
    index = positive_index(pos, ptext, block_postings)
    texts = materialize(cand.select(F.col(ctext).alias("t")).distinct())
    blocks = sorted(r.block for r in index.select("block").collect())  # numbers of blocks only
    if not blocks:
        return texts.select(F.col("t").alias(ctext), F.lit(0.0).alias("max_sim"), *[F.lit(0).cast("long").alias(c) for c in ("n_read", "n_dots")] * counters)
    postings = index.agg(F.max(F.length("ids")) / 4).first()[0]
    slices = max(1, -(-texts.count() // max(slice_rows, int(postings) // SLICE_SHARE)))
    rows = texts.select("t", F.lower("t").alias("g"), F.lit(1).alias("t_null"),
                        F.pmod(F.xxhash64("t"), F.lit(slices)).cast("int").alias("slice"))
    rows = rows.select("*", F.explode(F.array(*(F.lit(b) for b in blocks))).alias("block"))
    heads = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    both = heads.unionByName(rows, allowMissingColumns=True)
    found = (both.repartition("block", "slice").sortWithinPartitions("block", "slice", F.col("t_null").asc_nulls_first())
             .mapInArrow(_search, "t string, max_sim double, n_read long, n_dots long"))
    merged = found.groupBy("t").agg(F.max("max_sim").alias("max_sim"), F.sum("n_read").alias("n_read"), F.sum("n_dots").alias("n_dots"))
    return merged.select(F.col("t").alias(ctext), F.round("max_sim", 6).alias("max_sim"), *["n_read", "n_dots"] * counters)


def negatives_by_similarity(cands: DataFrame, keys: list[str], text: str, pos: DataFrame, pkey: str, ptext: str,
                            threshold: float = NEG_THRESHOLD, encoder: EN.Encoder | None = None) -> DataFrame:
    """Candidate phrases (distinct per article) whose best
    similarity to the known positives is at most ``threshold``; by trigrams, or
    by the vectors of an ``encoder``."""
    c = cands.select(*keys, text).distinct()
    best = best_similarity(c, text, pos, pkey, ptext) if encoder is None else EN.best_similarity(c, text, pos, ptext, encoder)
    return c.join(best, text).where(F.col("max_sim") <= threshold)
