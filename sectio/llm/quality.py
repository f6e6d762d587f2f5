"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Every token (hashed to one of ``buckets``) has a sparse random index vector. A
token's word vector is the sum of the index vectors of its neighbours (two on
either side) over all documents: integer sums, so the result does not depend on
how rows are dealt out. A document is the mean and the spread of its tokens'
vectors, of index and word vectors alike. A two-layer network (tanh, logistic)
is fitted in numpy on a bounded sample of labelled documents; a temperature
fitted on rows it has not seen calibrates the probabilities.

Tokens are letter runs in lower case, digit runs, and runs of other signs; words
in capitals, and words equal to the one before, are tokens of their own kind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectio.llm.common import lean, sized_batches, texts

TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
BUCKETS = 1 << 14
DIMS = 32
BLOCK = 1 << 16
SHOUT, AGAIN, DIGITS = "<shout>", "<again>", "<digits>"


def kind(token: str) -> str:
    if token.isdigit():
        return DIGITS
    return SHOUT if len(token) > 1 and token.isupper() else token.lower()


def bucket(token: str) -> int:
    return zlib.crc32(kind(token).encode()) % BUCKETS


AGAIN_BUCKET = zlib.crc32(AGAIN.encode()) % BUCKETS


def index_vectors(seed: int = 5, nonzero: int = 4) -> np.ndarray:
    """A few +1 and -1 in each bucket's vector."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMS), np.int32)
    places = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :nonzero]
    np.put_along_axis(out, places, rng.choice([-1, 1], (BUCKETS, nonzero)), axis=1)
    return out


class Buckets(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[token] = b = bucket(token)
        return b


def token_buckets(text: str, known: Buckets) -> np.ndarray:
    tokens = TOKEN.findall(text)
    out = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    if len(out) > 1:
        same = np.flatnonzero(out[1:] == out[:-1]) + 1
        same = same[[tokens[i].lower() == tokens[i - 1].lower() and tokens[i][0].isalpha() for i in same.tolist()]] if len(same) else same
        out[same] = AGAIN_BUCKET
    return out


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sums of the neighbours' index vectors by bucket, over all rows of ``docs``.
    One row per bucket and task is shuffled; ``BUCKETS`` rows come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of four neighbours' entries fit in a byte.
        index, known = np.vstack([index_vectors(), np.zeros((1, DIMS), np.int32)]).astype(np.int8), Buckets()
        total = np.zeros((BUCKETS + 1, DIMS), np.int64)  # the last row parts documents
        held, size = [], 0
        gap = np.full(2, BUCKETS, np.int16)

        def add():
            ids = np.concatenate([gap, *held])
            for lo in range(0, len(ids), BLOCK):
                # Two tokens on either side of a block are neighbours too.
                near = index[ids[max(0, lo - 2):lo + BLOCK + 2]]
                around = np.zeros_like(near)
                for by in (1, 2):
                    around[by:] += near[:-by]
                    around[:-by] += near[by:]
                own = ids[lo:lo + BLOCK]
                order = np.argsort(own, kind="stable")  # 16-bit numbers: a radix sort
                own = own[order]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                total[own[first]] += np.add.reduceat(around[min(lo, 2) + order], first, axis=0, dtype=np.int32)

        for batch in sized_batches(batches, "text"):
            for t in texts(batch.column("text")):
                held += [token_buckets(t, known).astype(np.int16), gap]
                size += len(held[-2]) + 2
                if size >= BLOCK:
                    add()
                    held, size = [], 0
        if held:
            add()
        total = total[:BUCKETS]
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.record_batch([pa.array(rows), *(pa.array(total[rows, k]) for k in range(DIMS))], names)

    names = ["bucket", *(f"v{k}" for k in range(DIMS))]
    sums = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))
            .groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names[1:])).toPandas())
    out = np.zeros((BUCKETS, DIMS))
    out[sums.bucket.to_numpy(int)] = sums[names[1:]].to_numpy(float)
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the tokens' rows; zeros for no tokens."""
    width = vectors.shape[1]
    if not len(ids):
        return np.zeros(2 * width)
    places, counts = np.unique(ids, return_counts=True)
    own, share = vectors[places], counts / len(ids)
    mean = share @ own
    return np.concatenate([mean, np.sqrt(np.maximum(share @ own**2 - mean**2, 0))])


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, seed: int = 3, decay: float = 1e-4) -> Network:
    """Adam on the log loss in batches of 64; every fifth row is kept back for
    the temperature. Without rows the network says one half."""
    width = x.shape[1]
    rng = np.random.default_rng(seed)
    net = Network(np.zeros(width), np.ones(width), rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if not len(x):
        return net
    back = np.arange(len(x)) % 5 == 4
    xt, yt = x[~back], y[~back]
    net.shift, net.scale = xt.mean(0), xt.std(0) + 1e-6
    xt = (xt - net.shift) / net.scale
    par = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(xt))
        for lo in range(0, len(order), 64):
            own = order[lo:lo + 64]
            h = np.tanh(xt[own] @ par[0] + par[1])
            g = (1 / (1 + np.exp(-np.clip(h @ par[2] + par[3], -500, 500))) - yt[own]) / len(own)
            gh = g[:, None] * par[2] * (1 - h**2)
            grads = [xt[own].T @ gh + decay * par[0], gh.sum(0), h.T @ g + decay * par[2], np.array([g.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                par[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = par[0], par[1], par[2], float(par[3][0])
    if back.any():
        z, t = net.logit(x[back]), np.exp(np.linspace(-2, 3, 101))
        loss = [np.mean(np.logaddexp(0, z / s) - y[back] * z / s) for s in t]
        net.temperature = float(t[int(np.argmin(loss))])
    return net


def features(docs: DataFrame, vectors, text_col: str, columns: list[str]) -> DataFrame:
    """``columns`` and the pooled vector ``x`` (32-bit floats) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = vectors.value, Buckets()
        for batch in sized_batches(batches, "__text"):
            x = [pooled(token_buckets(t, known), table).astype("<f4").tobytes() for t in texts(batch.column("__text"))]
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(x, pa.binary())], [*columns, "x"])

    held = docs.select(*columns, F.col(text_col).cast("string").alias("__text"))
    return held.mapInArrow(lean(run), ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in columns) + ", x binary")


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold whose labels are never learned; a null id is outside it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.3,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``.

    Word vectors cover all documents. The network is fitted on up to ``sample``
    labelled documents outside the held-out fold, drawn by a hash of the id
    before any text is read for it.
    Null labels and labels without a document are left out; several labels of an
    id count as their mean, several documents of an id each count. Null and
    empty texts are scored from a zero vector. Without labels all scores are one
    half."""
    spark = docs.sparkSession
    table = np.hstack([word_vectors(docs, text_col), index_vectors()]).astype(np.float32)
    vectors = spark.sparkContext.broadcast(table)  # BUCKETS x 2 DIMS numbers: 4 MB
    known = (labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("double").alias("y")).where("__id is not null and y is not null")
             .groupBy("__id").agg(F.avg("y").alias("y")))
    open_docs = docs.where(F.col(id_col).isNotNull()).where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__t"))
    drawn = open_docs.select("__id").join(known, "__id").select("__id", "y").orderBy(F.xxhash64("__id"), "__id").limit(sample).distinct().toPandas()
    drawn = spark.createDataFrame(list(zip(drawn["__id"].tolist(), drawn["y"].tolist())), "__id long, y double")  # at most ``sample`` rows
    rows = (features(open_docs.join(F.broadcast(drawn), "__id"), vectors, "__t", ["__id", "y"]).select("y", "x", "__id", F.xxhash64("__id").alias("h"))
            .orderBy("h", "__id", "x").limit(sample).toPandas())
    x = np.stack([np.frombuffer(b, "<f4") for b in rows.x]).astype(float) if len(rows) else np.zeros((0, 4 * DIMS))
    net = spark.sparkContext.broadcast(fit_network(x, rows.y.to_numpy(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = vectors.value, Buckets()
        for batch in sized_batches(batches, "__text"):
            x = np.array([pooled(token_buckets(t, seen), own) for t in texts(batch.column("__text"))]).reshape(batch.num_rows, -1)
            yield pa.record_batch([batch.column("id"), batch.column("held_out"), pa.array(net.value.probability(x.astype("<f4").astype(float)))], ["id", "held_out", "score"])

    held = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("__text"))
    done = held.mapInArrow(lean(run), f"id {held.schema['id'].dataType.simpleString()}, held_out boolean, score double")
    return done.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
