"""Logistic head on character trigrams (T6 + M7 re-aimed, T7, T9).

A text's features are its trigram counts over their L2 norm, less the mean of the
training texts. The head is a multinomial logistic regression with an L2 penalty
(not on the intercepts), fitted from zero by a fixed number of accelerated
gradient steps on all training texts: a deterministic fit that SQL can follow step
by step, and true probabilities. The features are written once; every step sums the
slopes of all texts inside the tasks. The driver holds the grams and their weights,
and the features only if they are so few that steps there are cheaper than jobs. A fit on the first ``rows`` training texts in seeded
order remains for the queries whose SQL asks for it (``FIT_ROWS``).

The model is a table with one row per gram that holds the weights of all classes
in label order (the row of the empty gram holds the intercepts and the class
names), so scoring explodes a text by its distinct grams, which are counted inside
the tasks, not by grams x classes: one small join, one sum per class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.functions.frames import materialize, sized_batches
from sectio.functions.grams import gram_codes, with_gram_counts
from sectio.functions.ordering import seeded_key

SEED = 4220
FIT_ROWS = 4000
STEPS = 24
RATE = 2.0  # safe for centred features of length one at most
PENALTY = 1.0  # strength over the sum of the rows' losses
MODEL = "gram string, w array<double>, labels array<string>"
FEATURES = "y int, norm double, gram binary, n binary"  # of a text: gram numbers and counts, 32 bits each
BLOCK_BYTES = 4 << 20  # of gram numbers: a million features
LOCAL_FEATURES = 2_000_000  # up to here (16 MB) the steps run on the driver
SLOT_BYTES = 8 << 10  # sums that travel in one row

Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # class of each text; text, gram and value of each feature


def slopes(blocks: Iterable[Block], z: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Slopes of the summed log loss of all texts at the weights ``z`` (classes x
    grams) and the scores' ``shift``: by class and gram, in the last place by class."""
    classes, grams = z.shape
    out = np.zeros((classes, grams + 1))
    for y, row, gram, value in blocks:
        score = np.stack([np.bincount(row, value * z[c][gram], len(y)) + shift[c] for c in range(classes)])
        p = np.exp(score - score.max(0))
        rest = p / p.sum(0) - (y == np.arange(classes)[:, None])
        for c in range(classes):
            out[c, :-1] += np.bincount(gram, value * rest[c][row], grams)
            out[c, -1] += rest[c].sum()
    return out


def descend(slope: Callable[[np.ndarray, np.ndarray], np.ndarray], mean: np.ndarray, n: int, classes: int,
            steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights (grams x classes) and intercepts after ``steps`` of Nesterov's
    method on the mean log loss of ``n`` texts plus ``penalty / 2n`` squared weights.
    ``mean``: of each gram's feature; ``slope``: ``slopes`` of all texts."""
    w, z = np.zeros((classes, len(mean))), np.zeros((classes, len(mean)))
    b = zb = np.zeros(classes)
    for t in range(steps):
        found = slope(z, zb - z @ mean)
        new, rest = found[:, :-1], found[:, -1].copy()
        new -= rest[:, None] * mean  # in place: as large as the model
        new += penalty * z
        new *= -rate / n
        new += z
        newb = zb - rate * rest / n
        w -= new
        w *= -t / (t + 3)
        w += new
        w, z = new, w
        b, zb = newb, newb + t / (t + 3) * (newb - b)
    return w.T, b - w @ mean


def fit_steps(row: np.ndarray, gram: np.ndarray, value: np.ndarray, y: np.ndarray, grams: int, classes: int,
              steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """``descend`` for sparse features ``value[i]`` of text ``row[i]`` at ``gram[i]``."""
    return descend(lambda z, shift: slopes([(y, row, gram, value)], z, shift), np.bincount(gram, value, grams) / len(y), len(y), classes, steps, rate, penalty)


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value of ``sizes[i]`` bytes for each row, cut from ``values``."""
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column one after the other, and how many each row has."""
    col = col.cast(pa.binary())
    edges = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    size, width = int(edges[-1] - edges[0]), np.dtype(kind).itemsize
    return np.frombuffer(col.buffers()[2], kind, size // width, int(edges[0])) if size else np.empty(0, kind), np.diff(edges) // width


def features(counted: DataFrame, labels: list[str], codes: np.ndarray) -> DataFrame:
    """Texts with their class ``y``, gram counts ``g`` and their ``norm`` -> ``FEATURES``.
    ``codes``: those of all grams, rising; a gram's place among them is its number."""
    held = counted.sparkSession.sparkContext.broadcast(codes)
    numbered = counted.select((F.array_position(F.array(*map(F.lit, labels)), F.col("y")) - 1).cast("int").alias("y"), "norm", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "g", BLOCK_BYTES):
            lists = batch.column("g")
            sizes = 4 * lists.value_lengths().to_numpy()
            grams, n = lists.flatten().flatten()
            coded = grams.dictionary_encode()
            number = np.searchsorted(held.value, gram_codes(coded.dictionary)).astype(np.int32)
            own = [packed(x, sizes) for x in (number[coded.indices.to_numpy()], n.to_numpy().astype(np.int32))]
            yield pa.record_batch([batch.column("y"), batch.column("norm"), *own], ["y", "norm", "gram", "n"])

    return numbered.mapInArrow(run, FEATURES)


def blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in sized_batches(iter(batches), "gram", BLOCK_BYTES):
        gram, sizes = unpacked(batch.column("gram"), np.int32)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        yield batch.column("y").to_numpy(), row, gram, unpacked(batch.column("n"), np.int32)[0] / batch.column("norm").to_numpy()[row]


def spread_slopes(texts: DataFrame, z: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """``slopes`` of a table of ``FEATURES``: each task sums its own texts, then the
    tasks' sums are added up slot by slot, and only their total reaches the driver."""
    held = texts.sparkSession.sparkContext.broadcast((z, shift))
    width = max(1, SLOT_BYTES // (8 * len(shift)))  # grams of a slot
    places = z.shape[1] + 1
    slots = -(-places // width)

    def rows(found: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for some in iter(lambda: list(islice(found, 1024)), []):
            sums = np.stack([own for _, own in some])
            yield pa.record_batch([pa.array([s for s, _ in some], pa.int32()), packed(sums, np.full(len(some), sums[0].nbytes))], ["slot", "sums"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.pad(slopes(blocks_of(batches), *held.value), [(0, 0), (0, slots * width - places)])
        cut = ((s, own[:, s * width:(s + 1) * width]) for s in range(slots))
        yield from rows((s, x) for s, x in cut if x.any())

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, x in zip(batch.column("slot").to_pylist(), unpacked(batch.column("sums"), float)[0].reshape(batch.num_rows, -1)):
                sums[s] = sums[s] + x if s in sums else x.copy()
        yield from rows(iter(sums.items()))

    schema = "slot int, sums binary"
    out = np.zeros((len(shift), slots * width))
    for batch in texts.mapInArrow(part, schema).repartition("slot").mapInArrow(total, schema).toArrow().to_batches():
        for s, x in zip(batch.column("slot").to_pylist(), unpacked(batch.column("sums"), float)[0].reshape(batch.num_rows, len(shift), width)):
            out[:, s * width:(s + 1) * width] = x
    held.destroy()
    return out[:, :places]


def fit_head(train: DataFrame, key: str, text: str, cls: str, rows: int | None = None, seed: int = SEED, steps: int = STEPS,
             local: int = LOCAL_FEATURES) -> DataFrame:
    """The model's rows, fitted on all training texts, or on the first ``rows`` in
    seeded order of the (unique) ``key``. Texts without a class are left out, texts
    without trigrams (null, short) count with all features zero. Above ``local``
    features each step is a job."""
    held = train.where(F.col(cls).isNotNull()).select(F.col(key).alias("k"), F.col(cls).alias("y"), F.col(text).alias("t"))
    if rows is not None:
        # A top-n of a bounded n: every task keeps its first rows, the driver the first of those.
        held = held.orderBy(seeded_key(seed, F.col("k")), "k").limit(rows)
    counted = materialize(with_gram_counts(held.select("y", "t"), "t", "g", "norm").select("y", "g", "norm"))
    sizes = dict(map(tuple, counted.groupBy("y").count().collect()))
    if not sizes:
        raise ValueError("no labelled texts to fit on")
    labels, n = sorted(sizes), sum(sizes.values())
    spread = counted.select("norm", F.explode("g").alias("g")).groupBy("g.gram").agg(F.sum(F.col("g.n") / F.col("norm")).alias("s"), F.count(F.lit(1)).alias("m"))
    found = spread.toArrow()
    names = pa.concat_arrays(found.column("gram").chunks + [pa.array([], found.schema.field("gram").type)])
    codes = gram_codes(names)
    order = np.argsort(codes)
    mean = found.column("s").to_numpy()[order] / n
    texts = features(counted, labels, codes[order])
    if found.column("m").to_numpy().sum() <= local:
        near = list(blocks_of(texts.toArrow().to_batches()))
        w, b = descend(lambda z, shift: slopes(near, z, shift), mean, n, len(labels), steps)
    else:
        far = materialize(texts)
        w, b = descend(lambda z, shift: spread_slopes(far, z, shift), mean, n, len(labels), steps)
    every = np.concatenate([b[None], w]).ravel()
    table = pa.table({
        "gram": pa.chunked_array([pa.array([""], names.type), names.take(pa.array(order))]),
        "w": pa.ListArray.from_arrays(pa.array(np.arange(0, len(every) + 1, len(labels)), pa.int32()), pa.array(every)),
        "labels": pa.array([labels] + [None] * len(w), pa.list_(pa.string())),
    })
    return train.sparkSession.createDataFrame(table)


def score_texts(items: DataFrame, text: str, model: DataFrame) -> DataFrame:
    """Per distinct text: ``scores`` ARRAY<STRUCT<label, score>> with the
    probability of every class in label order (6 digits), ``label`` (the best,
    first on ties) and ``prob`` (its probability). A text without known grams has
    the probabilities of the intercepts."""
    head = model.where("gram = ''").first()
    classes = range(len(head.labels))
    texts = with_gram_counts(items.select(F.col(text).alias("__t")).distinct(), "__t", "__g", "__norm")
    own = texts.select("__t", "__norm", F.inline_outer("__g").alias("gram", "n"))
    known = model.where("gram <> ''").select("gram", *(F.col("w")[c].alias(f"__w{c}") for c in classes))
    sums = own.join(known, "gram", "left").groupBy("__t").agg(F.max("__norm").alias("__norm"), *(F.sum(F.col("n") * F.col(f"__w{c}")).alias(f"__w{c}") for c in classes))
    logit = F.array(*(F.lit(head.w[c]) + F.coalesce(F.col(f"__w{c}") / F.nullif(F.col("__norm"), F.lit(0.0)), F.lit(0.0)) for c in classes))
    t = sums.select("__t", logit.alias("__l"))
    t = t.select("__t", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))).alias("__e"))
    t = t.select("__t", "__e", F.aggregate("__e", F.lit(0.0), lambda a, x: a + x).alias("__sum"))
    scores = F.array(*(F.struct(F.lit(head.labels[c]).alias("label"), F.round(F.col("__e")[c] / F.col("__sum"), 6).alias("score")) for c in classes))
    t = t.select("__t", scores.alias("scores"))
    best = F.array_min(F.transform("scores", lambda x: F.struct((-x["score"]).alias("ns"), x["label"].alias("label"))))
    t = t.withColumn("label", best["label"]).withColumn("prob", -best["ns"])
    return t.withColumnRenamed("__t", text)


def classify_texts(items: DataFrame, text: str, model: DataFrame) -> DataFrame:
    """Attach ``label`` and ``prob`` of the text model to every item row."""
    s = score_texts(items, text, model).select(text, "label", "prob")
    return items.join(s, text)


def save(model: DataFrame, path: str) -> None:
    """K6: the model's rows as Parquet."""
    model.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
