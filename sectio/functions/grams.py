"""Trigrams counted inside the tasks: a row per text (or per key) with its distinct
trigrams and their counts, so that no row per occurrence is made, shuffled or
grouped. The grams are those of ``functions.text.trigrams``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectio.functions.frames import carry, sized_batches, typed, unpack

SLICE_BYTES = 4 << 20
_SHIFT = 21  # bits of a code point
GRAMS = pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())]))


def count_slice(texts: pa.Array, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased texts -> (group, gram code, count) of the distinct grams of each
    group (a text's own row by default; rising) in group order, and the grams that
    the codes stand for. A null text has none."""
    held = [t or "" for t in texts.to_pylist()]
    group = np.arange(len(held)) if group is None else group
    point = np.frombuffer("".join(held).encode("utf-32-le"), "<u4").astype(np.int64)
    size = np.fromiter(map(len, held), np.int64, len(held))
    windows = np.maximum(size - 2, 0)
    at = np.repeat(np.cumsum(size) - size - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    owner = np.repeat(group, windows)
    code = (point[at] << 2 * _SHIFT) | (point[at + 1] << _SHIFT) | point[at + 2] if len(at) else at
    # Java matches once more inside a surrogate pair, with a "?" for its second half.
    pairs = np.flatnonzero(point > 0xFFFF)
    if len(pairs):
        row = np.searchsorted(np.cumsum(size), pairs, side="right")
        inside = pairs + 2 < np.cumsum(size)[row]
        pairs, row = pairs[inside], row[inside]
        owner = np.concatenate([owner, group[row]])
        code = np.concatenate([code, (ord("?") << 2 * _SHIFT) | (point[pairs + 1] << _SHIFT) | point[pairs + 2]])
    coded = pa.array(code, pa.int64()).dictionary_encode()
    seen = coded.dictionary.to_numpy()
    width = max(1, len(seen))
    pair, n = np.unique(owner * width + coded.indices.to_numpy(), return_counts=True)
    mask = (1 << _SHIFT) - 1
    letters = np.stack([seen >> 2 * _SHIFT, (seen >> _SHIFT) & mask, seen & mask], 1).astype("<u4").tobytes().decode("utf-32-le")
    return pair // width, pair % width, n, pa.array([letters[i:i + 3] for i in range(0, len(letters), 3)], pa.string())


def gram_codes(names: pa.Array) -> np.ndarray:
    """The code of each gram: its three code points in one number."""
    point = np.frombuffer("".join(names.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64).reshape(-1, 3)
    return (point[:, 0] << 2 * _SHIFT) | (point[:, 1] << _SHIFT) | point[:, 2]


def gram_lists(group: np.ndarray, code: np.ndarray, n: np.ndarray, names: pa.Array, groups: int) -> pa.Array:
    """A list of (gram, n) for each of ``groups`` groups."""
    edges = np.searchsorted(group, np.arange(groups + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([names.take(pa.array(code)), pa.array(n, pa.int64())], fields=list(GRAMS.value_type)))


def with_gram_counts(df: DataFrame, text: str, out: str = "grams", norm: str = "norm") -> DataFrame:
    """Add ``out``, each text's distinct trigrams with their counts as an array of
    (gram, n), and ``norm``, the L2 norm of the counts."""
    keep = df.columns
    held = carry(df, keep, t=F.lower(F.col(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "t", SLICE_BYTES):
            row, code, n, names = count_slice(batch.column("t"))
            length = np.sqrt(np.bincount(row, n * n, batch.num_rows))
            yield pa.record_batch([batch.column("rest"), gram_lists(row, code, n, names, batch.num_rows), pa.array(length)], ["rest", "g", "norm"])

    counted = held.mapInArrow(run, typed(held, ["rest"], "g array<struct<gram:string,n:bigint>>, norm double"))
    return unpack(counted, keep, F.col("g").alias(out), F.col("norm").alias(norm))


def key_gram_counts(texts: DataFrame, key: str, text: str, out: str = "grams") -> DataFrame:
    """(key, out): a row per distinct key (null: one, too) with the trigram counts of
    all its texts as an array of (gram, n). A key's texts stream past one slice at a
    time; only its counts are held."""
    own = F.row_number().over(Window.partitionBy("k").orderBy("k")) == 1
    held = texts.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("t")).select("k", "t", own.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts = None, {}  # the key that the next slice may go on with

        def closed() -> Iterator[pa.RecordBatch]:
            if last is not None:
                yield pa.record_batch([last, pa.array([[{"gram": g, "n": n} for g, n in counts.items()]], GRAMS)], ["k", "g"])

        for batch in sized_batches(batches, "t", SLICE_BYTES):
            first = batch.column("first").to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(first)
            group, code, n, names = count_slice(batch.column("t"), np.cumsum(first))
            spelt = names.to_pylist()
            edge = np.searchsorted(group, [1, max(1, len(heads))]).tolist()  # the key held, whole keys, the last one
            for c, m in zip(code[:edge[0]].tolist(), n[:edge[0]].tolist()):
                counts[spelt[c]] = counts.get(spelt[c], 0) + m
            if not len(heads):
                continue
            yield from closed()
            if len(heads) > 1:
                whole = slice(*edge)
                yield pa.record_batch([batch.column("k").take(pa.array(heads[:-1])), gram_lists(group[whole] - 1, code[whole], n[whole], names, len(heads) - 1)], ["k", "g"])
            last = batch.column("k").slice(int(heads[-1]), 1)
            counts = {spelt[c]: m for c, m in zip(code[edge[1]:].tolist(), n[edge[1]:].tolist())}
        yield from closed()

    return held.mapInArrow(run, typed(held, ["k"], "g array<struct<gram:string,n:bigint>>")).select(F.col("k").alias(key), F.col("g").alias(out))
