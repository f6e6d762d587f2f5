"""A user's own text encoder in place of character trigrams.

An ``Encoder`` names a function that loads a model in a worker and returns a
function from texts to vectors. Its model file travels with the job
(``addFile``), each Python worker loads it once, texts go through it in Arrow
slices of bounded bytes, and every vector's length is checked. Vectors are an
``array<double>`` column, which the nearest-centroid and logistic heads take, and
``best_similarity`` compares candidates with known positives by their cosine.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.functions.frames import carry, materialize, quoted, sized_batches, typed, unpack

SLICE_BYTES = 1 << 20
_LOADED: dict[tuple, Callable] = {}


@dataclass(frozen=True)
class Encoder:
    """``load`` gets the local path of ``file`` (None without one) and returns
    ``encode(texts) -> rows of dims numbers``."""

    name: str
    dims: int
    load: Callable[[str | None], Callable[[list[str]], object]]
    file: str | None = None

    def model(self) -> Callable[[list[str]], object]:
        """The loaded function, one per worker process."""
        key = (self.name, self.file)
        if key not in _LOADED:
            _LOADED[key] = self.load(SparkFiles.get(os.path.basename(self.file)) if self.file else None)
        return _LOADED[key]

    def vectors(self, texts: list[str]) -> np.ndarray:
        """One row a text; an error tells which encoder failed, and how."""
        try:
            out = np.asarray(self.model()(texts), dtype=float)
        except Exception as e:
            raise RuntimeError(f"encoder {self.name} failed on {len(texts)} texts: {type(e).__name__}: {e}") from e
        if out.shape != (len(texts), self.dims):
            raise ValueError(f"encoder {self.name} gave shape {out.shape}, not {(len(texts), self.dims)}")
        return out


def embed(df: DataFrame, text: str, encoder: Encoder, out: str = "v") -> DataFrame:
    """Add ``out``, the vector of each row's text (null for a null text); a column
    of that name is replaced. A slice's equal texts are encoded once."""
    if encoder.file:
        df.sparkSession.sparkContext.addFile(encoder.file)
    keep = [c for c in df.columns if c != out]
    held = carry(df, keep, t=quoted(text).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "t", SLICE_BYTES):
            coded = batch.column("t").dictionary_encode()
            names = coded.dictionary.to_pylist()
            x = encoder.vectors(names) if names else np.zeros((0, encoder.dims))
            at = coded.indices.to_pylist()
            yield pa.record_batch([batch.column("rest"), pa.array([None if i is None else x[i] for i in at], pa.list_(pa.float64()))], ["rest", "v"])

    return unpack(held.mapInArrow(run, typed(held, ["rest"], "v array<double>")), keep, F.col("v").alias(out))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x**2).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _rows(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def best_similarity(cand: DataFrame, ctext: str, pos: DataFrame, ptext: str, encoder: Encoder,
                    block_rows: int = 8192, slice_rows: int = 50_000) -> DataFrame:
    """(ctext, max_sim): for every distinct candidate text its highest cosine to
    any positive by the encoder's vectors (0 without a positive, for a null text and
    for zero vectors). Positives lie in blocks of a table, made by executors; each
    slice of candidates streams past one block at a time."""
    dims = encoder.dims
    held = embed(pos.select(F.col(ptext).alias("p")).where("p is not null").distinct(), "p", encoder)
    held = materialize(held)
    number = held.count()
    texts = materialize(embed(cand.select(F.col(ctext).alias("t")).distinct(), "t", encoder))
    if not number:
        return texts.select(F.col("t").alias(ctext), F.lit(0.0).alias("max_sim"))
    blocks, slices = -(-number // block_rows), max(1, -(-texts.count() // slice_rows))

    def pack(table: pa.Table) -> pa.Table:
        x = _unit(_rows(table.column("v").combine_chunks(), dims))
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([x.astype("<f8").tobytes()], pa.binary())], ["block", "x"])

    index = materialize(held.select(F.pmod(F.xxhash64("p"), F.lit(blocks)).cast("int").alias("block"), "v").groupBy("block").applyInArrow(pack, "block int, x binary"))
    there = sorted(r.block for r in index.select("block").collect())  # numbers of blocks only
    rows = texts.select("t", "v", F.lit(1).alias("row"), F.pmod(F.xxhash64("t"), F.lit(slices)).cast("int").alias("slice")).select(
        "*", F.explode(F.array(*(F.lit(b) for b in there))).alias("block"))
    both = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")).unionByName(rows, allowMissingColumns=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            heads = np.flatnonzero(batch.column("row").is_null().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([-1, *heads], [*heads, batch.num_rows]):
                if a >= 0:
                    known = np.frombuffer(batch.column("x")[a].as_py(), "<f8").reshape(-1, dims)
                own = batch.slice(a + 1, b - a - 1)
                if own.num_rows:
                    best = np.zeros(own.num_rows)
                    real = np.flatnonzero(own.column("v").is_valid().to_numpy(zero_copy_only=False))
                    x = _unit(_rows(own.column("v"), dims))
                    for lo in range(0, len(real), 512):
                        best[real[lo:lo + 512]] = (x[lo:lo + 512] @ known.T).max(axis=1)
                    yield pa.record_batch([own.column("t"), pa.array(best)], ["t", "max_sim"])

    found = both.repartition("block", "slice").sortWithinPartitions("block", "slice", F.col("row").asc_nulls_first()).mapInArrow(search, "t string, max_sim double")
    return found.groupBy("t").agg(F.max("max_sim").alias("max_sim")).select(F.col("t").alias(ctext), F.round("max_sim", 6).alias("max_sim"))
