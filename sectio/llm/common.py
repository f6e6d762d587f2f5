"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sectio.functions.frames import carry, quoted, sized_batches, typed, unpack  # noqa: F401  for the operators here
from sectio.session import write_shared


_WRITTEN: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder."""
    out = write_shared(df)
    for made in _WRITTEN:
        made += out.inputFiles()[:1]
    return out


class scratch:
    """A block whose tables (those that ``cut`` writes) are deleted at its end;
    results that go on are written with ``keep``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def __enter__(self) -> scratch:
        _WRITTEN.append(self.made)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        return write_shared(df)

    def __exit__(self, *failed) -> None:
        _WRITTEN.remove(self.made)
        jvm = self.spark._jvm
        for name in self.made:
            folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One input table, read by Spark (any path that Spark can open)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def lean(run: Callable) -> Callable:
    """A task function that gives memory it has freed back to the system when it
    ends. Python workers live on between tasks, and an executor has several."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def ending(batches: Iterator[pa.RecordBatch], last: Callable[[], None]) -> Iterator[pa.RecordBatch]:
    """The same batches; ``last`` runs when they are over or given up."""
    try:
        yield from batches
    finally:
        last()


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b"" if v is None else v for v in col.cast(pa.binary()).to_pylist()]


def texts(col: pa.Array) -> list[str]:
    """Strings of an Arrow column; null counts as empty."""
    return ["" if v is None else v for v in col.to_pylist()]


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file; every machine has the package installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
