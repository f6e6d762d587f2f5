"""Small DataFrame helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, as a scalar
    subquery: it runs once and its value is a constant of the plan, so there is
    no join. More than one row is an error; an aggregate always has one."""
    held = df.withColumn("__scalars", scalars.select(F.struct(*scalars.columns)).scalar())
    return held.select(*df.columns, "__scalars.*")


def materialize(df: DataFrame) -> DataFrame:
    """Write a stage output that several consumers read (sections, phrases,
    mined negatives) as Parquet to the shared checkpoint folder and continue
    from it: computed once, lineage cut, readers take only their columns, and a
    lost executor re-reads files instead of recomputing the text pipeline."""
    from sectio.session import write_shared

    return write_shared(df)


def exact_mean(c, digits: int = 6):
    """Mean of values that are already rounded to ``digits`` decimals,
    computed on integers (units of 10^-digits) and rounded half-even, so the
    result does not depend on summation order (a mean of rounded values often
    lands exactly on a half)."""
    scale = 10 ** digits
    units = F.round(c * scale, 0)
    return F.bround(F.sum(units) / F.count(c), 0) / scale


def exact_mean_sql(x: str, digits: int = 6) -> str:
    scale = 10 ** digits
    return f"(round_even(sum(round({x} * {scale})) / count({x}), 0) / {scale})"


def quoted(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def carry(df: DataFrame, keep: list[str], **cols: Column) -> DataFrame:
    """The columns ``keep`` as one struct ``rest`` whose fields are numbered, and
    ``cols`` beside it: no name that the input has can meet one used here."""
    fields = [quoted(c).alias(f"f{i}") for i, c in enumerate(keep)] or [F.lit(0).alias("f0")]
    return df.select(F.struct(*fields).alias("rest"), *(c.alias(name) for name, c in cols.items()))


def unpack(df: DataFrame, keep: list[str], *added: str | Column) -> DataFrame:
    """The columns that ``carry`` took along, then ``added``."""
    return df.select(*(F.col("rest").getField(f"f{i}").alias(c) for i, c in enumerate(keep)), *added)


def typed(df: DataFrame, keep: list[str], added: str) -> StructType:
    """Schema of the columns ``keep`` of ``df``, as they are, and of ``added``
    (DDL text): types never pass through text, where names could break them."""
    return StructType([df.schema[c] for c in keep] + StructType.fromDDL(added).fields)


def sized_batches(batches: Iterator[pa.RecordBatch], col: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that one slice holds about ``limit`` bytes of
    ``col`` (one row at least): memory follows this, not Spark's row count."""
    for batch in batches:
        size = batch.column(col).nbytes
        rows = batch.num_rows
        if size <= limit or rows <= 1:
            if rows:
                yield batch
            continue
        step = max(1, int(rows * limit / size))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
