"""Seeded, partition-independent ordering (design rule: md5 order, never rand()).

``hash_rank`` gives exactly ``row_number() over (partition by P order by
md5(seed|key), key)`` without a window over the whole partition group: rows
are bucketed by the first hex digits of the md5 (uniform by construction, so
no hot bucket even when one group holds a third of the rows), bucket sizes are
prefix-summed in a table of at most ``groups x 16^digits`` rows, and the final
``row_number`` runs per (group, bucket).

``hash_first`` keeps the first n rows of each group in that order without
ranking the others: the histogram of prefixes tells the bucket in which the n-th
row lies, that bucket alone is sorted, and the n-th row's place is the cut-off
that all rows are held against. Payload columns are neither shuffled nor sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectio.functions.frames import materialize, with_scalars

BUCKET_HEX_DIGITS = 4  # 65,536 buckets per group


def seeded_key(seed: int | str, key: Column) -> Column:
    """md5 of ``'<seed>|<key>'`` -- identical in Spark and DuckDB."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_rank(
    df: DataFrame,
    seed: int | str,
    key: str,
    partition_by: list[str] | None = None,
    rank_col: str = "rn",
    count_col: str | None = "n",
) -> DataFrame:
    """Append ``rank_col`` (1-based rank in seeded order within the group) and
    optionally ``count_col`` (group size)."""
    parts = list(partition_by or [])
    h = "__h"
    b = "__b"
    keyed = df.withColumn(h, seeded_key(seed, F.col(key))).withColumn(b, F.substring(h, 1, BUCKET_HEX_DIGITS))
    counts = keyed.groupBy(*parts, b).agg(F.count(F.lit(1)).alias("__c"))
    w_prev = Window.partitionBy(*parts).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__c").over(w_prev), F.lit(0)))
    if count_col:
        offsets = offsets.withColumn(count_col, F.sum("__c").over(Window.partitionBy(*parts)))
    offsets = offsets.drop("__c")
    # Without groups the offsets table has at most 16^digits rows: a proven
    # bound, so it is broadcast. With groups it grows with the group count and
    # AQE picks broadcast or shuffle join from the measured size.
    joined = keyed.join(F.broadcast(offsets) if not parts else offsets, on=parts + [b], how="inner")
    w = Window.partitionBy(*parts, b).orderBy(h, key)
    return joined.withColumn(rank_col, F.col("__off") + F.row_number().over(w)).drop(h, b, "__off")


def hash_cutoffs(keys: DataFrame, key: str, order: Callable[[Column], Column], n: int | DataFrame, parts: list[str]) -> DataFrame:
    """One row per group (one in all without ``parts``): ``__all`` says that the
    group has at most n rows, else ``__cut`` is the place ``(hash, key)`` of its
    n-th row; null if n is zero. ``n`` is a number or a table of the group's
    columns and ``n``."""
    keyed = keys.select(*parts, key).withColumn("__h", order(F.col(key))).withColumn("__b", F.substring("__h", 1, BUCKET_HEX_DIGITS))
    counts = keyed.groupBy(*parts, "__b").agg(F.count(F.lit(1)).alias("__c"))
    up_to = Window.partitionBy(*parts).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("__up", F.sum("__c").over(up_to)).withColumn("__all", F.sum("__c").over(Window.partitionBy(*parts)))
    if isinstance(n, int):
        counts = counts.withColumn("__n", F.lit(n).cast("long"))
    elif parts:
        counts = counts.join(n.select(*parts, F.col("n").cast("long").alias("__n")), parts)
    else:
        counts = with_scalars(counts, n.agg(F.max("n").cast("long").alias("__n")))
    edge = counts.where((F.col("__up") >= F.col("__n")) & (F.col("__up") - F.col("__c") < F.col("__n")) & (F.col("__all") > F.col("__n")))
    edge = edge.select(*parts, "__b", (F.col("__n") - F.col("__up") + F.col("__c")).alias("__k"))
    # Without groups one row; with groups one a group, written so that its size is known.
    inside = keyed.join(materialize(edge) if parts else F.broadcast(edge), [*parts, "__b"])
    w = Window.partitionBy(*parts, "__b").orderBy("__h", key)
    cuts = inside.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == F.col("__k")).select(*parts, F.struct("__h", F.col(key).alias("__key")).alias("__cut"))
    sizes = counts.groupBy(*parts).agg((F.max("__all") <= F.max("__n")).alias("__all"))
    return sizes.join(cuts, parts, "left") if parts else with_scalars(sizes, cuts.agg(F.max("__cut").alias("__cut")))


def hash_first(df: DataFrame, seed: int | str, key: str, n: int | DataFrame, partition_by: list[str] | None = None,
               order: Callable[[Column], Column] | None = None) -> DataFrame:
    """The first ``n`` rows of each group in seeded order (all, if there are
    fewer); ``key`` is unique in its group. ``n`` may be a table with a number
    ``n`` for each group; a group without one, or a null group, has none. ``order``
    may give another hash, as a hex string."""
    parts = list(partition_by or [])
    order = order or (lambda k: seeded_key(seed, k))
    cuts = hash_cutoffs(df, key, order, n, parts)
    # The cut-offs are written, too: a small table goes to the rows, not the rows to their group.
    held = df.join(materialize(cuts), parts) if parts else with_scalars(df, cuts.agg(F.max("__all").alias("__all"), F.max("__cut").alias("__cut")))
    here = F.struct(order(F.col(key)).alias("__h"), F.col(key).alias("__key"))
    return held.where(F.col("__all") | (here <= F.col("__cut"))).select(*df.columns)
