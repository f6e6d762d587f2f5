"""Dataset operators over labelled rows: indicator join (J1), clean-up
(F6/F7), exclusion (P9), frequency filter (A10), top-n labels (O2),
one-vs-rest (P6), membership flag (P5) and corpus counts (A6/A7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectio.functions.labels import LABELS_EXCLUDE, NOT_OUTCOME, clean_label, one_vs_rest


def with_indicator(mapping: DataFrame, indicator: DataFrame, key: str = "study_id") -> DataFrame:
    """Left join to the distinct indicator rows (duplicates would fan out)."""
    return mapping.join(indicator.dropDuplicates(), key, "left")


def clean_labels(df: DataFrame, src: str = "domain", dst: str = "label") -> DataFrame:
    return df.withColumn(dst, clean_label(F.col(src)))


def exclude_labels(df: DataFrame, col: str = "label", exclude: list[str] | None = None) -> DataFrame:
    """Drop listed labels; a missing label is kept (pandas/R semantics,
    where SQL NOT IN alone would drop it)."""
    excl = LABELS_EXCLUDE if exclude is None else exclude
    return df.where(~F.col(col).isin(excl) | F.col(col).isNull())


def frequent_labels(df: DataFrame, col: str = "label", threshold: int = 25, strict: bool = False) -> DataFrame:
    """A10: keep rows whose label occurs at least ``threshold`` times
    (``strict``: more than). Missing labels are never kept. The label counts
    are one row per label and go to a semi join, which AQE broadcasts when
    small."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).count()
    keep = counts.where(F.col("count") > threshold if strict else F.col("count") >= threshold).select(col)
    return df.join(keep, col, "left_semi")


def top_labels(df: DataFrame, n: int, col: str = "label") -> DataFrame:
    """O2: the ``n`` most frequent labels; ties by label. A top-k report, so
    the limit is the feature."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(col))
        .limit(n)
        # n rows after the limit: the global window is bounded by n.
        .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(col))))
    )


def collapse_one_vs_rest(df: DataFrame, keep: str, col: str = "label", other: str = "Other outcome") -> DataFrame:
    return df.withColumn(col, one_vs_rest(F.col(col), keep, other))


def membership_flag(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """P5: flag rows whose key is in ``ids`` -- a left join to the distinct
    ids, not ``isin`` over a collected list."""
    marked = ids.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(marked, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def corpus_counts(df: DataFrame, study: str = "study_id", label: str = "label") -> DataFrame:
    """Number of studies, rows and outcome rows."""
    return df.agg(
        F.count_distinct(study).alias("n_studies"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(label) != NOT_OUTCOME).alias("n_outcomes"),
    )
