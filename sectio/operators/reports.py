"""Report-table operators (Q1-Q8 building blocks)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.functions.labels import LABELS_EXCLUDE, NOT_OUTCOME, OUTCOME


def domain_actual_vs_predicted(od_preds: DataFrame, group: list[str] | None = None,
                               exclude: list[str] | None = None) -> DataFrame:
    """Q6: per domain, rows whose actual domain it is, rows predicted as it,
    and rows predicted correctly -- over rows the first stage called
    ``outcome``, resource-use domains and ``not outcome`` left out.

    Input columns: ``label`` (actual), ``predicted`` (stage 1),
    ``predicted_od`` (stage 2). Labels only ever predicted are dropped (left
    join from the actual side), missing predicted counts become 0.
    """
    g = list(group or [])
    excl = list(exclude if exclude is not None else LABELS_EXCLUDE) + [NOT_OUTCOME]
    pos = od_preds.where((~F.col("label").isin(excl) | F.col("label").isNull()) & (F.col("predicted") == OUTCOME))
    actual = pos.groupBy(*g, F.col("label").alias("domain")).agg(
        F.count(F.lit(1)).alias("actual"),
        F.count_if(F.col("predicted_od") == F.col("label")).alias("n_correct"),
    )
    predicted = pos.groupBy(*g, F.col("predicted_od").alias("domain")).agg(F.count(F.lit(1)).alias("predicted"))
    return (
        actual.join(predicted, g + ["domain"], "left")
        .select(
            *g,
            "domain",
            "actual",
            F.coalesce("predicted", F.lit(0)).cast("bigint").alias("predicted"),
            "n_correct",
            F.round(F.col("n_correct") / F.col("actual"), 6).alias("prop_correct"),
        )
        .orderBy(*g, F.desc("actual"), "domain")
    )
