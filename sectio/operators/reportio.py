"""Metric reports as JSON documents and back (K2/K3 sink format, S4/R5/R6
source side).

A report mixes data-dependent class keys holding objects with scalar keys and
count lists, e.g. {"outcome": {"precision": ...}, "accuracy": 0.9,
"AUROC": ..., "FP": [3, 5]}. Writing assembles that text per group row;
reading parses the top level as MAP<STRING,STRING> (nested values come back
as JSON text), then the class objects as MAP<STRING,DOUBLE> -- explode twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASS_METRICS = ["precision", "recall", "f1-score", "support"]


def _num(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def reports_json(report: DataFrame, scalars: DataFrame, group: list[str], count_cols: dict[str, list[str]]) -> DataFrame:
    """One JSON report per group. ``report``: group, target, precision,
    recall, f1_score, support (``classification_report`` rows; the
    'accuracy' row becomes a scalar). ``scalars``: group + scalar columns
    (their names are the keys). ``count_cols``: key -> columns of a list
    (e.g. FP -> [fp_o, fp_no])."""
    obj = F.to_json(F.struct(F.col("precision").alias("precision"), F.col("recall").alias("recall"),
                             F.col("f1_score").alias("f1-score"), F.col("support").alias("support")))
    entry = F.concat(F.lit('"'), F.col("target"), F.lit('": '), obj)
    classes = report.where(F.col("target") != "accuracy").groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("__cls"))
    acc = report.where(F.col("target") == "accuracy").select(*group, F.col("f1_score").alias("__acc"))
    s = scalars.join(classes, group).join(acc, group)
    parts = [F.col("__cls"), F.concat(F.lit('"accuracy": '), _num(F.col("__acc")))]
    for c in scalars.columns:
        if c in group or any(c in cols for cols in count_cols.values()):
            continue
        parts.append(F.concat(F.lit(f'"{c}": '), _num(F.col(c))))
    for key, cols in count_cols.items():
        parts.append(F.concat(F.lit(f'"{key}": '), F.to_json(F.array(*[F.col(x) for x in cols]))))
    return s.select(*group, F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("report"))


def flatten_reports(df: DataFrame, group: list[str], targets: list[str], scalar_keys: dict[str, str],
                    list_keys: dict[str, list[str]]) -> DataFrame:
    """One row per (group, target, metric) for the kept targets,
    with scalar keys (renamed) and list elements as columns on every row.
    A key missing from a report gives null (the union of differing report
    shapes)."""
    m = F.from_json(F.col("report"), "map<string,string>")
    d = df.select(*group, m.alias("m"))
    d = d.select(*group, "m", F.explode(F.filter(F.map_keys("m"), lambda k: k.isin(targets))).alias("target"))
    d = d.select(*group, "m", "target", F.explode(F.from_json(F.try_element_at("m", F.col("target")), "map<string,double>")).alias("metric", "score"))
    cols = [*group, "metric", "target", "score"]
    cols += [F.try_element_at("m", F.lit(k)).cast("double").alias(name) for k, name in scalar_keys.items()]
    for key, names in list_keys.items():
        arr = F.from_json(F.try_element_at("m", F.lit(key)), "array<bigint>")
        cols += [F.try_element_at(arr, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    return d.select(*cols)
