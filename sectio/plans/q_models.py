"""Step 0: nearest-centroid predictions, argmax, and the report's central
table (actual vs predicted domains)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.operators import classify, reports
from sectio.plans import fixtures as fx
from sectio.plans.oracle import compose
from sectio.plans.registry import query
from sectio.plans.stages import stage


def preds(spark, sf_dir, binary: bool = False) -> DataFrame:
    """Held-out predictions (stage output, materialized once)."""
    return stage(spark, sf_dir, f"preds_{'bin' if binary else 'multi'}",
                 lambda: classify.nearest_centroid(fx.class_embeddings(spark, sf_dir, binary=binary)))


def od_preds(spark, sf_dir) -> DataFrame:
    """Two-stage predictions per held-out vector and run: actual domain,
    stage-1 class, stage-2 domain (only on stage-1 positives)."""
    m = preds(spark, sf_dir).where(F.col("label") == F.col("y_pred"))
    b = preds(spark, sf_dir, binary=True).where(F.col("label") == F.col("y_pred"))
    first = m.select("vec_id", "run", F.col("y_true").alias("label")).join(
        b.select("vec_id", "run", F.col("y_pred").alias("predicted")), ["vec_id", "run"]
    )
    second = m.select("vec_id", "run", F.col("y_pred").alias("predicted_od"))
    return classify.two_stage_attach(first, second, ["vec_id", "run"])


@query("nearest_centroid", compose(["preds"], "SELECT vec_id, run, y_true, y_pred, label, score FROM preds"))
def q_nearest_centroid(spark, sf_dir):
    return preds(spark, sf_dir)


@query("argmax_label", compose(["preds"], """SELECT vec_id, run, label, score AS prob FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id, run ORDER BY score DESC, label) AS r FROM preds) q WHERE r = 1"""))
def q_argmax_label(spark, sf_dir):
    return classify.argmax_label(preds(spark, sf_dir), ["vec_id", "run"])


@query("two_stage_attach", compose(["od_preds"], "SELECT vec_id, run, label, predicted, predicted_od FROM od_preds"))
def q_two_stage_attach(spark, sf_dir):
    return od_preds(spark, sf_dir)


@query("domain_actual_vs_predicted", compose(["od_preds"], """
SELECT a.run, a.domain, CAST(a.actual AS BIGINT) AS actual, CAST(coalesce(p.predicted, 0) AS BIGINT) AS predicted,
       CAST(a.n_correct AS BIGINT) AS n_correct, round(a.n_correct / a.actual, 6) AS prop_correct
FROM act a LEFT JOIN prd p ON a.run = p.run AND a.domain = p.domain
ORDER BY a.run, a.actual DESC, a.domain""", local=[
    ("pos", """SELECT * FROM od_preds
    WHERE (label NOT IN ('Hospital', 'Need for further intervention', 'Economics', 'not outcome') OR label IS NULL)
      AND predicted = 'outcome'"""),
    ("act", """SELECT run, label AS domain, count(*) AS actual,
        count(*) FILTER (WHERE predicted_od = label) AS n_correct FROM pos GROUP BY run, label"""),
    ("prd", "SELECT run, predicted_od AS domain, count(*) AS predicted FROM pos GROUP BY run, predicted_od"),
]))
def q_domain_actual_vs_predicted(spark, sf_dir):
    return reports.domain_actual_vs_predicted(od_preds(spark, sf_dir), ["run"])
