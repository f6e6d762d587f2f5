"""Step 3: metrics over the nearest-centroid predictions, grouped by run."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectio.functions.labels import LABELS_EXCLUDE, NOT_OUTCOME, OUTCOME
from sectio.operators import metrics as M
from sectio.plans import fixtures as fx
from sectio.plans.oracle import compose, register
from sectio.plans.q_models import od_preds, preds
from sectio.plans.q_sizes import size_counts, size_preds
from sectio.plans.registry import query
from sectio.plans.stages import stage

G = ["run"]

register("p1", ["preds"], "SELECT DISTINCT vec_id, run, y_true, y_pred FROM preds")
register("b1", ["preds_bin"], "SELECT DISTINCT vec_id, run, y_true, y_pred FROM preds_bin")
register("bs", ["preds_bin"], f"SELECT vec_id, run, y_true, score FROM preds_bin WHERE label = '{OUTCOME}'")


def one(df):
    return df.where(F.col("label") == F.col("y_pred")).select("vec_id", "run", "y_true", "y_pred")


def bin_scores(spark, sf_dir):
    return preds(spark, sf_dir, binary=True).where(F.col("label") == OUTCOME).select("vec_id", "run", "y_true", "score")


def model_labels(long_df):
    return long_df.select("run", "label").distinct()


def report_sql(src: str, g: str = "run") -> str:
    """DuckDB twin of ``M.classification_report`` grouped by ``g``."""
    return f"""
SELECT {g}, label AS target, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       CAST(support AS BIGINT) AS support FROM pc3
UNION ALL SELECT {g}, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), CAST(sum(support) AS BIGINT) FROM pc3 GROUP BY {g}
UNION ALL SELECT {g}, 'weighted avg',
  round(CASE WHEN sum(support) = 0 THEN 0 ELSE sum(precision * support) / sum(support) END, 6),
  round(CASE WHEN sum(support) = 0 THEN 0 ELSE sum(recall * support) / sum(support) END, 6),
  round(CASE WHEN sum(support) = 0 THEN 0 ELSE sum(f1_score * support) / sum(support) END, 6), CAST(sum(support) AS BIGINT) FROM pc3 GROUP BY {g}
UNION ALL SELECT {g}, 'accuracy', NULL, NULL, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6), CAST(count(*) AS BIGINT) FROM {src} GROUP BY {g}"""


def report_ctes(src: str, g: str = "run") -> list[tuple[str, str]]:
    return [
        ("tt", f"SELECT {g}, y_true AS label, count(*) AS support, count(*) FILTER (WHERE y_true = y_pred) AS tp FROM {src} GROUP BY {g}, y_true"),
        ("pp", f"SELECT {g}, y_pred AS label, count(*) AS npred FROM {src} GROUP BY {g}, y_pred"),
        ("pc", f"""SELECT coalesce(tt.{g}, pp.{g}) AS {g}, coalesce(tt.label, pp.label) AS label, coalesce(support, 0) AS support,
            coalesce(tp, 0) AS tp, coalesce(npred, 0) AS npred FROM tt FULL JOIN pp ON tt.{g} = pp.{g} AND tt.label = pp.label"""),
        ("pc2", """SELECT *, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS precision,
            CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM pc"""),
        ("pc3", "SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1_score FROM pc2"),
    ]


@query("confusion_matrix", compose(["p1", "preds"], """SELECT a.run, a.label AS y_true, b.label AS y_pred, CAST(count(p.vec_id) AS BIGINT) AS n
    FROM (SELECT DISTINCT run, label FROM preds) a JOIN (SELECT DISTINCT run, label FROM preds) b ON a.run = b.run
    LEFT JOIN p1 p ON p.run = a.run AND p.y_true = a.label AND p.y_pred = b.label
    GROUP BY a.run, a.label, b.label"""))
def q_confusion_matrix(spark, sf_dir):
    p = preds(spark, sf_dir)
    return M.confusion_matrix(one(p), G, model_labels(p))


CLASS_COUNTS_SQL = """SELECT c.run, c.label,
    CAST(count(p.vec_id) FILTER (WHERE p.y_true = c.label AND p.y_pred = c.label) AS BIGINT) AS tp,
    CAST(count(p.vec_id) FILTER (WHERE p.y_true <> c.label AND p.y_pred = c.label) AS BIGINT) AS fp,
    CAST(count(p.vec_id) FILTER (WHERE p.y_true = c.label AND p.y_pred <> c.label) AS BIGINT) AS fn,
    CAST(count(p.vec_id) FILTER (WHERE p.y_true <> c.label AND p.y_pred <> c.label) AS BIGINT) AS tn
    FROM (SELECT DISTINCT run, label FROM {src}) c LEFT JOIN (
      SELECT * FROM {one} WHERE (run, y_true) IN (SELECT DISTINCT run, label FROM {src})
                            AND (run, y_pred) IN (SELECT DISTINCT run, label FROM {src})) p ON c.run = p.run
    GROUP BY c.run, c.label"""


@query("class_counts", compose(["p1", "preds"], CLASS_COUNTS_SQL.format(src="preds", one="p1")))
def q_class_counts(spark, sf_dir):
    p = preds(spark, sf_dir)
    return M.class_counts(one(p), G, model_labels(p))


@query("classification_report", compose(["p1"], report_sql("p1"), local=report_ctes("p1")))
def q_classification_report(spark, sf_dir):
    return M.classification_report(one(preds(spark, sf_dir)), G)


@query("micro_metrics", compose(["p1", "b1"], f"""
SELECT run, 'binary' AS average, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(CASE WHEN count(*) FILTER (WHERE y_pred = '{OUTCOME}') = 0 THEN 0 ELSE
    count(*) FILTER (WHERE y_true = '{OUTCOME}' AND y_pred = '{OUTCOME}') / count(*) FILTER (WHERE y_pred = '{OUTCOME}') END, 6) AS precision,
  round(CASE WHEN count(*) FILTER (WHERE y_true = '{OUTCOME}') = 0 THEN 0 ELSE
    count(*) FILTER (WHERE y_true = '{OUTCOME}' AND y_pred = '{OUTCOME}') / count(*) FILTER (WHERE y_true = '{OUTCOME}') END, 6) AS recall,
  round(CASE WHEN 2 * count(*) FILTER (WHERE y_true = '{OUTCOME}' AND y_pred = '{OUTCOME}') = 0 THEN 0 ELSE
    2.0 * count(*) FILTER (WHERE y_true = '{OUTCOME}' AND y_pred = '{OUTCOME}')
      / (count(*) FILTER (WHERE y_true = '{OUTCOME}') + count(*) FILTER (WHERE y_pred = '{OUTCOME}')) END, 6) AS f1
FROM b1 GROUP BY run
UNION ALL
SELECT run, 'micro', round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS a, a, a, a FROM p1 GROUP BY run"""))
def q_micro_metrics(spark, sf_dir):
    b = M.binary_metrics(one(preds(spark, sf_dir, binary=True)), G)
    m = M.micro_metrics(one(preds(spark, sf_dir)), G)
    return b.unionByName(m)


AUROC_CTES = [
    ("st", f"""SELECT run, score, count(*) FILTER (WHERE y_true = '{OUTCOME}') AS np,
        count(*) FILTER (WHERE y_true <> '{OUTCOME}') AS nn FROM bs GROUP BY run, score"""),
    ("st2", """SELECT *, coalesce(sum(nn) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
        sum(np) OVER (PARTITION BY run ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp,
        sum(nn) OVER (PARTITION BY run ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cfp FROM st"""),
    ("auc", """SELECT run,
        round(CASE WHEN sum(np) > 0 AND sum(nn) > 0 THEN sum(np * (neg_below + 0.5::DOUBLE * nn)) / (sum(np) * sum(nn)) END, 6) AS auroc,
        round(CASE WHEN sum(np) > 0 THEN sum(np * ctp / (ctp + cfp)) / sum(np) END, 6) AS auprc FROM st2 GROUP BY run"""),
]


@query("auroc_binary", compose(["bs"], "SELECT run, auroc FROM auc", local=AUROC_CTES))
def q_auroc_binary(spark, sf_dir):
    return M.auroc(bin_scores(spark, sf_dir), G)


@query("auprc_binary", compose(["bs"], "SELECT run, auprc FROM auc", local=AUROC_CTES))
def q_auprc_binary(spark, sf_dir):
    return M.auprc(bin_scores(spark, sf_dir), G)


@query("auroc_ovo_weighted", compose(["preds"], """
SELECT run, round(sum(auc * n_pair / n_all) / sum(n_pair / n_all), 6) AS auroc,
  CAST((SELECT count(DISTINCT vec_id) FROM preds x WHERE x.run = q.run) - max(n_all) AS BIGINT) AS n_dropped FROM (
  SELECT p.run, p.lo, p.hi, p.auc, p.n_pair, t.n_all FROM (
    SELECT run, least(a, b) AS lo, greatest(a, b) AS hi, avg(auc) AS auc, max(na + nb) AS n_pair FROM da GROUP BY run, least(a, b), greatest(a, b)) p
  JOIN (SELECT run, count(*) AS n_all FROM preds WHERE label = y_true GROUP BY run) t ON p.run = t.run) q
GROUP BY run""", local=[
    ("cls", "SELECT DISTINCT run, label FROM preds"),
    ("dd", """SELECT o.run, o.label AS a, c.label AS b, o.score, true AS is_pos FROM preds o JOIN cls c ON o.run = c.run
              WHERE o.label = o.y_true AND c.label <> o.label
            UNION ALL
            SELECT run, label AS a, y_true AS b, score, false AS is_pos FROM preds WHERE label <> y_true"""),
    ("ds", """SELECT run, a, b, score, count(*) FILTER (WHERE is_pos) AS np, count(*) FILTER (WHERE NOT is_pos) AS nn
              FROM dd GROUP BY run, a, b, score"""),
    ("ds2", "SELECT *, coalesce(sum(nn) OVER (PARTITION BY run, a, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM ds"),
    ("da", """SELECT run, a, b, CASE WHEN sum(np) > 0 AND sum(nn) > 0 THEN sum(np * (neg_below + 0.5::DOUBLE * nn)) / (sum(np) * sum(nn)) END AS auc,
              sum(np) AS na, sum(nn) AS nb FROM ds2 GROUP BY run, a, b"""),
]))
def q_auroc_ovo_weighted(spark, sf_dir):
    return M.auroc_ovo_weighted(preds(spark, sf_dir), G, "vec_id")


@query("confusion_2x2", compose(["b1", "preds_bin"], f"""
SELECT run, 'True' AS predicted, 'True' AS actual, tp AS count FROM cc
UNION ALL SELECT run, 'True', 'False', fp FROM cc
UNION ALL SELECT run, 'False', 'True', fn FROM cc
UNION ALL SELECT run, 'False', 'False', tn FROM cc""", local=[
    ("cc0", CLASS_COUNTS_SQL.format(src="preds_bin", one="b1")),
    ("cc", f"SELECT * FROM cc0 WHERE label = '{OUTCOME}'"),
]))
def q_confusion_2x2(spark, sf_dir):
    """The positive class's counts as (predicted, actual, count) rows."""
    p = preds(spark, sf_dir, binary=True)
    cc = M.class_counts(one(p), G, model_labels(p)).where(F.col("label") == OUTCOME)
    return cc.select("run", F.expr("stack(4, 'True', 'True', tp, 'True', 'False', fp, 'False', 'True', fn, 'False', 'False', tn) AS (predicted, actual, count)"))


register("ntrain", ["cemb"], """SELECT r.run, CAST(floor(CAST(round_even(0.75 * c.n, 0) AS BIGINT) * r.run / 4) AS BIGINT) AS n_train
    FROM (SELECT count(*) AS n FROM cemb) c, (SELECT unnest(range(1, 5)) AS run) r""")


def train_sizes(spark, sf_dir, n_runs=4):
    n = fx.class_embeddings(spark, sf_dir).groupBy().agg(F.count(F.lit(1)).alias("n"))
    nt = F.bround(F.lit(0.75) * F.col("n"), 0).cast("bigint")
    return n.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n_runs).cast("bigint"))).alias("run"), nt.alias("nt")).select(
        "run", F.floor(F.col("nt") * F.col("run") / n_runs).cast("bigint").alias("n_train"))


def eval_report(spark, sf_dir):
    """M8: one row per training size (run) with the binary model's report on
    the test studies."""
    s = size_scores(spark, sf_dir)
    wide = M.report_rows(s, G).groupBy("run").pivot("target", ["accuracy", "macro avg", "weighted avg"]).agg(
        F.first("precision").alias("p"), F.first("recall").alias("r"), F.first("f1_score").alias("f"))
    return wide.join(size_scalars(s), G).select(
        "run", F.col("accuracy_f").alias("accuracy"),
        F.col("`macro avg_p`").alias("macro_precision"), F.col("`macro avg_r`").alias("macro_recall"),
        F.col("`macro avg_f`").alias("macro_f1"), F.col("`weighted avg_p`").alias("weighted_precision"),
        F.col("`weighted avg_r`").alias("weighted_recall"), F.col("`weighted avg_f`").alias("weighted_f1"),
        "auroc", "auprc", *SIZE_COUNTS, "n_train", "seed_no")


SIZE_COUNTS = [f"{m}_{sfx}" for m in ["tp", "fp", "fn", "tn"] for sfx in ["o", "no"]]


def size_scores(spark, sf_dir):
    """Stage output, one row per training size: confusion cells, model labels, AUROC
    and AUPRC on the test studies, and the number of training studies. All reports
    of the learning curve are made from it."""
    def build():
        p = size_preds(spark, sf_dir)
        labels = p.groupBy("run").agg(F.collect_set("label").alias("labels"))
        bs = p.where(F.col("label") == OUTCOME).select("vec_id", "run", "y_true", "score")
        return M.matrix(one(p), G).join(labels, G).join(M.areas(bs, G), G).join(size_counts(spark, sf_dir), G)
    return stage(spark, sf_dir, "size_scores", build)


def size_scalars(s):
    """Scalars and class counts of each training size."""
    counts = [c.cast("bigint").alias(f"{m}_{sfx}") for lab, sfx in [(OUTCOME, "o"), (NOT_OUTCOME, "no")]
              for m, c in M.one_class_counts(lab, F.col("labels")).items()]
    return s.select("run", "auroc", "auprc", "n_train", F.lit(4220).cast("bigint").alias("seed_no"), *counts)


EVAL_REPORT_CTES = report_ctes("b1_sz") + [("rep", report_sql("b1_sz"))] + [(n, q.replace("FROM bs ", "FROM bs_sz ")) for n, q in AUROC_CTES] + [
    ("cc", CLASS_COUNTS_SQL.format(src="preds_sz", one="b1_sz")),
]
EVAL_VIEWS = ["b1_sz", "bs_sz", "preds_sz", "ntrain_sz"]
EVAL_REPORT_SQL = f"""SELECT r.run,
    max(f1_score) FILTER (WHERE target = 'accuracy') AS accuracy,
    max(precision) FILTER (WHERE target = 'macro avg') AS macro_precision,
    max(recall) FILTER (WHERE target = 'macro avg') AS macro_recall,
    max(f1_score) FILTER (WHERE target = 'macro avg') AS macro_f1,
    max(precision) FILTER (WHERE target = 'weighted avg') AS weighted_precision,
    max(recall) FILTER (WHERE target = 'weighted avg') AS weighted_recall,
    max(f1_score) FILTER (WHERE target = 'weighted avg') AS weighted_f1,
    any_value(a.auroc) AS auroc, any_value(a.auprc) AS auprc,
    any_value(c.tp_o) AS tp_o, any_value(c.tp_no) AS tp_no, any_value(c.fp_o) AS fp_o, any_value(c.fp_no) AS fp_no,
    any_value(c.fn_o) AS fn_o, any_value(c.fn_no) AS fn_no, any_value(c.tn_o) AS tn_o, any_value(c.tn_no) AS tn_no,
    any_value(n.n_train) AS n_train, CAST(4220 AS BIGINT) AS seed_no
FROM rep r JOIN auc a ON r.run = a.run JOIN ntrain_sz n ON r.run = n.run JOIN (
  SELECT run, {", ".join(f"max({m}) FILTER (WHERE label = '{lab}') AS {m}_{sfx}" for m in ["tp", "fp", "fn", "tn"] for lab, sfx in [(OUTCOME, "o"), (NOT_OUTCOME, "no")])}
  FROM cc GROUP BY run) c ON r.run = c.run
GROUP BY r.run"""


@query("eval_report", compose(EVAL_VIEWS, EVAL_REPORT_SQL, local=EVAL_REPORT_CTES))
def q_eval_report(spark, sf_dir):
    return eval_report(spark, sf_dir)


@query("pct_correct", compose(["od_preds"], f"""SELECT run, CAST(count(*) AS BIGINT) AS n,
    CAST(count(*) FILTER (WHERE predicted = '{OUTCOME}') AS BIGINT) AS n_correct,
    round(100.0 * count(*) FILTER (WHERE predicted = '{OUTCOME}') / count(*), 2) AS pct_correct
    FROM od_preds WHERE label <> '{NOT_OUTCOME}' GROUP BY run"""))
def q_pct_correct(spark, sf_dir):
    """Q4: share of true outcomes the binary stage finds (actual = outcome
    unless the label is 'not outcome'; correct = predicted == actual)."""
    o = od_preds(spark, sf_dir)
    actual = F.when(F.col("label") == NOT_OUTCOME, F.lit(NOT_OUTCOME)).otherwise(F.lit(OUTCOME))
    o = o.withColumn("actual", actual).where(F.col("actual") == OUTCOME)
    a = o.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("actual")).alias("n_correct"))
    return a.select("run", "n", "n_correct", F.round(100.0 * F.col("n_correct") / F.col("n"), 2).alias("pct_correct"))


@query("domain_accuracy", compose(["od_preds"], f"""SELECT run, label, CAST(count(*) AS BIGINT) AS n,
    CAST(count(*) FILTER (WHERE predicted_od = label) AS BIGINT) AS n_true,
    round(count(*) FILTER (WHERE predicted_od = label) / count(*), 6) AS prop_true
    FROM od_preds WHERE (label NOT IN ('Hospital', 'Need for further intervention', 'Economics', '{NOT_OUTCOME}') OR label IS NULL)
      AND predicted = '{OUTCOME}' GROUP BY run, label"""))
def q_domain_accuracy(spark, sf_dir):
    """A2: per actual domain, rows and correctly predicted rows (count_if:
    a missing prediction counts as not correct)."""
    o = od_preds(spark, sf_dir)
    excl = LABELS_EXCLUDE + [NOT_OUTCOME]
    o = o.where((~F.col("label").isin(excl) | F.col("label").isNull()) & (F.col("predicted") == OUTCOME))
    a = o.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted_od") == F.col("label")).alias("n_true"))
    return a.withColumn("prop_true", F.round(F.col("n_true") / F.col("n"), 6))


@query("study_pct_correct", compose(["p1", "mapping"], """SELECT m.study_id, CAST(count(*) AS BIGINT) AS n,
    CAST(count(*) FILTER (WHERE p.y_true = p.y_pred) AS BIGINT) AS n_correct,
    round(100.0 * count(*) FILTER (WHERE p.y_true = p.y_pred) / count(*), 2) AS pct_correct
    FROM p1 p JOIN mapping m ON p.vec_id = m.vec_id WHERE p.run = 4 GROUP BY m.study_id"""))
def q_study_pct_correct(spark, sf_dir):
    """P16 + P12 + A5 for every study at once: the share of a study's held-out
    verbatim outcomes whose domain the final model predicts correctly (the
    interactive check of one chosen study, over the whole table)."""
    p = one(preds(spark, sf_dir)).where(F.col("run") == 4)
    m = fx.mapping(spark, sf_dir).select("vec_id", "study_id")
    a = p.join(m, "vec_id").groupBy("study_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("n_correct"))
    return a.withColumn("pct_correct", F.round(100.0 * F.col("n_correct") / F.col("n"), 2))
