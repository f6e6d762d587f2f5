"""Step 7: report tables (Q1-Q8), JSON report round trip, trial logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectio.functions.frames import exact_mean, exact_mean_sql, with_scalars
from sectio.functions.labels import LABELS_EXCLUDE, NOT_OUTCOME, NO_OUTCOME, OUTCOME
from sectio.operators import classify as C
from sectio.operators import labels as L
from sectio.operators import metrics as M
from sectio.operators import reportio as RIO
from sectio.operators import textmodel as TM
from sectio.plans import fixtures as fx
from sectio.plans.oracle import VIEWS, _nc, compose, register
from sectio.plans.q_cascade import corpus_outcomes, cv_predictions, learning_curve
from sectio.plans.q_encoders import halving
from sectio.plans.q_metrics import AUROC_CTES, one, report_ctes, report_sql, size_scalars, size_scores, train_sizes
from sectio.plans.q_models import od_preds, preds
from sectio.plans.q_sizes import FINAL_SIZE_RUN
from sectio.plans.registry import query
from sectio.plans.stages import stage
from sectio.sources import trials as TR

TARGETS = [OUTCOME, NOT_OUTCOME, "weighted avg", "macro avg"]
FINAL_RUN = C.N_RUNS
COUNT_KEYS = {"FP": ["fp_o", "fp_no"], "FN": ["fn_o", "fn_no"], "TP": ["tp_o", "tp_no"], "TN": ["tn_o", "tn_no"]}
EXCL_ALL = LABELS_EXCLUDE + [NOT_OUTCOME]
EXCL_ALL_SQL = "('Hospital', 'Need for further intervention', 'Economics', 'not outcome')"


def pct(c):
    """percent with one decimal of a value rounded half-even to 3
    digits (presentation); null stays null."""
    return F.when(c.isNotNull(), F.format_string("%.1f%%", F.bround(c, 3) * 100))


def pct_sql(x: str) -> str:
    return f"printf('%.1f%%', round_even({x}, 3) * 100)"


# --- JSON reports of the size runs and their flattening ---------------------
def size_reports(spark, sf_dir) -> DataFrame:
    """K2: one JSON report per training size (run), the reference's report
    layout (class objects, accuracy, AUROC, AUPRC, n_articles, seed_no,
    FP/FN/TP/TN lists in class order outcome, not outcome)."""
    def build():
        s = size_scores(spark, sf_dir)
        scal = size_scalars(s).select("run", F.col("auroc").alias("AUROC"), F.col("auprc").alias("AUPRC"),
                                      F.col("n_train").alias("n_articles"), "seed_no", *[c for cs in COUNT_KEYS.values() for c in cs])
        return RIO.reports_json(M.report_rows(s, ["run"]), scal, ["run"], COUNT_KEYS)
    return stage(spark, sf_dir, "size_reports", build)


def size_metrics_long(spark, sf_dir) -> DataFrame:
    return RIO.flatten_reports(size_reports(spark, sf_dir), ["run"], TARGETS,
                               {"n_articles": "n_articles", "accuracy": "accuracy", "AUROC": "auroc", "AUPRC": "auprc"},
                               COUNT_KEYS)


FLAT_SQL = f"""SELECT r.run, u.metric, r.target, u.score, CAST(e.n_train AS DOUBLE) AS n_articles, e.accuracy, e.auroc, e.auprc,
    e.fp_o, e.fp_no, e.fn_o, e.fn_no, e.tp_o, e.tp_no, e.tn_o, e.tn_no
FROM lc_rep r JOIN ev e ON r.run = e.run,
LATERAL (SELECT 'precision' AS metric, r.precision AS score UNION ALL SELECT 'recall', r.recall
         UNION ALL SELECT 'f1-score', r.f1_score UNION ALL SELECT 'support', CAST(r.support AS DOUBLE)) u
WHERE r.target IN ('{OUTCOME}', '{NOT_OUTCOME}', 'macro avg', 'weighted avg')"""
register("flat", ["lc_rep", "ev"], FLAT_SQL)


@query("report_flatten", compose(["flat"], "SELECT * FROM flat"))
def q_report_flatten(spark, sf_dir):
    return size_metrics_long(spark, sf_dir)


# --- Q3: final binary metrics, long and wide --------------------------------
def final_long(spark, sf_dir) -> DataFrame:
    f = size_metrics_long(spark, sf_dir).where(F.col("run") == FINAL_SIZE_RUN)
    base = f.select("metric", "target", "score")
    one_row = f.select("accuracy", "auroc", "auprc").limit(1)
    extra = one_row.select(F.expr(f"stack(3, 'AUROC', '{OUTCOME}', auroc, 'AUPRC', '{OUTCOME}', auprc, "
                                  "'accuracy', 'macro avg', accuracy) AS (metric, target, score)"))
    return base.unionByName(extra).na.drop(subset=["score"])


register("final_long", ["flat"], f"""SELECT metric, target, score FROM (
    SELECT metric, target, score FROM flat WHERE run = {FINAL_SIZE_RUN}
    UNION ALL SELECT 'AUROC', '{OUTCOME}', auroc FROM (SELECT DISTINCT auroc FROM flat WHERE run = {FINAL_SIZE_RUN}) a
    UNION ALL SELECT 'AUPRC', '{OUTCOME}', auprc FROM (SELECT DISTINCT auprc FROM flat WHERE run = {FINAL_SIZE_RUN}) b
    UNION ALL SELECT 'accuracy', 'macro avg', accuracy FROM (SELECT DISTINCT accuracy FROM flat WHERE run = {FINAL_SIZE_RUN}) c) q
    WHERE score IS NOT NULL""")


@query("final_metrics_long", compose(["final_long"], "SELECT metric, target, score FROM final_long"))
def q_final_metrics_long(spark, sf_dir):
    """Q3 (08 stage): the final run's class metrics long, with AUROC/AUPRC
    added to the outcome class and accuracy to macro avg (P17); rows
    without a value dropped (P15)."""
    return final_long(spark, sf_dir)


@query("final_metrics_wide", compose(["final_long"], f"""SELECT w.target, {pct_sql('w.precision')} AS precision, {pct_sql('w.recall')} AS recall,
    {pct_sql('w.f1')} AS f1, {pct_sql('w.auroc')} AS auroc, {pct_sql('w.auprc')} AS auprc, {pct_sql('a.score')} AS accuracy
    FROM (SELECT target,
            max(score) FILTER (WHERE metric = 'precision') AS precision, max(score) FILTER (WHERE metric = 'recall') AS recall,
            max(score) FILTER (WHERE metric = 'f1-score') AS f1, max(score) FILTER (WHERE metric = 'AUROC') AS auroc,
            max(score) FILTER (WHERE metric = 'AUPRC') AS auprc
          FROM final_long WHERE target IN ('{OUTCOME}', '{NOT_OUTCOME}') GROUP BY target) w,
         (SELECT score FROM final_long WHERE metric = 'accuracy') a"""))
def q_final_metrics_wide(spark, sf_dir):
    """Q3 (report): outcome / not outcome rows, metric columns (R3 with the
    value list given), accuracy from the single accuracy row on every row
    (J11), as percentages (F12)."""
    f = size_metrics_long(spark, sf_dir).where((F.col("run") == FINAL_SIZE_RUN) & F.col("target").isin(OUTCOME, NOT_OUTCOME))
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("score")))
    own = F.col("target") == OUTCOME  # AUROC and AUPRC belong to the outcome class, accuracy to the run
    w = f.groupBy("target").agg(of("precision").alias("p"), of("recall").alias("r"), of("f1-score").alias("f"),
                                F.max(F.when(own, F.col("auroc"))).alias("a"), F.max(F.when(own, F.col("auprc"))).alias("c"), F.max("accuracy").alias("acc"))
    return w.select("target", pct(F.col("p")).alias("precision"), pct(F.col("r")).alias("recall"), pct(F.col("f")).alias("f1"),
                    pct(F.col("a")).alias("auroc"), pct(F.col("c")).alias("auprc"), pct(F.col("acc")).alias("accuracy"))


# --- Q1: learning-curve table -------------------------------------------------
@query("learning_curve_table", compose(["lc_rep", "ev"], f"""SELECT CAST(e.n_train AS BIGINT) AS n_articles,
    {pct_sql('r.precision')} AS precision, {pct_sql('r.recall')} AS recall, {pct_sql('r.f1_score')} AS f1_score,
    {pct_sql('e.auroc')} AS auroc, {pct_sql('e.auprc')} AS auprc
    FROM lc_rep r JOIN ev e ON r.run = e.run WHERE r.target = '{OUTCOME}' ORDER BY n_articles"""))
def q_learning_curve_table(spark, sf_dir):
    """Q1: outcome-class precision / recall / F1 by training size (long ->
    wide), joined to the size's AUROC / AUPRC (J9: the scalar columns are
    taken distinct before the join, so there is no fan-out)."""
    lc = learning_curve(spark, sf_dir).where((F.col("metric") != "support") & (F.col("target") == OUTCOME))
    wide = lc.groupBy("n_articles").pivot("metric", ["precision", "recall", "f1-score"]).agg(F.first("score"))
    sc = lc.select("n_articles", "auroc", "auprc").distinct()
    return wide.join(sc, "n_articles", "left").select(
        F.col("n_articles").cast("bigint").alias("n_articles"), pct(F.col("precision")).alias("precision"),
        pct(F.col("recall")).alias("recall"), pct(F.col("`f1-score`")).alias("f1_score"),
        pct(F.col("auroc")).alias("auroc"), pct(F.col("auprc")).alias("auprc")).orderBy("n_articles")


# --- Q2 / A11: cross-validation table and summary ---------------------------
def cv_reports(spark, sf_dir) -> DataFrame:
    """Per fold: classification report rows plus AUROC / AUPRC."""
    p = cv_predictions(spark, sf_dir)
    rows = p.where(F.col("label") == F.col("y_pred")).select("vec_id", "fold", "y_true", "y_pred")
    sc = p.where(F.col("label") == OUTCOME).select("fold", "y_true", "score")
    scored = M.matrix(rows, ["fold"]).join(M.areas(sc, ["fold"]), "fold")
    return M.report_rows(scored, ["fold"], ["auroc", "auprc"])


register("cv1", ["cv_p"], "SELECT DISTINCT vec_id, fold, y_true, y_pred FROM cv_p")
register("cv_rep", ["cv1", "cv_p"], "SELECT r.*, a.auroc, a.auprc FROM (WITH " + ",\n".join(
    f"{n} AS ({sql})" for n, sql in report_ctes("cv1", g="fold")) + "\n" + report_sql("cv1", g="fold") + ") r JOIN (WITH " + ",\n".join(
    f"{n} AS ({sql})" for n, sql in [("bs", f"SELECT vec_id, fold AS run, y_true, score FROM cv_p WHERE label = '{OUTCOME}'")] + AUROC_CTES)
    + "\nSELECT run AS fold, auroc, auprc FROM auc) a ON r.fold = a.fold")


@query("cv_summary", compose(["cv_rep"], f"""SELECT {exact_mean_sql('precision')} AS precision, {exact_mean_sql('recall')} AS recall,
    {exact_mean_sql('auprc')} AS auprc, {exact_mean_sql('auroc')} AS auroc FROM cv_rep WHERE target = 'macro avg'"""))
def q_cv_summary(spark, sf_dir):
    """Mean over this run's folds of macro-avg precision / recall and
    of AUPRC / AUROC."""
    r = cv_reports(spark, sf_dir).where(F.col("target") == "macro avg")
    return r.agg(*[exact_mean(F.col(c)).alias(c) for c in ["precision", "recall", "auprc", "auroc"]])


@query("cv_table", compose(["cv_rep"], f"""
SELECT CAST(fold AS VARCHAR) AS fold, {pct_sql('p')} AS precision, {pct_sql('r')} AS recall, {pct_sql('f')} AS f1,
       printf('%.1f%%', round_even(auroc * 100, 1)) AS auroc, printf('%.1f%%', round_even(auprc * 100, 1)) AS auprc FROM t
UNION ALL
SELECT 'average', {pct_sql(exact_mean_sql('p', 3))}, {pct_sql(exact_mean_sql('r', 3))}, {pct_sql(exact_mean_sql('f', 3))},
       {pct_sql(exact_mean_sql('auroc'))}, {pct_sql(exact_mean_sql('auprc'))} FROM t""",
    local=[("t", f"""SELECT fold, round_even(precision, 3) AS p, round_even(recall, 3) AS r, round_even(f1_score, 3) AS f, auroc, auprc
        FROM cv_rep WHERE target = '{OUTCOME}'""")]))
def q_cv_table(spark, sf_dir):
    """Q2: per fold the outcome class's precision / recall / F1 (rounded to
    3 digits) and AUROC / AUPRC, plus an 'average' row: means of the rounded
    values (A12: the (fold) and () grouping sets), as percentages."""
    r = cv_reports(spark, sf_dir).where(F.col("target") == OUTCOME).select(
        "fold", F.bround("precision", 3).alias("p"), F.bround("recall", 3).alias("r"), F.bround("f1_score", 3).alias("f"),
        "auroc", "auprc")
    # Grouping sets (fold) and (): a fold's mean is its one value.
    means = r.rollup("fold").agg(F.grouping("fold").alias("all"), *(exact_mean(F.col(c), 3).alias(c) for c in "prf"),
                                 *(exact_mean(F.col(c)).alias(c) for c in ("auroc", "auprc")))
    whole = F.col("all") == 1
    area = lambda c: F.when(whole, pct(F.col(c))).otherwise(F.format_string("%.1f%%", F.bround(F.col(c) * 100, 1)))
    return means.select(F.when(whole, "average").otherwise(F.col("fold").cast("string")).alias("fold"), pct(F.col("p")).alias("precision"),
                        pct(F.col("r")).alias("recall"), pct(F.col("f")).alias("f1"), area("auroc").alias("auroc"), area("auprc").alias("auprc"))


# --- Q5: domain model metrics -------------------------------------------------
@query("domain_metrics_table", compose(["p1", "preds"], f"""SELECT r.target AS eval, r.precision, r.recall, r.f1_score,
    CASE WHEN r.target = 'weighted avg' THEN o.auroc END AS auroc
    FROM rep r JOIN ovo o ON r.run = o.run WHERE r.run = {FINAL_RUN} AND r.target IN ('macro avg', 'weighted avg')""",
    local=report_ctes("p1") + [("rep", report_sql("p1"))] + [
        ("cls", "SELECT DISTINCT run, label FROM preds"),
        ("dd", """SELECT o.run, o.label AS a, c.label AS b, o.score, true AS is_pos FROM preds o JOIN cls c ON o.run = c.run
                  WHERE o.label = o.y_true AND c.label <> o.label
                UNION ALL SELECT run, label AS a, y_true AS b, score, false AS is_pos FROM preds WHERE label <> y_true"""),
        ("ds", "SELECT run, a, b, score, count(*) FILTER (WHERE is_pos) AS np, count(*) FILTER (WHERE NOT is_pos) AS nn FROM dd GROUP BY run, a, b, score"),
        ("ds2", "SELECT *, coalesce(sum(nn) OVER (PARTITION BY run, a, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM ds"),
        ("da", """SELECT run, a, b, CASE WHEN sum(np) > 0 AND sum(nn) > 0 THEN sum(np * (neg_below + 0.5::DOUBLE * nn)) / (sum(np) * sum(nn)) END AS auc,
                  sum(np) AS na, sum(nn) AS nb FROM ds2 GROUP BY run, a, b"""),
        ("ovo", """SELECT run, round(sum(auc * n_pair / n_all) / sum(n_pair / n_all), 6) AS auroc FROM (
            SELECT p.run, p.auc, p.n_pair, t.n_all FROM (
              SELECT run, least(a, b) AS lo, greatest(a, b) AS hi, avg(auc) AS auc, max(na + nb) AS n_pair FROM da GROUP BY run, least(a, b), greatest(a, b)) p
            JOIN (SELECT run, count(*) AS n_all FROM preds WHERE label = y_true GROUP BY run) t ON p.run = t.run) q GROUP BY run"""),
    ]))
def q_domain_metrics_table(spark, sf_dir):
    """Q5: the domain model's macro and weighted averages as rows (R4
    transpose), with the weighted one-vs-one AUROC on the weighted row."""
    p = preds(spark, sf_dir).where(F.col("run") == FINAL_RUN)
    rep = M.classification_report(one(p), ["run"]).where(F.col("target").isin("macro avg", "weighted avg"))
    ovo = M.auroc_ovo_weighted(p, ["run"], "vec_id")
    j = rep.join(ovo, "run")
    return j.select(F.col("target").alias("eval"), "precision", "recall", "f1_score",
                    F.when(F.col("target") == "weighted avg", F.col("auroc")).alias("auroc"))


# --- Q7: domain share, annotated vs extracted --------------------------------
@query("domain_distribution", compose(["od_preds", "corpus"], f"""SELECT a.label, CAST(a.n AS BIGINT) AS n, round(a.n / sum(a.n) OVER (), 6) AS percent,
    CAST(coalesce(p.n_pred, 0) AS BIGINT) AS n_pred, coalesce(round(p.n_pred / p.tot, 6), 0.0) AS percent_pred
    FROM (SELECT label, count(*) AS n FROM od_preds WHERE run = {FINAL_RUN} AND predicted = '{OUTCOME}'
            AND (label NOT IN {EXCL_ALL_SQL} OR label IS NULL) GROUP BY label) a
    LEFT JOIN (SELECT outcome_domain AS label, count(*) AS n_pred, sum(count(*)) OVER () AS tot FROM corpus GROUP BY outcome_domain) p
      ON a.label = p.label
    WHERE a.label <> '{NOT_OUTCOME}'"""))
def q_domain_distribution(spark, sf_dir):
    """Q7: share of each domain among the annotated outcomes the cascade
    kept, next to its share among outcomes extracted from the corpus (A1,
    W3 over the per-label counts -- one row per label, bounded -- J8)."""
    o = od_preds(spark, sf_dir).where((F.col("run") == FINAL_RUN) & (F.col("predicted") == OUTCOME))
    o = o.where(~F.col("label").isin(EXCL_ALL) | F.col("label").isNull())
    a = o.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    a = a.withColumn("percent", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
    c = corpus_outcomes(spark, sf_dir, TM.FIT_ROWS).groupBy(F.col("outcome_domain").alias("label")).agg(F.count(F.lit(1)).alias("n_pred"))
    c = c.withColumn("percent_pred", F.round(F.col("n_pred") / F.sum("n_pred").over(Window.partitionBy()), 6))
    j = a.join(c, "label", "left").where(F.col("label") != NOT_OUTCOME)
    return j.select("label", "n", "percent", F.coalesce("n_pred", F.lit(0)).cast("bigint").alias("n_pred"),
                    F.coalesce("percent_pred", F.lit(0.0)).alias("percent_pred"))


# --- Q8: domain grid (sizes x number of labels) -------------------------------
N_LABELS = 6


def domain_grid_reports(spark, sf_dir) -> DataFrame:
    """W8 over two axes: for k = 1..6 most frequent domains (after
    exclusions) every other row is 'No outcome'; each k is trained on the
    growing prefixes (runs) -- 24 fits in one job. Per-class report rows with
    n_articles (training size) and n_labels."""
    ce = fx.class_embeddings(spark, sf_dir)
    labs = L.top_labels(L.exclude_labels(ce.select(F.col("cls").alias("label")), exclude=EXCL_ALL), N_LABELS)
    g = ce.join(labs.select(F.col("label").alias("cls"), "rank"), "cls", "left")
    g = g.withColumn("n_labels", F.explode(F.sequence(F.lit(1), F.lit(N_LABELS))))
    g = g.withColumn("cls", F.when(F.col("rank") <= F.col("n_labels"), F.col("cls")).otherwise(F.lit(NO_OUTCOME)))
    p = C.nearest_centroid(g.select("n_labels", "vec_id", "v", "cls"), group=["n_labels"])
    rows = p.where(F.col("label") == F.col("y_pred")).select("vec_id", "n_labels", "run", "y_true", "y_pred")
    rep = M.classification_report(rows, ["n_labels", "run"])
    return rep.join(train_sizes(spark, sf_dir), "run").withColumnRenamed("n_train", "n_articles")


register("dg_lab", ["cemb"], f"""SELECT label, row_number() OVER (ORDER BY n DESC, label) AS rank FROM (
    SELECT cls AS label, count(*) AS n FROM cemb WHERE cls NOT IN {EXCL_ALL_SQL} GROUP BY cls ORDER BY n DESC, label LIMIT {N_LABELS}) t""")
register("dg_grid", ["cemb", "dg_lab"], f"""SELECT k.n_labels, e.vec_id, e.v,
    CASE WHEN r.rank <= k.n_labels THEN e.cls ELSE '{NO_OUTCOME}' END AS cls
    FROM cemb e LEFT JOIN dg_lab r ON e.cls = r.label, (SELECT unnest(range(1, {N_LABELS + 1})) AS n_labels) k""")
VIEWS.update(_nc("dg", "dg_grid", group=["n_labels"]))
register("dg1", ["dg"], "SELECT DISTINCT vec_id, n_labels, run, y_true, y_pred, n_labels * 10 + run AS gk FROM dg")
register("dg_rep", ["dg1", "ntrain"], "SELECT CAST(r.gk // 10 AS BIGINT) AS n_labels, r.gk % 10 AS run, n.n_train AS n_articles, r.* EXCLUDE (gk) FROM (WITH "
         + ",\n".join(f"{n} AS ({sql})" for n, sql in report_ctes("dg1", g="gk")) + "\n" + report_sql("dg1", g="gk")
         + ") r JOIN ntrain n ON r.gk % 10 = n.run")
register("avg_mets", ["dg_rep"], f"""SELECT metric, n_articles, n_labels, {exact_mean_sql('score')} AS class_avg FROM (
    SELECT n_articles, n_labels, target, 'precision' AS metric, precision AS score FROM dg_rep
    UNION ALL SELECT n_articles, n_labels, target, 'recall', recall FROM dg_rep) q
    WHERE score > 0 AND target NOT IN ('accuracy', 'macro avg', 'weighted avg', '{NO_OUTCOME}')
    GROUP BY metric, n_articles, n_labels""")


def avg_mets(spark, sf_dir) -> DataFrame:
    rep = domain_grid_reports(spark, sf_dir).where(~F.col("target").isin("accuracy", "macro avg", "weighted avg", NO_OUTCOME))
    long = rep.select("n_articles", "n_labels", "target", F.expr(
        "stack(2, 'precision', precision, 'recall', recall) AS (metric, score)"))
    long = long.where(F.col("score") > 0)
    return long.groupBy("metric", "n_articles", "n_labels").agg(exact_mean(F.col("score")).alias("class_avg"))


@query("class_avg_by_size", compose(["avg_mets"], "SELECT metric, n_articles, CAST(n_labels AS BIGINT) AS n_labels, class_avg FROM avg_mets"))
def q_class_avg_by_size(spark, sf_dir):
    """Q8: mean non-zero precision / recall over the named classes (R2 wide
    to long, P11 filters, A3), by training size and number of labels."""
    return avg_mets(spark, sf_dir).withColumn("n_labels", F.col("n_labels").cast("bigint"))


@query("min_articles_per_labels", compose(["avg_mets"], """SELECT CAST(n_labels AS BIGINT) AS n_labels, min(n_articles) AS min_articles
    FROM (SELECT DISTINCT n_articles, n_labels FROM avg_mets) q GROUP BY n_labels"""))
def q_min_articles_per_labels(spark, sf_dir):
    """A4: the smallest training size with any scored class, per number of
    labels."""
    a = avg_mets(spark, sf_dir).select("n_articles", "n_labels").distinct()
    return a.groupBy(F.col("n_labels").cast("bigint").alias("n_labels")).agg(F.min("n_articles").alias("min_articles"))


# --- trial logs: written per trial (K4), parsed back (S6, F9, F10, F15) -------
def trial_table(spark, sf_dir) -> DataFrame:
    """The search's trials: objective = accuracy on the eval studies."""
    return stage(spark, sf_dir, "trials", lambda: halving(spark, sf_dir))


@query("hpo_trials_parse", compose(["trials"], "SELECT trial, objective_value, encoder, train_quarters FROM trials"))
def q_hpo_trials_parse(spark, sf_dir):
    """Trial lines in the search log format, then parsed back: regex capture
    of number, objective and the parameter dict, dict read as JSON."""
    lines = TR.trial_lines(trial_table(spark, sf_dir))
    return TR.parse_trial_lines(lines).select("trial", "objective_value", "encoder", "train_quarters")


@query("hpo_leaderboard", compose(["trials"], """SELECT CAST(row_number() OVER (ORDER BY objective_value DESC, trial) AS BIGINT) AS rank,
    trial, objective_value, encoder, train_quarters,
    trial = (SELECT arg_max(trial, (objective_value, -trial)) FROM trials) AS is_best FROM trials"""))
def q_hpo_leaderboard(spark, sf_dir):
    """Trials by objective (ties: lower trial number first) and the best
    trial (max_by over objective)."""
    t = TR.parse_trial_lines(TR.trial_lines(trial_table(spark, sf_dir)))
    best = t.groupBy().agg(F.max_by("trial", F.struct("objective_value", -F.col("trial"))).alias("best"))
    # one row per trial: the ranking window is bounded by the number of trials.
    r = t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("objective_value"), "trial")).cast("bigint"))
    return with_scalars(r, best).select("rank", "trial", "objective_value", "encoder", "train_quarters",
                                        (F.col("trial") == F.col("best")).alias("is_best"))
