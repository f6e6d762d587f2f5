"""Step 6: the two-stage cascade on text, corpus scoring, learning curve,
encoder comparison, cross-validation and the logistic-regression head."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectio.functions.frames import materialize, with_scalars
from sectio.functions.labels import LABELS_EXCLUDE, NOT_OUTCOME, OUTCOME, clean_label
from sectio.functions.ordering import hash_first, hash_rank
from sectio.operators import classify as C
from sectio.operators import labels as L
from sectio.operators import logistic as LG
from sectio.operators import metrics as M
from sectio.operators import sections as S
from sectio.operators import splits as SP
from sectio.operators import textmodel as TM
from sectio.plans import fixtures as fx
from sectio.plans.oracle import clean_label_sql, compose, domain_sql, register
from sectio.plans.q_metrics import AUROC_CTES, EVAL_REPORT_CTES, EVAL_VIEWS, report_ctes, report_sql, size_scores
from sectio.plans.q_similarity import grams_sql, negatives, norms_sql
from sectio.plans.q_sizes import study_vectors
from sectio.plans.q_splits import rank_sql, split_sql
from sectio.plans.q_text import phrases, sections
from sectio.plans.registry import query
from sectio.plans.stages import stage
from sectio.sources import tables

EXCL_SQL = "('Hospital', 'Need for further intervention', 'Economics')"


# --- annotated outcome texts: benchmark phrases with the domain of the
# embedding that shares their id (the mapping sheet with real text) ---------
def outcome_texts(spark, sf_dir):
    b = tables.benchmark(spark, sf_dir).select("item_id", "text")
    e = tables.embeddings(spark, sf_dir).select(F.col("vec_id").alias("item_id"), "label")
    j = b.join(e, "item_id", "left")
    return j.select("item_id", (F.col("item_id") % fx.N_STUDIES).alias("study_id"), "text",
                    clean_label(fx._domain_of(F.col("label"))).alias("domain"))


register("ot", [], f"""SELECT b.item_id, b.item_id % {fx.N_STUDIES} AS study_id, b.text,
    {clean_label_sql(domain_sql('e.label'))} AS domain FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id""")


def training_studies(spark, sf_dir):
    """Studies that the stage-1 fit may see: train and eval of the split."""
    split = SP.split_studies(outcome_texts(spark, sf_dir), n_use=10)
    return split.where(F.col("split").isin("train", "eval")).select("study_id")


def negative_pool(spark, sf_dir):
    """Mined negatives with the study of their article (read by several draws)."""
    def build():
        art = tables.documents(spark, sf_dir).select("doc_id", F.expr("try_cast(substring(source, 4) AS bigint)").alias("study_id"))
        return negatives(spark, sf_dir).join(art, "doc_id").select(
            "study_id", F.col("phrase").alias("text"), F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("phrase")).alias("k"))

    return stage(spark, sf_dir, "negative_pool", build)


def stage1_train(spark, sf_dir):
    """M3 for the stage-1 fit: the outcome texts of the training studies and as
    many negatives, drawn in seeded order from the phrases that occur in
    training studies only. No text of another study enters."""
    return stage(spark, sf_dir, "stage1_train", lambda: _stage1_train(spark, sf_dir))


def _stage1_train(spark, sf_dir):
    used = training_studies(spark, sf_dir)
    pos = outcome_texts(spark, sf_dir).join(used, "study_id", "left_semi").select(
        F.concat(F.lit("p:"), F.col("item_id").cast("string")).alias("k"), "text", F.lit(OUTCOME).alias("cls"))
    pool = L.membership_flag(negative_pool(spark, sf_dir), used, "study_id", "own").groupBy("text").agg(F.min("own").alias("own")).where("own").select("text")
    pool = stage(spark, sf_dir, "stage1_pool", lambda own=pool: own)  # the draw reads it more than once
    n_pos = pos.groupBy().agg(F.count(F.lit(1)).alias("n"))
    neg = hash_first(pool, fx.SEED, "text", n_pos).select(F.concat(F.lit("n:"), "text").alias("k"), "text", F.lit(NOT_OUTCOME).alias("cls"))
    return pos.unionByName(neg)


def stage2_train(spark, sf_dir):
    ot = outcome_texts(spark, sf_dir).where(F.col("domain").isNotNull() & ~F.col("domain").isin(LABELS_EXCLUDE))
    return ot.select(F.concat(F.lit("p:"), F.col("item_id").cast("string")).alias("k"), "text", F.col("domain").alias("cls"))


def stage_models(spark, sf_dir, rows: int | None = None):
    """The two fitted heads (a row of class weights per gram), on all training
    texts, or each on the first ``rows`` in seeded order."""
    of = "" if rows is None else f"_of_{rows}"
    m1 = stage(spark, sf_dir, f"model_stage1{of}", lambda: TM.fit_head(stage1_train(spark, sf_dir), "k", "text", "cls", rows))
    m2 = stage(spark, sf_dir, f"model_stage2{of}", lambda: TM.fit_head(stage2_train(spark, sf_dir), "k", "text", "cls", rows))
    return m1, m2


def text_model_sql(p: str, train: str, rows: int | None = None) -> None:
    """``TM.fit_head`` in SQL: the training rows (or those drawn), features with the
    empty gram as the intercept, and one pair of views a step (residuals, then weights
    ``w`` and the accelerated point ``z``)."""
    fixed = lambda name, deps, sql: register(name, deps, sql, materialized=True)
    fixed(f"{p}_y", [train], f"SELECT k, text, cls FROM {train}" if rows is None else f"""SELECT k, text, cls FROM (
        SELECT *, row_number() OVER (ORDER BY md5('{TM.SEED}|' || k), k) AS rn FROM {train}) q WHERE rn <= {rows}""")
    register(f"{p}_g", [f"{p}_y"], grams_sql(f"{p}_y", "k", "text"))
    register(f"{p}_n", [f"{p}_g"], norms_sql(f"{p}_g", "k"))
    fixed(f"{p}_x", [f"{p}_g", f"{p}_n", f"{p}_y"], f"""SELECT g.k, g.gram, g.n / n.norm AS v FROM {p}_g g JOIN {p}_n n ON g.k = n.k
        UNION ALL SELECT k, '', 1.0::DOUBLE FROM {p}_y""")
    fixed(f"{p}_c", [f"{p}_x", f"{p}_y"], f"""SELECT gram, (gram <> '')::INT AS inner_, CASE WHEN gram = '' THEN 0.0 ELSE sum(v) / (SELECT count(*) FROM {p}_y) END AS mean,
        (SELECT count(*) FROM {p}_y)::DOUBLE AS rows_ FROM {p}_x GROUP BY gram""")
    fixed(f"{p}_z0", [f"{p}_c", f"{p}_y"], f"""SELECT gram, label, inner_, mean, rows_, 0.0::DOUBLE AS w, 0.0::DOUBLE AS z
        FROM {p}_c, (SELECT DISTINCT cls AS label FROM {p}_y) l""")
    for t in range(TM.STEPS):
        z = f"{p}_z{t}"
        fixed(f"{p}_r{t}", [f"{p}_x", f"{p}_y", z], f"""SELECT s.k, s.label, e / sum(e) OVER (PARTITION BY s.k) - (y.cls = s.label)::INT AS r FROM (
            SELECT k, label, exp(s - max(s) OVER (PARTITION BY k)) AS e FROM (
              SELECT x.k, z.label, sum(x.v * z.z) - any_value(m.c) AS s FROM {p}_x x JOIN {z} z ON x.gram = z.gram
              JOIN (SELECT label, sum(mean * z) AS c FROM {z} GROUP BY label) m ON m.label = z.label GROUP BY x.k, z.label) q) s JOIN {p}_y y ON s.k = y.k""")
        fixed(f"{p}_z{t + 1}", [f"{p}_x", f"{p}_r{t}", z], f"""SELECT gram, label, inner_, mean, rows_, nw AS w, nw + {t} / {t + 3}.0::DOUBLE * (nw - w) AS z FROM (
            SELECT z.*, z.z - {TM.RATE}::DOUBLE * ((g.pull - z.mean * a.r) / z.rows_ + z.inner_ * {TM.PENALTY}::DOUBLE / z.rows_ * z.z) AS nw FROM {z} z
            JOIN (SELECT x.gram, r.label, sum(x.v * r.r) AS pull FROM {p}_x x JOIN {p}_r{t} r ON x.k = r.k GROUP BY x.gram, r.label) g ON z.gram = g.gram AND z.label = g.label
            JOIN (SELECT label, sum(r) AS r FROM {p}_r{t} GROUP BY label) a ON a.label = z.label) q""")
    last = f"{p}_z{TM.STEPS}"
    fixed(p, [last], f"SELECT label, gram, w FROM {last} WHERE gram <> ''")
    fixed(f"{p}_b", [last], f"SELECT label, sum(CASE WHEN gram = '' THEN w ELSE -mean * w END) AS b FROM {last} GROUP BY label")


def text_score_sql(p: str, items: str, col: str, model: str) -> None:
    register(f"{p}_t", [items], f"SELECT DISTINCT {col} AS t FROM {items}")
    register(f"{p}_g", [f"{p}_t"], grams_sql(f"{p}_t", "t", "t"))
    register(f"{p}_n", [f"{p}_g"], norms_sql(f"{p}_g", "t"))
    register(f"{p}_s", [f"{p}_t", f"{p}_g", f"{p}_n", model, f"{model}_b"], f"""SELECT t, label, round(e / sum(e) OVER (PARTITION BY t), 6) AS score FROM (
        SELECT t, label, exp(s - max(s) OVER (PARTITION BY t)) AS e FROM (
          SELECT t.t, c.label, c.b + coalesce(d.dot / n.norm, 0.0) AS s
          FROM {p}_t t CROSS JOIN {model}_b c
          LEFT JOIN (SELECT g.t, m.label, sum(g.n * m.w) AS dot FROM {p}_g g JOIN {model} m ON g.gram = m.gram GROUP BY g.t, m.label) d
            ON d.t = t.t AND d.label = c.label
          LEFT JOIN {p}_n n ON n.t = t.t) a) b""")
    register(p, [f"{p}_s"], f"""SELECT t, label, score AS prob FROM (
        SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, label) AS r FROM {p}_s) q WHERE r = 1""")


register("ot_sp", ["ot"], split_sql("(SELECT DISTINCT study_id FROM ot) s", "study_id", 10))
register("neg_pool", ["negs", "articles"], """SELECT try_cast(substr(a.source, 4) AS BIGINT) AS study_id, n.phrase AS text,
    CAST(n.doc_id AS VARCHAR) || '|' || n.phrase AS k FROM negs n JOIN articles a ON n.doc_id = a.doc_id""")
register("s1_pos", ["ot", "ot_sp"], f"""SELECT 'p:' || CAST(item_id AS VARCHAR) AS k, text, '{OUTCOME}' AS cls FROM ot
    WHERE study_id IN (SELECT study_id FROM ot_sp WHERE split IN ('train', 'eval'))""")
register("s1_train", ["s1_pos", "ot_sp", "neg_pool"], f"""SELECT * FROM s1_pos
    UNION ALL SELECT 'n:' || text AS k, text, '{NOT_OUTCOME}' AS cls FROM (
      SELECT text, row_number() OVER (ORDER BY md5('4220|' || text), text) AS rn FROM (
        SELECT text FROM neg_pool GROUP BY text
        HAVING bool_and(coalesce(study_id IN (SELECT study_id FROM ot_sp WHERE split IN ('train', 'eval')), false))) p) q
    WHERE rn <= (SELECT count(*) FROM s1_pos)""")
register("s2_train", ["ot"], f"""SELECT 'p:' || CAST(item_id AS VARCHAR) AS k, text, domain AS cls FROM ot
    WHERE domain IS NOT NULL AND domain NOT IN {EXCL_SQL}""")
for of, drawn in (("", TM.FIT_ROWS), ("_all", None)):
    text_model_sql(f"tm1{of}", "s1_train", drawn)
    text_model_sql(f"tm2{of}", "s2_train", drawn)
    text_score_sql(f"sc1{of}", "phrases", "phrase", f"tm1{of}")
    register(f"pos_ph{of}", ["phrases", f"sc1{of}"], f"""SELECT p.*, s.prob FROM phrases p JOIN sc1{of} s ON p.phrase = s.t WHERE s.label = '{OUTCOME}'""")
    text_score_sql(f"sc2{of}", f"pos_ph{of}", "phrase", f"tm2{of}")
    register(f"corpus{of}", [f"pos_ph{of}", f"sc2{of}"], f"""SELECT p.doc_id, p.sent_idx, p.phrase_idx, p.phrase AS verbatim_outcome, p.sentence AS sentence_context,
    p.prob AS is_outcome_probability, s.label AS outcome_domain FROM pos_ph{of} p JOIN sc2{of} s ON p.phrase = s.t""")


def corpus_outcomes(spark, sf_dir, rows: int | None = None):
    """Results phrases -> stage 1 (outcome or not) -> keep
    outcomes -> stage 2 (domain) on those only. ``rows`` as in ``stage_models``."""
    return stage(spark, sf_dir, "corpus" if rows is None else f"corpus_of_{rows}", lambda: _corpus(spark, sf_dir, rows))


def _corpus(spark, sf_dir, rows):
    """Distinct phrases are scored by both stages, then joined to the phrase
    rows once."""
    m1, m2 = stage_models(spark, sf_dir, rows)
    ph = phrases(spark, sf_dir)
    s1 = stage(spark, sf_dir, "stage1_outcomes" if rows is None else f"stage1_outcomes_of_{rows}", lambda: TM.score_texts(ph, "phrase", m1).where(F.col("label") == OUTCOME).select("phrase", "prob"))
    s2 = TM.score_texts(s1, "phrase", m2).select("phrase", F.col("label").alias("outcome_domain"))
    out = ph.join(s1.join(s2, "phrase"), "phrase")
    return out.select("doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"),
                      F.col("phrase_idx").cast("bigint").alias("phrase_idx"), F.col("phrase").alias("verbatim_outcome"),
                      F.col("sentence").alias("sentence_context"), F.col("prob").alias("is_outcome_probability"),
                      "outcome_domain")


@query("corpus_outcomes", compose(["corpus"], """SELECT doc_id, sent_idx, phrase_idx, verbatim_outcome, sentence_context,
    is_outcome_probability, outcome_domain FROM corpus"""))
def q_corpus_outcomes(spark, sf_dir):
    return corpus_outcomes(spark, sf_dir, TM.FIT_ROWS)


text_score_sql("sco", "ot", "text", "tm2_all")


@query("reject_option", compose(["ot", "sco"], """SELECT o.item_id, CASE WHEN s.prob < 0.7 THEN 'No outcome' ELSE s.label END AS label, s.prob
    FROM ot o JOIN sco s ON o.text = s.t"""))
def q_reject_option(spark, sf_dir):
    """The stage-2 domain of every annotated outcome text, or "No outcome" if
    its probability is under 0.70."""
    _, m2 = stage_models(spark, sf_dir)
    ot = outcome_texts(spark, sf_dir).select("item_id", "text")
    long = TM.score_texts(ot, "text", m2).select("text", F.explode("scores").alias("s")).select("text", "s.label", "s.score")
    return ot.join(C.reject_option(long, ["text"], threshold=0.70), "text").select("item_id", "label", "prob")


@query("corpus_status", compose(["sec_loc", "corpus_all"], """SELECT status, CAST(count(*) AS BIGINT) AS n_articles FROM (
    SELECT CASE WHEN l.status <> 'ok' THEN 'no_results' WHEN c.doc_id IS NULL THEN 'no_outcomes' ELSE 'ok' END AS status
    FROM sec_loc l LEFT JOIN (SELECT DISTINCT doc_id FROM corpus_all) c ON l.doc_id = c.doc_id) q GROUP BY status"""))
def q_corpus_status(spark, sf_dir):
    """Every article is ok (outcomes found), no_outcomes (results
    section without predicted outcome, incl. an empty span) or no_results."""
    loc = sections(spark, sf_dir).select("doc_id", "status")
    found = corpus_outcomes(spark, sf_dir).select("doc_id").distinct().withColumn("found", F.lit(True))
    st = (F.when(F.col("status") != S.STATUS_OK, F.lit(S.STATUS_NO_RESULTS))
          .when(F.col("found").isNull(), F.lit(S.STATUS_NO_OUTCOMES)).otherwise(F.lit(S.STATUS_OK)))
    return loc.join(found, "doc_id", "left").groupBy(st.alias("status")).agg(F.count(F.lit(1)).alias("n_articles"))


def _articles_with(spark, sf_dir, status):
    loc = sections(spark, sf_dir).select("doc_id", "source", "status")
    if status == S.STATUS_NO_RESULTS:
        return loc.where(F.col("status") != S.STATUS_OK).select("doc_id", "source")
    found = corpus_outcomes(spark, sf_dir).select("doc_id").distinct()
    return loc.where(F.col("status") == S.STATUS_OK).join(found, "doc_id", "left_anti").select("doc_id", "source")


@query("articles_without_results", compose(["sec_loc"], "SELECT doc_id, source FROM sec_loc WHERE status <> 'ok'"))
def q_articles_without_results(spark, sf_dir):
    """The articles in which no results section was found."""
    return _articles_with(spark, sf_dir, S.STATUS_NO_RESULTS)


@query("articles_without_outcomes", compose(["sec_loc", "corpus_all"], """SELECT l.doc_id, l.source FROM sec_loc l
    WHERE l.status = 'ok' AND l.doc_id NOT IN (SELECT doc_id FROM corpus_all)"""))
def q_articles_without_outcomes(spark, sf_dir):
    """The articles whose results section holds no predicted outcome."""
    return _articles_with(spark, sf_dir, S.STATUS_NO_OUTCOMES)


# --- M12: score outcomes + as many sampled negatives, flag training studies --
register("sc_rows", ["ot", "neg_pool"], f"""SELECT study_id, text, domain AS label FROM ot
    UNION ALL SELECT study_id, text, '{NOT_OUTCOME}' AS label FROM (
      SELECT *, row_number() OVER (ORDER BY md5('4220|' || k), k) AS rn FROM neg_pool) q
    WHERE rn <= (SELECT count(*) FROM ot)""")
text_score_sql("scx", "sc_rows", "text", "tm1")


@query("score_corpus", compose(["sc_rows", "ot_sp", "scx"], """SELECT r.study_id, r.text, r.label,
    coalesce(s.split IN ('train', 'eval'), false) AS used_in_training, x.label AS predicted
    FROM sc_rows r LEFT JOIN ot_sp s ON r.study_id = s.study_id LEFT JOIN scx x ON r.text = x.t"""))
def q_score_corpus(spark, sf_dir):
    """The annotated outcomes plus an equal number of mined negatives
    (seeded, without replacement), flagged when their study is one of those
    that the stage-1 model was fitted on, with its prediction. A row with a null
    text stays, without a prediction."""
    ot = outcome_texts(spark, sf_dir)
    pos = ot.select("study_id", "text", F.col("domain").alias("label"))
    neg = hash_first(negative_pool(spark, sf_dir), fx.SEED, "k", ot.groupBy().agg(F.count(F.lit(1)).alias("n")))
    rows = pos.unionByName(neg.select("study_id", "text", F.lit(NOT_OUTCOME).alias("label")))
    rows = L.membership_flag(rows, training_studies(spark, sf_dir), "study_id", "used_in_training")
    m1, _ = stage_models(spark, sf_dir, TM.FIT_ROWS)
    pred = TM.score_texts(rows, "text", m1).select("text", F.col("label").alias("predicted"))
    return rows.join(pred, "text", "left").select("study_id", "text", "label", "used_in_training", "predicted")


# --- M9: learning curve (binary head, growing training prefixes) ----------
LC_TARGETS = [OUTCOME, NOT_OUTCOME, "macro avg", "weighted avg"]


def learning_curve(spark, sf_dir):
    """Long report per training size in studies: (run, n_articles, target, metric,
    score) with the run's accuracy / AUROC / AUPRC on every row."""
    s = size_scores(spark, sf_dir).withColumn("accuracy", M.accuracy(F.col("cells")))
    rep = M.report_rows(s, ["run"], ["n_train", "accuracy", "auroc", "auprc"]).where(F.col("target").isin(LC_TARGETS))
    return rep.select("run", F.col("n_train").alias("n_articles"), "target", F.expr(
        "stack(4, 'precision', precision, 'recall', recall, 'f1-score', f1_score, 'support', CAST(support AS DOUBLE)) AS (metric, score)"),
        "accuracy", "auroc", "auprc")


LC_SQL = f"""SELECT r.run, e.n_train AS n_articles, r.target, u.metric, u.score, e.accuracy, e.auroc, e.auprc
FROM rep r JOIN ev e ON r.run = e.run,
LATERAL (SELECT 'precision' AS metric, r.precision AS score UNION ALL SELECT 'recall', r.recall
         UNION ALL SELECT 'f1-score', r.f1_score UNION ALL SELECT 'support', CAST(r.support AS DOUBLE)) u
WHERE r.target IN ('{OUTCOME}', '{NOT_OUTCOME}', 'macro avg', 'weighted avg')"""


def _ev_sql():
    from sectio.plans.q_metrics import EVAL_REPORT_SQL
    return EVAL_REPORT_SQL


register("ev", EVAL_VIEWS, "SELECT * FROM (" + "WITH " + ",\n".join(
    f"{n} AS ({sql})" for n, sql in EVAL_REPORT_CTES) + "\n" + _ev_sql() + ") q")
register("lc_rep", ["b1_sz"], "SELECT * FROM (WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in report_ctes("b1_sz")) + "\n" + report_sql("b1_sz") + ") q")


@query("learning_curve", compose(["lc_rep", "ev"], LC_SQL.replace("FROM rep r", "FROM lc_rep r")))
def q_learning_curve(spark, sf_dir):
    return learning_curve(spark, sf_dir)


# --- M11: stratified 5-fold validation of the binary head -------------------
K_FOLDS = 5
CV_STUDIES = 10
register("cv_own", ["sz_v"], f"""SELECT * FROM sz_v WHERE study_id IN (
    SELECT study_id FROM (SELECT study_id, min(vec_id) AS first FROM sz_v GROUP BY study_id ORDER BY first, study_id LIMIT {CV_STUDIES}) f)""")
register("cv_src", ["cv_own"], f"""SELECT vec_id, v, cls FROM cv_own WHERE cls = '{OUTCOME}'
    UNION ALL SELECT vec_id, v, cls FROM ({rank_sql(f"cv_own WHERE cls = '{NOT_OUTCOME}'", "vec_id", rn="draw", n=None)}) n
    WHERE draw <= (SELECT count(*) FROM cv_own WHERE cls = '{OUTCOME}')""")
register("cvf", ["cv_src"], f"""SELECT vec_id, v, cls, CAST((rn - 1) % {K_FOLDS} + 1 AS INTEGER) AS fold FROM (
    SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('4220|' || CAST(vec_id AS VARCHAR)), vec_id) AS rn FROM cv_src) q""")
register("cv_cent", ["cvf"], f"""SELECT f AS fold, cls, list(m ORDER BY pos) AS c FROM (
    SELECT f, cls, pos, avg(x) AS m FROM (
      SELECT r.f, t.cls, unnest(range(0, len(t.v))) AS pos, unnest(t.v) AS x
      FROM cvf t JOIN (SELECT unnest(range(1, {K_FOLDS + 1})) AS f) r ON t.fold <> r.f) d
    GROUP BY f, cls, pos) g GROUP BY f, cls""")
register("cv_sc", ["cvf", "cv_cent"], """SELECT t.vec_id, t.fold, t.cls AS y_true, c.cls AS label,
    round(list_dot_product(t.v, c.c) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(c.c, c.c))), 6) AS score
    FROM cvf t JOIN cv_cent c ON t.fold = c.fold""")
register("cv_p", ["cv_sc"], """SELECT *, first_value(label) OVER (PARTITION BY vec_id, fold ORDER BY score DESC, label) AS y_pred FROM cv_sc""")


def cv_predictions(spark, sf_dir, k: int = K_FOLDS):
    """Long predictions per fold: each row is scored by the centroids of the
    other k-1 folds (one fit per fold, all folds in one job). The rows are those
    of the first ``CV_STUDIES`` studies in encounter order (O3), with as many
    negatives as positives (M3)."""
    rows = study_vectors(spark, sf_dir)
    own = rows.join(SP.first_studies(rows, CV_STUDIES, "vec_id").select("study_id"), "study_id", "left_semi").withColumn("all", F.lit(1))
    pos = own.where(F.col("cls") == OUTCOME)
    neg = SP.balance_negatives(pos, own.where(F.col("cls") != OUTCOME), by="all", key="vec_id")
    ce = pos.unionByName(neg.select(*pos.columns)).select("vec_id", "v", "cls")
    folds = SP.stratified_folds(ce, "vec_id", "cls", k=k)
    train = folds.withColumn("f", F.explode(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda x: x != F.col("fold"))))
    model = C.fit_centroids(train, ["f"])
    test = folds.withColumn("f", F.col("fold"))
    return stage(spark, sf_dir, "cv_predictions",
                 lambda: C.score_centroids(test, model, ["f"], "vec_id").withColumnRenamed("f", "fold"))


@query("cv_folds_eval", compose(["cv_p"], f"""SELECT a.fold, a.accuracy, a.precision, a.recall, a.f1, b.auroc, b.auprc FROM (
    SELECT fold, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
      round(CASE WHEN count(*) FILTER (WHERE y_pred = '{OUTCOME}') = 0 THEN 0 ELSE
        count(*) FILTER (WHERE y_true = '{OUTCOME}' AND y_pred = '{OUTCOME}') / count(*) FILTER (WHERE y_pred = '{OUTCOME}') END, 6) AS precision,
      round(CASE WHEN count(*) FILTER (WHERE y_true = '{OUTCOME}') = 0 THEN 0 ELSE
        count(*) FILTER (WHERE y_true = '{OUTCOME}' AND y_pred = '{OUTCOME}') / count(*) FILTER (WHERE y_true = '{OUTCOME}') END, 6) AS recall,
      round(CASE WHEN count(*) FILTER (WHERE y_true = '{OUTCOME}' AND y_pred = '{OUTCOME}') = 0 THEN 0 ELSE
        2.0 * count(*) FILTER (WHERE y_true = '{OUTCOME}' AND y_pred = '{OUTCOME}')
          / (count(*) FILTER (WHERE y_true = '{OUTCOME}') + count(*) FILTER (WHERE y_pred = '{OUTCOME}')) END, 6) AS f1
    FROM (SELECT DISTINCT vec_id, fold, y_true, y_pred FROM cv_p) q GROUP BY fold) a JOIN auc b ON a.fold = b.run""",
    local=[("bs", f"SELECT vec_id, fold AS run, y_true, score FROM cv_p WHERE label = '{OUTCOME}'")] + AUROC_CTES))
def q_cv_folds_eval(spark, sf_dir):
    """Per fold, binary metrics of the positive class plus AUROC and
    AUPRC on the positive-class score."""
    p = cv_predictions(spark, sf_dir)
    rows = p.where(F.col("label") == F.col("y_pred")).select("vec_id", "fold", "y_true", "y_pred")
    bm = M.binary_metrics(rows, ["fold"]).drop("average")
    sc = p.where(F.col("label") == OUTCOME).select("fold", "y_true", "score")
    return bm.join(M.areas(sc, ["fold"]), "fold").select(
        F.col("fold").cast("int").alias("fold"), "accuracy", "precision", "recall", "f1", "auroc", "auprc")


# --- M7: L2 logistic head on text vectors (pyspark.ml) ----------------------
# At the optimum of a penalised fit whose intercepts are not penalised, the
# probabilities of a class sum to its number of training rows; and a head that has
# learned from texts with a signal halves the log loss of the class shares and beats
# the largest class on rows that it has not seen.
register("lg", ["labelled"], """SELECT label, row_number() OVER (ORDER BY md5('4220|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
    count(*) OVER () AS n FROM labelled""")


@query("fit_logistic", compose(["lg"], """SELECT label, CAST(count(*) FILTER (WHERE rn <= round_even(0.75 * n, 0)) AS BIGINT) AS n_train,
    round(CAST(count(*) FILTER (WHERE rn <= round_even(0.75 * n, 0)) AS DOUBLE), 1) AS sum_probability,
    CAST(count(*) FILTER (WHERE rn > round_even(0.75 * n, 0)) AS BIGINT) AS n_held_out,
    CAST(count(*) FILTER (WHERE rn > round_even(0.75 * n, 0)) AS BIGINT) AS n_scored, true AS halves_log_loss, true AS beats_largest_class
    FROM lg GROUP BY label"""))
def q_fit_logistic(spark, sf_dir):
    """M7: L2-penalised logistic regression on trigram vectors of the labelled
    texts, fitted on the seeded 75 %. Per class: training rows, the sum of the
    fitted probabilities over them, held-out rows and how many were scored; and of
    the whole fit, whether its mean log loss is under half of that of the class
    shares, and its held-out accuracy over the share of the largest class."""
    rows = hash_rank(fx.labelled(spark, sf_dir).select("doc_id", "text", "label"), fx.SEED, "doc_id")
    rows = rows.withColumn("is_train", F.col("rn") <= F.bround(F.lit(0.75) * F.col("n"), 0))
    # The vectors are made and written once; fit and prediction read them.
    rows = materialize(LG.vectors(rows, "text", LG.DIMS).drop("text"))
    model = LG.fit(rows.where("is_train"), "text", "label")
    scored = LG.predict(rows, model, "text")
    classes = model.labels
    own = [F.round(F.sum(F.when(F.col("is_train"), F.element_at("probabilities", F.lit(c)))), 1) for c in classes]
    train, out = F.col("is_train"), ~F.col("is_train")
    right = F.sum(F.when(out & (F.col("predicted") == F.col("label")), 1).otherwise(0))
    sums = scored.agg(*(e.alias(f"s{i}") for i, e in enumerate(own)),
                      F.avg(F.when(train, -F.log(F.element_at("probabilities", F.col("label"))))).alias("loss"),
                      *(F.count_if(train & (F.col("label") == c)).alias(f"t{i}") for i, c in enumerate(classes)),
                      *(F.count_if(out & (F.col("label") == c)).alias(f"o{i}") for i, c in enumerate(classes)), right.alias("right"))
    total = sum(F.col(f"t{i}") for i in range(len(classes)))
    null = sum(-F.col(f"t{i}") / total * F.log(F.col(f"t{i}") / total) for i in range(len(classes)))
    largest = F.greatest(*(F.col(f"o{i}") for i in range(len(classes))))
    per = scored.groupBy("label").agg(F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_held_out"),
                                      F.count_if(~F.col("is_train") & F.col("probabilities").isNotNull()).alias("n_scored"))
    cases = F.coalesce(*(F.when(F.col("label") == c, F.col(f"s{i}")) for i, c in enumerate(classes)))
    return with_scalars(per, sums).select("label", "n_train", cases.alias("sum_probability"), "n_held_out", "n_scored",
                                          (F.col("loss") < null / 2).alias("halves_log_loss"), (F.col("right") > largest).alias("beats_largest_class"))
