"""Study-level learning curve (M8, M9, W8): the binary head fitted on the first
5, 10, ... non-test studies of the seeded split, with as many negatives as
positives per size (M3), scored on the vectors of the fixed test studies. One
``run`` per size; sizes count studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectio.functions.frames import with_scalars
from sectio.functions.labels import NOT_OUTCOME, OUTCOME
from sectio.operators import classify as C
from sectio.operators import splits as SP
from sectio.plans import fixtures as fx
from sectio.plans.oracle import register
from sectio.plans.q_splits import rank_sql, split_sql
from sectio.plans.stages import stage

STEP = 5
FINAL_SIZE_RUN = 3  # the largest size: 15 of the 20 fixture studies are not test studies


def study_vectors(spark, sf_dir):
    return fx.class_embeddings(spark, sf_dir, binary=True).withColumn("study_id", F.col("vec_id") % fx.N_STUDIES)


def size_grid(spark, sf_dir):
    """(run, n_articles, study_id, split) of every size, with the test studies of the split."""
    split = SP.split_studies(study_vectors(spark, sf_dir))
    grid = SP.train_size_grid(split, step=STEP)
    return split, grid.withColumn("run", F.col("n_articles") / STEP).withColumn("run", F.col("run").cast("bigint"))


def size_preds(spark, sf_dir):
    """Held-out predictions per size: vec_id, run, y_true, y_pred, label, score."""
    return stage(spark, sf_dir, "preds_size", lambda: _size_preds(spark, sf_dir))


def _size_preds(spark, sf_dir):
    rows = study_vectors(spark, sf_dir)
    split, grid = size_grid(spark, sf_dir)
    own = rows.join(grid.where(F.col("split") == "train").select("study_id", "run"), "study_id")
    pos, neg = own.where(F.col("cls") == OUTCOME), own.where(F.col("cls") != OUTCOME)
    drawn = SP.balance_negatives(pos, neg, by="run", key="vec_id")
    model = C.fit_centroids(pos.unionByName(drawn.select(*pos.columns)), ["run"])
    runs = grid.groupBy().agg(F.max("run").alias("__runs"))
    test = rows.join(split.where(F.col("split") == "test").select("study_id"), "study_id", "left_semi")
    test = with_scalars(test, runs).withColumn("run", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__runs")))).drop("__runs", "study_id")
    return C.score_centroids(test, model, ["run"], "vec_id").select("vec_id", "run", "y_true", "y_pred", "label", "score")


def size_counts(spark, sf_dir):
    """Studies per run."""
    _, grid = size_grid(spark, sf_dir)
    return grid.select("run", F.col("n_articles").alias("n_train")).distinct()


register("sz_v", ["cemb_bin"], f"SELECT *, vec_id % {fx.N_STUDIES} AS study_id FROM cemb_bin")
register("sz_sp", ["sz_v"], split_sql("(SELECT DISTINCT study_id FROM sz_v) s", "study_id", None))
register("sz_c", ["sz_sp"], "SELECT count(*) FILTER (WHERE split = 'test') AS k, count(*) FILTER (WHERE split <> 'test') AS m FROM sz_sp")
register("ntrain_sz", ["sz_c"], f"SELECT n // {STEP} AS run, n AS n_train FROM (SELECT unnest(range({STEP}, (SELECT m FROM sz_c) + 1, {STEP})) AS n) q")
register("sz_own", ["sz_v", "sz_sp", "sz_c", "ntrain_sz"], """SELECT v.*, g.run FROM sz_v v JOIN sz_sp s ON v.study_id = s.study_id, ntrain_sz g
    WHERE s.split <> 'test' AND s.rn - (SELECT k FROM sz_c) <= CAST(round_even(0.8 * g.n_train, 0) AS BIGINT)""")
register("sz_neg", ["sz_own"], rank_sql(f"sz_own WHERE cls = '{NOT_OUTCOME}'", "vec_id", part="run", rn="draw", n=None))
register("sz_train", ["sz_own", "sz_neg"], f"""SELECT run, v, cls FROM sz_own WHERE cls = '{OUTCOME}'
    UNION ALL SELECT n.run, n.v, n.cls FROM sz_neg n JOIN (SELECT run, count(*) AS n_pos FROM sz_own WHERE cls = '{OUTCOME}' GROUP BY run) p
      ON n.run = p.run WHERE n.draw <= p.n_pos""")
register("sz_cent", ["sz_train"], """SELECT run, cls, list(m ORDER BY pos) AS c FROM (
    SELECT run, cls, pos, avg(x) AS m FROM (SELECT run, cls, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM sz_train) d
    GROUP BY run, cls, pos) g GROUP BY run, cls""")
register("sz_score", ["sz_v", "sz_sp", "sz_cent"], """SELECT t.vec_id, c.run, t.cls AS y_true, c.cls AS label,
    round(list_dot_product(t.v, c.c) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(c.c, c.c))), 6) AS score
    FROM sz_v t JOIN sz_sp s ON t.study_id = s.study_id, sz_cent c WHERE s.split = 'test'""")
register("preds_sz", ["sz_score"], """SELECT vec_id, run, y_true,
    first_value(label) OVER (PARTITION BY vec_id, run ORDER BY score DESC, label) AS y_pred, label, score FROM sz_score""")
register("b1_sz", ["preds_sz"], "SELECT DISTINCT vec_id, run, y_true, y_pred FROM preds_sz")
register("bs_sz", ["preds_sz"], f"SELECT vec_id, run, y_true, score FROM preds_sz WHERE label = '{OUTCOME}'")
