"""Classification operators: nearest-centroid head (M7 stand-in with an exact
oracle), argmax over class probabilities (W2, T7), reject option (T9) and
the two-stage attach (J2, T8).

Plan shape of ``nearest_centroid`` at scale: training vectors are exploded
to (run, class, dim, value) and averaged with map-side partial aggregation;
the centroid table has runs x classes rows of ``dims`` doubles -- bounded by
the label set, not by the data -- so it is broadcast and every test vector is
scored in-row (no shuffle on the test side, no cross join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.functions.ordering import hash_rank
from sectio.functions.vectors import cosine

SEED = 4220
N_RUNS = 4
TRAIN_SHARE = 0.75


def centroids(train: DataFrame, group_cols: list[str], class_col: str = "cls", vec_col: str = "v") -> DataFrame:
    """Mean vector per (group, class): exploded to (group, class, dim) and
    averaged with map-side partial aggregation, then re-assembled in dim
    order. Output rows: group x classes -- bounded by the label set."""
    ex = train.select(*group_cols, class_col, F.posexplode(vec_col).alias("pos", "x"))
    means = ex.groupBy(*group_cols, class_col, "pos").agg(F.avg("x").alias("m"))
    return means.groupBy(*group_cols, class_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c")
    )


def fit_centroids(train: DataFrame, group_cols: list[str], class_col: str = "cls", vec_col: str = "v") -> DataFrame:
    """The model: one row per group with the sorted (label, centroid) list
    in ``__centroids``."""
    cents = centroids(train, group_cols, class_col, vec_col)
    return cents.groupBy(*group_cols).agg(
        F.array_sort(F.collect_list(F.struct(F.col(class_col).alias("label"), "c"))).alias("__centroids"))


def score_centroids(test: DataFrame, model: DataFrame, group_cols: list[str], key: str,
                    class_col: str = "cls", vec_col: str = "v") -> DataFrame:
    """Score test vectors in-row against their group's centroids. Long
    output: key, group, y_true, y_pred, label, score (cosine, 6 digits);
    y_pred is the best class, the first in label order on ties.

    No broadcast hint: the model is an aggregate of groups x classes rows
    whose size AQE measures at run time, so the join becomes a broadcast
    hash join, and stays a shuffle join if a caller passes an unbounded
    class column."""
    scored = test.join(model, group_cols).select(
        key, *group_cols, F.col(class_col).alias("y_true"),
        F.transform("__centroids", lambda m: F.struct(
            m["label"].alias("label"), F.round(cosine(F.col(vec_col), m["c"]), 6).alias("score"))).alias("scores"))
    best = F.array_min(F.transform("scores", lambda x: F.struct((-x["score"]).alias("ns"), x["label"].alias("label"))))["label"]
    return scored.select(key, *group_cols, "y_true", best.alias("y_pred"), F.explode("scores").alias("s")).select(
        key, *group_cols, "y_true", "y_pred", F.col("s.label").alias("label"), F.col("s.score").alias("score"))


def nearest_centroid(
    df: DataFrame,
    key: str = "vec_id",
    class_col: str = "cls",
    vec_col: str = "v",
    n_runs: int = N_RUNS,
    seed: int = SEED,
    group: list[str] | None = None,
) -> DataFrame:
    """Held-out predictions of a nearest-centroid classifier trained on growing
    prefixes (run r uses the first floor(n_train * r / n_runs) training rows in
    seeded order). Long output: one row per (held-out key, group, run, class).
    ``group`` columns (e.g. an encoder name) are scored side by side, with the
    same split in every group.

    Columns: key, group..., run, y_true, y_pred, label, score.
    """
    g = list(group or [])
    s = hash_rank(df.select(*g, key, class_col, vec_col), seed, key, partition_by=g or None)
    s = s.withColumn("n_train", F.bround(F.lit(TRAIN_SHARE) * F.col("n"), 0).cast("bigint"))
    runs = F.sequence(F.lit(1).cast("bigint"), F.lit(n_runs).cast("bigint"))
    train = (
        s.where(F.col("rn") <= F.col("n_train"))
        .withColumn("run", F.explode(F.filter(runs, lambda r: F.col("rn") <= F.floor(F.col("n_train") * r / n_runs))))
    )
    model = fit_centroids(train, g + ["run"], class_col, vec_col)
    test = s.where(F.col("rn") > F.col("n_train")).withColumn("run", F.explode(runs))
    out = score_centroids(test, model, g + ["run"], key, class_col, vec_col)
    return out.select(key, *g, "run", "y_true", "y_pred", "label", "score")


def argmax_label(long_df: DataFrame, keys: list[str], label_col: str = "label", prob_col: str = "score") -> DataFrame:
    """Best class per key with its probability; on equal probability the
    first class in sorted label order wins."""
    best = F.min_by(F.struct(F.col(label_col).alias("label"), F.col(prob_col).alias("prob")), F.struct((-F.col(prob_col)), F.col(label_col)))
    return long_df.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.label", "b.prob")


def reject_option(long_df: DataFrame, keys: list[str], threshold: float = 0.70, reject_label: str = "No outcome",
                  label_col: str = "label", prob_col: str = "score") -> DataFrame:
    """Argmax label, replaced by ``reject_label`` when its probability is
    below ``threshold``."""
    a = argmax_label(long_df, keys, label_col, prob_col)
    return a.withColumn("label", F.when(F.col("prob") < threshold, F.lit(reject_label)).otherwise(F.col("label")))


def two_stage_attach(first: DataFrame, second: DataFrame, keys: list[str], positive: str = "outcome") -> DataFrame:
    """Attach the second-stage class only to rows the first stage
    called positive. ``first``: keys + predicted; ``second``: keys + predicted_od.
    The second stage is only evaluated on the positive rows (filter first)."""
    pos = first.where(F.col("predicted") == positive).select(*keys)
    od = second.join(pos, keys, "left_semi").select(*keys, "predicted_od")
    return first.join(od, keys, "left")
