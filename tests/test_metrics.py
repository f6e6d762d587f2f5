"""Hand cases for the metric operators (zero division, ties, label lists)."""

import itertools

import pytest

from sectio.operators import metrics as M


def rows(spark, data, cols):
    return spark.createDataFrame(data, cols)


def test_report_zero_division_and_missing_classes(spark):
    # class c is never predicted, class d is predicted but never true
    p = rows(spark, [(1, "g", "a", "a"), (2, "g", "a", "b"), (3, "g", "b", "b"), (4, "g", "c", "d")],
             ["k", "run", "y_true", "y_pred"])
    rep = {r["target"]: r for r in M.classification_report(p, ["run"]).collect()}
    assert set(rep) == {"a", "b", "c", "d", "macro avg", "weighted avg", "accuracy"}
    assert rep["c"]["precision"] == 0.0 and rep["c"]["recall"] == 0.0 and rep["c"]["f1_score"] == 0.0
    assert rep["d"]["support"] == 0 and rep["d"]["precision"] == 0.0
    assert rep["a"]["precision"] == 1.0 and rep["a"]["recall"] == 0.5
    assert rep["b"]["precision"] == 0.5 and rep["b"]["recall"] == 1.0
    assert rep["accuracy"]["f1_score"] == 0.5 and rep["accuracy"]["support"] == 4
    assert rep["macro avg"]["precision"] == pytest.approx((1 + 0.5 + 0 + 0) / 4)
    assert rep["weighted avg"]["recall"] == pytest.approx((0.5 * 2 + 1 * 1 + 0 * 1) / 4)


def test_confusion_drops_labels_outside_list(spark):
    p = rows(spark, [(1, "g", "a", "a"), (2, "g", "x", "a"), (3, "g", "b", "a")], ["k", "run", "y_true", "y_pred"])
    labels = rows(spark, [("g", "a"), ("g", "b")], ["run", "label"])
    cm = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion_matrix(p, ["run"], labels).collect()}
    assert cm == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 1, ("b", "b"): 0}
    cc = {r["label"]: r for r in M.class_counts(p, ["run"], labels).collect()}
    assert (cc["a"]["tp"], cc["a"]["fp"], cc["a"]["fn"], cc["a"]["tn"]) == (1, 1, 0, 0)
    assert (cc["b"]["tp"], cc["b"]["fp"], cc["b"]["fn"], cc["b"]["tn"]) == (0, 0, 1, 1)


def brute_auroc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == "outcome"]
    neg = [s for y, s in zip(ys, ss) if y != "outcome"]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(ys, ss):
    order = sorted(set(ss), reverse=True)
    P = sum(y == "outcome" for y in ys)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for y, s in zip(ys, ss) if s >= t and y == "outcome")
        fp = sum(1 for y, s in zip(ys, ss) if s >= t and y != "outcome")
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


@pytest.mark.parametrize("scores", [
    [0.9, 0.8, 0.7, 0.7, 0.2, 0.1],
    [0.5] * 6,
    [0.1, 0.2, 0.3, 0.4, 0.5, 0.6],
])
def test_auroc_auprc_against_brute_force(spark, scores):
    ys = ["outcome", "not outcome", "outcome", "not outcome", "outcome", "not outcome"]
    df = rows(spark, [("g", y, s) for y, s in zip(ys, scores)], ["run", "y_true", "score"])
    auc = M.auroc(df, ["run"]).first()["auroc"]
    ap = M.auprc(df, ["run"]).first()["auprc"]
    assert auc == pytest.approx(round(brute_auroc(ys, scores), 6))
    assert ap == pytest.approx(round(brute_ap(ys, scores), 6))


def test_auroc_ties_and_reversal(spark):
    ys = ["outcome", "not outcome"] * 3
    tied = rows(spark, [("g", y, 0.3) for y in ys], ["run", "y_true", "score"])
    assert M.auroc(tied, ["run"]).first()["auroc"] == 0.5
    sc = [0.9, 0.1, 0.4, 0.6, 0.35, 0.2]
    a = M.auroc(rows(spark, [("g", y, s) for y, s in zip(ys, sc)], ["run", "y_true", "score"]), ["run"]).first()["auroc"]
    b = M.auroc(rows(spark, [("g", y, -s) for y, s in zip(ys, sc)], ["run", "y_true", "score"]), ["run"]).first()["auroc"]
    assert a + b == pytest.approx(1.0)


def test_auroc_one_class_is_null(spark):
    df = rows(spark, [("g", "outcome", 0.3), ("g", "outcome", 0.4)], ["run", "y_true", "score"])
    assert M.auroc(df, ["run"]).first()["auroc"] is None


def test_ovo_weighted_against_brute_force(spark):
    items = [  # key, true, scores for a b c
        (1, "a", (0.8, 0.1, 0.1)), (2, "a", (0.4, 0.5, 0.1)), (3, "b", (0.3, 0.6, 0.1)),
        (4, "b", (0.5, 0.2, 0.3)), (5, "c", (0.2, 0.2, 0.6)), (6, "c", (0.1, 0.7, 0.2)), (7, "a", (0.6, 0.3, 0.1)),
    ]
    classes = ["a", "b", "c"]
    long = [("g", k, t, c, s[i]) for k, t, s in items for i, c in enumerate(classes)]
    df = rows(spark, long, ["run", "vec_id", "y_true", "label", "score"])
    got = M.auroc_ovo_weighted(df, ["run"], "vec_id").first()["auroc"]

    def auc(pos, neg):
        return sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))

    num = den = 0.0
    for a, b in itertools.combinations(classes, 2):
        ia, ib = classes.index(a), classes.index(b)
        pa = [s[ia] for _, t, s in items if t == a]
        na = [s[ia] for _, t, s in items if t == b]
        pb = [s[ib] for _, t, s in items if t == b]
        nb = [s[ib] for _, t, s in items if t == a]
        prev = (len(pa) + len(pb)) / len(items)
        num += prev * (auc(pa, na) + auc(pb, nb)) / 2
        den += prev
    assert got == pytest.approx(round(num / den, 6))


def test_binary_metrics(spark):
    p = rows(spark, [("g", "outcome", "outcome"), ("g", "outcome", "not outcome"), ("g", "not outcome", "outcome"),
                     ("g", "not outcome", "not outcome")], ["run", "y_true", "y_pred"])
    r = M.binary_metrics(p, ["run"]).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5, 0.5)


def test_areas_over_many_distinct_scores_in_one_group(spark):
    """Unrounded, skewed scores: far more values than buckets, some tied."""
    import numpy as np
    from pyspark.sql import functions as F

    from sectio.operators import metrics as M

    n = 20000
    df = spark.range(n).select(F.lit(1).alias("run"), F.when(F.xxhash64("id") % 3 == 0, "outcome").otherwise("not outcome").alias("y_true"),
                               F.pow(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(15000)) / 15000.0, F.lit(9)).alias("score"))
    rows = df.toPandas()
    pos = (rows.y_true == "outcome").to_numpy()
    s = rows.score.to_numpy()
    values, at = np.unique(s, return_inverse=True)
    npos, nneg = np.bincount(at, pos, len(values)), np.bincount(at, ~pos, len(values))
    below = np.cumsum(nneg) - nneg
    auc = (npos * (below + 0.5 * nneg)).sum() / (pos.sum() * (~pos).sum())
    ctp, cfp = np.cumsum(npos[::-1])[::-1], np.cumsum(nneg[::-1])[::-1]
    ap = (npos * ctp / (ctp + cfp)).sum() / pos.sum()
    assert abs(M.auroc(df, ["run"]).first()["auroc"] - auc) < 1e-6
    assert abs(M.auprc(df, ["run"]).first()["auprc"] - ap) < 1e-6


def test_confusion_matrix_has_every_pair_of_labels(spark):
    from sectio.operators import metrics as M

    p = spark.createDataFrame([(1, "a", "b"), (1, "a", "z")], "run int, y_true string, y_pred string")
    labels = spark.createDataFrame([(1, "a"), (1, "b")], "run int, label string")
    got = sorted(tuple(r) for r in M.confusion_matrix(p, ["run"], labels).select("run", "y_true", "y_pred", "n").collect())
    assert got == [(1, "a", "a", 0), (1, "a", "b", 1), (1, "b", "a", 0), (1, "b", "b", 0)]
