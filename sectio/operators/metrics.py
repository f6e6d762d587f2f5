"""Classification metrics as grouped DataFrame operators.

Inputs are prediction rows; ``group`` columns (run, fold, size, model, ...)
make every metric a grouped aggregate, so a whole learning curve or all
folds are scored in one job.

Score-based metrics (AUROC, AUPRC) aggregate to distinct scores per group and
need, for each, the counts below it. No window orders a whole group: scores are
dealt to ``BUCKETS`` buckets at approximate quantiles, bucket totals are
prefix-summed (``BUCKETS`` rows per group) and the exact running sums are taken
inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

R = 6  # digits kept on reported metrics


def _r(c):
    return F.round(c, R)


def _div0(a, b):
    """a / b, 0 when b = 0 (scikit-learn's zero_division=0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion_matrix(preds: DataFrame, group: list[str], labels: DataFrame | None = None) -> DataFrame:
    """A14, long form: group, y_true, y_pred, n. With a label list (group +
    ``label`` rows), every pair of its labels has a row, zero cells included, and
    pairs with either side outside it are dropped; without one, only pairs that
    occur."""
    p = preds
    if labels is not None:
        lt = labels.select(*group, F.col("label").alias("y_true"))
        lp = labels.select(*group, F.col("label").alias("y_pred"))
        p = p.join(lt, group + ["y_true"], "left_semi").join(lp, group + ["y_pred"], "left_semi")
        n = p.groupBy(*group, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
        grid = lt.join(lp, group) if group else lt.join(lp, F.lit(True))  # the square of the label list
        return grid.join(n, group + ["y_true", "y_pred"], "left").fillna(0, ["n"])
    return p.groupBy(*group, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def class_counts(preds: DataFrame, group: list[str], labels: DataFrame) -> DataFrame:
    """Per class of the label list, TP / FP / FN / TN from the matrix
    marginals (row sum - diag, column sum - diag, diag, rest)."""
    cm = confusion_matrix(preds, group, labels)
    row = cm.groupBy(*group, F.col("y_true").alias("label")).agg(F.sum("n").alias("row_n"))
    col = cm.groupBy(*group, F.col("y_pred").alias("label")).agg(F.sum("n").alias("col_n"))
    diag = cm.where(F.col("y_true") == F.col("y_pred")).select(*group, F.col("y_true").alias("label"), F.col("n").alias("tp"))
    tot = cm.groupBy(*group).agg(F.sum("n").alias("total"))
    out = (
        labels.select(*group, "label").distinct()
        .join(tot, group, "left")
        .join(row, group + ["label"], "left")
        .join(col, group + ["label"], "left")
        .join(diag, group + ["label"], "left")
        .fillna(0, ["row_n", "col_n", "tp", "total"])
    )
    return out.select(
        *group,
        "label",
        F.col("tp").cast("bigint").alias("tp"),
        (F.col("col_n") - F.col("tp")).cast("bigint").alias("fp"),
        (F.col("row_n") - F.col("tp")).cast("bigint").alias("fn"),
        (F.col("total") - F.col("row_n") - F.col("col_n") + F.col("tp")).cast("bigint").alias("tn"),
    )


def matrix(preds: DataFrame, group: list[str]) -> DataFrame:
    """Group and ``cells``, its confusion counts ``(y_true, y_pred, n)`` as an array
    of at most the square of the label set: one pass over the predictions, from
    which every label metric follows in-row."""
    n = preds.groupBy(*group, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*group).agg(F.collect_list(F.struct("y_true", "y_pred", "n")).alias("cells"))


def _total(cells, which=None):
    """Sum of the counts of the cells that ``which`` keeps."""
    kept = F.filter(cells, which) if which else cells
    return F.aggregate(kept, F.lit(0).cast("long"), lambda a, c: a + c["n"])


def accuracy(cells):
    """Share of a matrix's rows on its diagonal."""
    return _r(_total(cells, lambda c: c["y_true"] == c["y_pred"]) / _total(cells))


def one_class_counts(label: str, labels) -> dict:
    """A15 of one class from a matrix row: columns tp, fp, fn, tn over the cells
    whose labels are both in the array ``labels``."""
    cells = F.filter("cells", lambda c: F.array_contains(labels, c["y_true"]) & F.array_contains(labels, c["y_pred"]))
    of = lambda t, p: _total(cells, lambda c: ((c["y_true"] == label) == F.lit(t)) & ((c["y_pred"] == label) == F.lit(p)))
    return {"tp": of(True, True), "fp": of(False, True), "fn": of(True, False), "tn": of(False, False)}


def _classes(cells):
    """Array of (label, precision, recall, f1_score, support) in label order."""
    labels = F.array_sort(F.array_distinct(F.concat(F.transform(cells, lambda c: c["y_true"]), F.transform(cells, lambda c: c["y_pred"]))))
    counts = F.transform(labels, lambda x: F.struct(
        x.alias("label"), _total(cells, lambda c: c["y_true"] == x).alias("support"), _total(cells, lambda c: c["y_pred"] == x).alias("npred"),
        _total(cells, lambda c: (c["y_true"] == x) & (c["y_pred"] == x)).alias("tp")))
    rates = F.transform(counts, lambda c: F.struct(
        c["label"].alias("label"), _div0(c["tp"], c["npred"]).alias("precision"), _div0(c["tp"], c["support"]).alias("recall"), c["support"].alias("support")))
    return F.transform(rates, lambda c: F.struct(
        c["label"].alias("label"), c["precision"].alias("precision"), c["recall"].alias("recall"),
        _div0(2 * c["precision"] * c["recall"], c["precision"] + c["recall"]).alias("f1_score"), c["support"].alias("support")))


def report_rows(m: DataFrame, group: list[str], keep: list[str] | None = None) -> DataFrame:
    """A16 from ``matrix`` rows, without a shuffle: one row per target (each class,
    'macro avg', 'weighted avg', 'accuracy'); ``keep`` columns stay beside."""
    extra = list(keep or [])
    held = m.select(*group, *extra, "cells", _classes(F.col("cells")).alias("__c"))
    total, right = _total(F.col("cells")), _total(F.col("cells"), lambda c: c["y_true"] == c["y_pred"])
    add = lambda f: F.aggregate("__c", F.lit(0.0), lambda a, c: a + f(c))

    def row(name, p, r, f1, support):
        return F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f1.alias("f1_score"), support.alias("support"))

    rates = ("precision", "recall", "f1_score")
    macro = row("macro avg", *(add(lambda c, x=x: c[x]) / F.size("__c") for x in rates), total)
    weighted = row("weighted avg", *(_div0(add(lambda c, x=x: c[x] * c["support"]), total) for x in rates), total)
    none = F.lit(None).cast("double")
    accuracy = row("accuracy", none, none, right / total, total)
    rows = held.select(*group, *extra, F.explode(F.concat("__c", F.array(macro, weighted, accuracy))).alias("__r"))
    return rows.select(*group, *extra, F.col("__r.label").alias("target"), *(_r(F.col(f"__r.{x}")).alias(x) for x in rates), F.col("__r.support").alias("support"))


def classification_report(preds: DataFrame, group: list[str]) -> DataFrame:
    """One row per target (each class, 'macro avg', 'weighted avg'):
    precision, recall, f1_score, support; plus target 'accuracy' carrying the
    accuracy in f1_score (scikit-learn's layout)."""
    return report_rows(matrix(preds, group), group)


def binary_metrics(preds: DataFrame, group: list[str], positive: str = "outcome") -> DataFrame:
    """A17 ('binary' average): accuracy and precision / recall / F1 of the
    positive class."""
    yt, yp = F.col("y_true") == positive, F.col("y_pred") == positive
    a = preds.groupBy(*group).agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
        F.count_if(yt & yp).alias("tp"), F.count_if(yp).alias("npred"), F.count_if(yt).alias("npos"))
    a = a.withColumn("precision", _div0(F.col("tp"), F.col("npred"))).withColumn("recall", _div0(F.col("tp"), F.col("npos")))
    a = a.withColumn("f1", _div0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return a.select(*group, F.lit("binary").alias("average"), *[_r(F.col(c)).alias(c) for c in ["accuracy", "precision", "recall", "f1"]])


def micro_metrics(preds: DataFrame, group: list[str]) -> DataFrame:
    """A17 ('micro' average): over single-label rows micro precision, recall
    and F1 all equal accuracy."""
    acc = _r(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")))
    a = preds.groupBy(*group).agg(acc.alias("accuracy"))
    return a.select(*group, F.lit("micro").alias("average"), "accuracy", F.col("accuracy").alias("precision"),
                    F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1"))


BUCKETS = 64


def running_counts(st: DataFrame, group: list[str], cols: list[str], score: str = "score", totals: bool = False) -> DataFrame:
    """Append ``<col>_below`` for each count column: its sum over the rows of the
    group with a smaller score; with ``totals`` also ``<col>_total``, the group's. Scores are distinct within a group; they may be
    any doubles, so quantiles only place the bucket edges and are never part of
    the result."""
    edges = st.groupBy(*group).agg(F.percentile_approx(score, [i / BUCKETS for i in range(1, BUCKETS)], 2000).alias("__e"))
    rows = st.join(edges, group).withColumn("__b", F.size(F.filter("__e", lambda e: e < F.col(score)))).drop("__e")
    per = rows.groupBy(*group, "__b").agg(*(F.sum(c).alias(f"__{c}") for c in cols))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)  # ``BUCKETS`` rows per group
    every = [F.sum(f"__{c}").over(whole).alias(f"{c}_total") for c in cols] if totals else []
    per = per.select(*group, "__b", *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in cols), *every)
    inside = Window.partitionBy(*group, "__b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(per, [*group, "__b"]).select(
        *st.columns, *((F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_below") for c in cols), *[f"{c}_total" for c in cols] * totals)


def _score_table(scores: DataFrame, group: list[str], is_pos) -> DataFrame:
    return scores.groupBy(*group, "score").agg(F.count_if(is_pos).alias("np"), F.count_if(~is_pos).alias("nn"))


def areas(scores: DataFrame, group: list[str], positive: str = "outcome") -> DataFrame:
    """A18 and A19 from one table of distinct scores and its running counts: group,
    ``auroc`` (ties counted half; null when a group lacks either class) and
    ``auprc`` (average precision, step-wise: over distinct thresholds, recall gain
    x precision). Input: group, y_true, score (of the positive class)."""
    st = running_counts(_score_table(scores, group, F.col("y_true") == positive), group, ["np", "nn"], totals=True)
    st = st.withColumnsRenamed({"np_total": "__P", "nn_total": "__N"}).withColumn("ctp", F.col("__P") - F.col("np_below")).withColumn("cfp", F.col("__N") - F.col("nn_below"))
    a = st.groupBy(*group).agg(
        F.sum(F.col("np") * (F.col("nn_below") + 0.5 * F.col("nn"))).alias("u"), F.sum("np").alias("P"), F.sum("nn").alias("N"),
        F.sum(F.col("np") * F.col("ctp") / (F.col("ctp") + F.col("cfp"))).alias("s"))
    return a.select(*group, _r(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N")))).alias("auroc"),
                    _r(F.when(F.col("P") > 0, F.col("s") / F.col("P"))).alias("auprc"))


def auroc(scores: DataFrame, group: list[str], positive: str = "outcome") -> DataFrame:
    """Area under the ROC curve."""
    return areas(scores, group, positive).select(*group, "auroc")


def auprc(scores: DataFrame, group: list[str], positive: str = "outcome") -> DataFrame:
    """Average precision."""
    return areas(scores, group, positive).select(*group, "auprc")


def auroc_ovo_weighted(long_scores: DataFrame, group: list[str], key: str) -> DataFrame:
    """One-vs-one multiclass AUROC, prevalence-weighted. For each class
    pair {a, b}: rows whose true class is a or b; AUROC of a-vs-b on the a
    score and of b-vs-a on the b score, averaged; pairs weighted by their
    share of rows. Input: group, key, y_true, label, score (one row per item
    and class). Each item's class-a row is emitted once per pair it takes
    part in: (classes - 1) times for the true class, once otherwise.
    ``n_dropped``: items left out because their class is not among the scored ones."""
    classes = long_scores.select(*group, "label").distinct()
    own = long_scores.where(F.col("label") == F.col("y_true"))
    # positives of direction (a -> b): the item's own-class score, for every b != a
    pos = (own.join(classes.withColumnRenamed("label", "b"), group)
           .where(F.col("b") != F.col("label"))
           .select(*group, F.col("label").alias("a"), "b", "score", F.lit(True).alias("is_pos")))
    # negatives of direction (a -> b): items of true class b, scored on class a
    neg = (long_scores.where(F.col("label") != F.col("y_true"))
           .select(*group, F.col("label").alias("a"), F.col("y_true").alias("b"), "score", F.lit(False).alias("is_pos")))
    d = pos.unionByName(neg)
    g2 = group + ["a", "b"]
    st = d.groupBy(*g2, "score").agg(F.count_if("is_pos").alias("np"), F.count_if(~F.col("is_pos")).alias("nn"))
    st = running_counts(st, g2, ["nn"])
    dir_auc = st.groupBy(*g2).agg(
        F.sum(F.col("np") * (F.col("nn_below") + 0.5 * F.col("nn"))).alias("u"),
        F.sum("np").alias("na"), F.sum("nn").alias("nb"))
    dir_auc = dir_auc.withColumn("auc", F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("u") / (F.col("na") * F.col("nb"))))
    pair = dir_auc.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).groupBy(*group, "lo", "hi").agg(
        F.avg("auc").alias("auc"), F.max(F.col("na") + F.col("nb")).alias("n_pair"))
    tot = own.groupBy(*group).agg(F.count(F.lit(1)).alias("n_all"))
    out = pair.join(tot, group).groupBy(*group).agg(
        (F.sum(F.col("auc") * F.col("n_pair") / F.col("n_all")) / F.sum(F.col("n_pair") / F.col("n_all"))).alias("auroc"), F.max("n_all").alias("n_all"))
    # Every item has a row per class; one whose own class is none of them is in no pair.
    items = long_scores.groupBy(*group).agg((F.count(F.lit(1)) / F.size(F.collect_set("label"))).cast("long").alias("n_items"))
    return out.join(items, group).select(*group, _r(F.col("auroc")).alias("auroc"), (F.col("n_items") - F.col("n_all")).alias("n_dropped"))
