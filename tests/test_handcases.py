"""Remaining FIXTURES hand cases: ties across classes, start heading equal
to end heading, blank negative text, label outside the list."""

from pyspark.sql import functions as F

from sectio.operators import classify as C
from sectio.operators import labels as L
from sectio.operators import sections as S

FILL = "Lorem ipsum dolor sit amet. " * 20


def test_argmax_tie_takes_first_label_in_order(spark):
    long = spark.createDataFrame([(1, "b", 0.4), (1, "a", 0.4), (1, "c", 0.1), (2, "c", 0.9), (2, "a", 0.2)],
                                 ["k", "label", "score"])
    got = {r["k"]: (r["label"], r["prob"]) for r in C.argmax_label(long, ["k"]).collect()}
    assert got == {1: ("a", 0.4), 2: ("c", 0.9)}
    rej = {r["k"]: r["label"] for r in C.reject_option(long, ["k"], threshold=0.5).collect()}
    assert rej == {1: "No outcome", 2: "c"}


def test_centroid_scoring_tie_takes_first_label(spark):
    model = spark.createDataFrame([(1, [("b", [1.0, 0.0]), ("a", [1.0, 0.0])])],
                                  "g int, __centroids array<struct<label:string,c:array<double>>>")
    model = model.select("g", F.array_sort("__centroids").alias("__centroids"))
    test = spark.createDataFrame([(7, 1, "a", [2.0, 0.0])], "k int, g int, cls string, v array<double>")
    r = C.score_centroids(test, model, ["g"], "k").first()
    assert r["y_pred"] == "a"


def test_same_heading_for_both_anchors_gives_empty_span(spark):
    t = FILL + "\n\n3. Results\n\nfindings here. " + "\n\n4. Discussion\n\nend"
    df = spark.createDataFrame([(1, t)], ["doc_id", "text"])
    r = S.results_text(S.locate_sections(df, end_anchor="results")).first()
    assert r["status"] == "ok" and r["start_idx"] == r["end_idx"] and r["results"] == ""


def test_start_after_end_is_rejected_but_equal_is_not(spark):
    t = FILL + "\n\nDiscussion\n\na. " + "\n\nResults\n\nb."
    df = spark.createDataFrame([(1, t)], ["doc_id", "text"])
    assert S.locate_sections(df).first()["status"] == "no_results"


def test_blank_and_missing_labels(spark):
    df = spark.createDataFrame([(1, "Hospital"), (2, None), (3, "Pain"), (4, " Mortality ")], "k int, label string")
    kept = sorted(r["k"] for r in L.exclude_labels(df).collect())
    assert kept == [2, 3, 4]  # missing label kept, as pandas / R keep it
    freq = sorted(r["k"] for r in L.frequent_labels(df, threshold=1).collect())
    assert freq == [1, 3, 4]  # value counts never include a missing label
    ovr = {r["k"]: r["label"] for r in L.collapse_one_vs_rest(df, "Pain").collect()}
    assert ovr == {1: "Other outcome", 2: "Other outcome", 3: "Pain", 4: "Other outcome"}
