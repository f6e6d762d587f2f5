"""Trigrams counted inside the tasks against those of the column expression."""

import math

from pyspark.sql import functions as F

from sectio.functions import grams as G
from sectio.functions import text as T
from sectio.operators import logistic as LG
from sectio.operators import phrases as P
from sectio.operators import textmodel as TM
from sectio.operators import vectorizers as V

ODD = ["Wound wound", "aaaa", "ab", "", None, "a😀bcd", "😀😀😀x", "xy😀", "İstanbul ẞ\n\tǅ", "é" * 5, "abc" * 3000]


def exploded(df, key, text):
    n = df.select(key, F.explode(T.trigrams(F.col(text))).alias("gram")).groupBy(key, "gram").count()
    return {(r[0], r[1]): r[2] for r in n.collect()}


def test_counts_per_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "k long, t string")
    got = G.with_gram_counts(df, "t").collect()
    assert [(r.k, r.t) for r in got] == list(enumerate(ODD))
    assert {(r.k, g.gram): g.n for r in got for g in r.grams} == exploded(df, "k", "t")
    assert all(abs(r.norm**2 - sum(g.n**2 for g in r.grams)) < 1e-6 for r in got)


def test_counts_per_key_in_any_slices(spark, monkeypatch):
    """A key's texts are counted together, over slices too; null keys are one key."""
    rows = [(None if i % 7 == 0 else i % 5, t) for i, t in enumerate(ODD * 8)] + [(9, None), (10, "zz")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    want = exploded(df, "k", "t")
    for size in (4 << 20, 1):
        monkeypatch.setattr(G, "SLICE_BYTES", size)
        got = G.key_gram_counts(df, "k", "t").collect()
        assert sorted((r.k is None, r.k) for r in got if r.k is not None) == [(False, k) for k in (0, 1, 2, 3, 4, 9, 10)] and len(got) == 8
        assert {(r.k, g.gram): g.n for r in got for g in r.grams} == want


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weights_make_no_row_per_occurrence(spark):
    """No occurrence of a gram is a row of a plan, and rows are not dealt by gram."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    plan = exchanges(V.weights(df, "doc_id", "text"))
    assert "regexp_extract_all" not in plan and "hashpartitioning(gram" not in plan


def test_texts_are_scored_by_distinct_grams(spark):
    """A text's repeats of a gram are one row, and scores are those of all occurrences."""
    model = spark.createDataFrame([("", [0.5, -0.5], ["a", "b"]), ("aaa", [1.0, 0.0], None), ("xyz", [0.0, 2.0], None)], TM.MODEL)
    items = spark.createDataFrame([("aaaaa",), ("xyzxyz",), ("",), (None,), ("aaaaa",)], "t string")
    scored = TM.score_texts(items, "t", model)
    assert "regexp_extract_all" not in exchanges(scored)
    got = {r.t: r.scores[0].score for r in scored.collect()}
    share = lambda a, b: round(1 / (1 + math.exp(b - a)), 6)
    assert got == {"aaaaa": share(0.5 + 3 / 3, -0.5), "xyzxyz": share(0.5, -0.5 + 4 / math.sqrt(4 + 1 + 1)), "": share(0.5, -0.5), None: share(0.5, -0.5)}


def test_word_counts_are_made_once(spark):
    texts = spark.createDataFrame([("We saw approx. ten. It was so. Dr. Who, approx. nine, left.",)], "text string")
    scores = P.abbreviation_scores(texts, "text")
    assert "regexp_extract_all" not in exchanges(scores) and scores.count() > 0


def test_vectors_are_made_once_for_fit_and_prediction(spark):
    rows = [(i, ("wound " if i % 2 else "thanks ") + "abcdefgh"[i % 8:], "y" if i % 2 else "n") for i in range(30)]
    df = spark.createDataFrame(rows, "k long, text string, cls string")
    ready = LG.vectors(df, "text", 64).drop("text")
    a, b = LG.fit(df, "text", "cls", 64), LG.fit(ready, "text", "cls", 64)
    want = {r.k: r.prob for r in LG.predict(df, a, "text").collect()}
    got = LG.predict(ready, b, "text")
    assert got.columns == ["k", "cls", "probabilities", "prob", "predicted"]
    assert all(abs(r.prob - want[r.k]) < 1e-9 for r in got.collect())
