"""Decontamination against a full edit-distance table; language ID held out."""

import random

import pytest

from sectio.llm import decontaminate as D, language as L, queries

SMALL = "/root/testdata/sf0.001"


def best_distance(pattern, text):
    """Least edit distance between the pattern and any substring."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[:], 0
        for j, p in enumerate(pattern, 1):
            row[j] = min(last[j - 1] + (p != c), last[j] + 1, row[j - 1] + 1)
        best = min(best, row[-1])
    return best


def damage(text, errors, rng):
    t = list(text)
    for _ in range(errors):
        at = rng.randrange(len(t))
        rng.choice([lambda: t.__setitem__(at, "z"), lambda: t.pop(at), lambda: t.insert(at, "z")])()
    return "".join(t)


def test_normalised_alike_in_narrow_and_wide_texts():
    for t in ["A_b--C\xa0É ß!9", "", " \n", "½x²", "".join(map(chr, range(256)))]:
        wide = D.GAP.sub(" ", (t + "—").lower()).strip()
        assert D.normalise(t) == (f" {wide} " if wide else "")


def test_bit_parallel_distance():
    rng = random.Random(0)
    for _ in range(300):
        p = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90)))
        assert D.myers(D.letter_masks(p), len(p), t)[0] == best_distance(p, t)


@pytest.mark.parametrize("rate", [0.0, 0.08, 0.15])
def test_leaks_against_the_full_table(words, rate):
    rng = random.Random(1)
    items = [(i, D.normalise(words(rng.randint(1, 14), 100 + i))) for i in range(12)]
    matcher = D.Matcher(items, rate)
    for k in range(80):
        item = rng.choice(items)[1]
        body = words(rng.randint(0, 12), 500 + k) + " " + damage(item, rng.randint(0, 8), rng) + " " + words(rng.randint(0, 12), 900 + k)
        norm = D.normalise(body)
        want = {i: d for i, t in items if (d := best_distance(t, norm)) <= D.budget(t, rate)}
        got = {i: d for i, d, _ in matcher.leaks(body)}
        assert set(got) == set(want)
        assert all(got[i] <= D.budget(dict(items)[i], rate) and got[i] >= want[i] for i in got)


def test_operator_cases(spark, words):
    item = words(30, 1)
    docs = [(1, words(40, 2) + "\n" + item.upper() + "! " + words(9, 3)), (2, words(300, 4)), (3, None), (4, ""), (1, item), (None, item.replace(" ", "  \t")), (5, words(20000, 5) + " " + item)]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in docs], "doc_id long, text string, item_id int, row string")
    items = spark.createDataFrame([(7, item), (8, None), (9, " !! "), (7, item), (10, "zzzzqqq wwww")], "item_id long, text string")
    for block in (4 << 20, 50):
        found = sorted((r.doc_id or 0, r.item_id, r.distance) for r in D.find_leaks(df.drop("item_id"), items, block_chars=block).collect())
        assert found == [(0, 7, 0), (1, 7, 0), (1, 7, 0), (5, 7, 0)]
        kept = D.keep_clean(df, items, block_chars=block)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert D.find_leaks(df.drop("item_id").limit(0), items).collect() == []
    assert D.keep_clean(df, items.limit(0)).count() == len(docs)


def test_query_finds_what_plain_search_finds(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r.distance for r in queries.QUERIES["op10_benchmark_decontamination"](spark, SMALL).collect()}
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if D.normalise(i.text) in D.normalise(d.text or "")}
    assert exact <= set(got) and all(got[k] == 0 for k in exact)
    by = {d.doc_id: d.text for d in docs}
    text = {i.item_id: D.normalise(i.text) for i in items}
    for (d, i), dist in got.items():
        assert best_distance(text[i], D.normalise(by[d])) == dist


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "lang").join(queries.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(out) > 150
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_labels_of_the_held_out_fold_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(200)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, 50).collect()}
    spoilt = docs.withColumn("lang", F.when(L.held_out(), "xx").otherwise(F.col("lang")))
    assert {r.doc_id: (r.lang_pred, r.score) for r in L.identify(spoilt, 50).collect()} == plain


def test_language_cases(spark):
    rows = [(1, "the cat and the dog", "en", "k"), (2, "le chat et le chien", "fr", "k"), (3, None, "en", "k"), (4, "12 !?", None, None), (5, "", "en", "k"),
            (6, "le le le " * 30000, None, "k"), (1, "the cat and the dog", "en", "k"), (None, "the dog", "en", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = L.identify(df)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "held_out"]
    by = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in out.collect()}
    assert by[(3, None)] == by[(4, "12 !?")] == by[(5, "")] == ("und", 0.0)
    kept = L.keep_known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5})
    assert L.identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in L.identify(df.where("lang is null and doc_id = 6")).collect()} == {"und"}


def test_blocks_change_nothing(words, monkeypatch):
    import numpy as np

    texts = [words(30, 1), "", "É a𐐀b ß", words(4000, 2), "x" * 500, "12"]
    weights = np.random.default_rng(0).normal(size=(L.DIMS, 3)).astype(np.float32)
    want = [None if (f := L.frequencies(t)) is None else f @ weights for t in texts]
    for size in (1 << 15, 1000):
        monkeypatch.setattr(L, "BLOCK", size)
        got = L.mean_weights(texts, weights)
        assert [g is None for g in got] == [w is None for w in want]
        assert all(np.allclose(g, w, atol=1e-4) for g, w in zip(got, want) if w is not None)


def test_three_languages_of_one_family_vote():
    import numpy as np

    m = L.Model(["a"], {"a": ["x", "y", "z"]}, [("x", "y"), ("x", "z"), ("y", "z")], np.zeros((1, 4)), np.zeros(4))
    assert m.decide(np.array([0, -1, 1, 2.0]))[0] == "y"
    assert m.decide(np.array([0, 1, -3, 1.5]))[0] == "z" and m.decide(np.array([0, 0, 0, 0.0]))[0] == "x"


def test_language_sample_holds_one_text_an_id(spark, words):
    rows = [(1, "en", f"the same id with text {'abcdefghij'[i % 10]}") for i in range(300)] + [(2, "en", "a copy of it")] * 300 + [(i, "de", "123 --") for i in range(300)]
    rows += [(i, "de", f"das ist ein Satz {i}") for i in range(300, 306)] + [(None, "de", "kein Platz"), (3, None, "x"), (4, "en", None)]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    got = sorted((r.lang, r.id) for r in L.sampled(df, 5).collect())
    assert [x for x in got if x[0] == "en"] == [("en", 1), ("en", 2)] and len(got) == 7
    # Rows without letters take no places.
    assert L.fit(df, id_col="id", per_lang=5).members == {"germanic": ["de", "en"]}
