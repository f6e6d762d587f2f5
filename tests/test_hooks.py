"""Hooks: a user's own encoder and tagger."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectio.operators import classify as C
from sectio.operators import encoders as EN
from sectio.operators import logistic as LG
from sectio.operators import phrases as P
from sectio.operators import similarity as SIM
from sectio.operators import taggers as TG

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def loader():
    """Loaders are made inside functions: workers cannot import this module."""
    def letter_encoder(path):
        """Letter counts, weighted by the shipped file."""
        weight = json.load(open(path))
        return lambda texts: [[t.count(c) * weight.get(c, 1.0) for c in LETTERS] for t in texts]

    return letter_encoder


letter_encoder = loader()


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


@pytest.fixture
def encoder(tmp_path):
    file = tmp_path / "weights.json"
    file.write_text(json.dumps({"e": 0.5, "z": 3.0}))
    return EN.Encoder("letters", 26, letter_encoder, str(file))


def test_embed_ships_the_model_and_keeps_nulls(spark, encoder):
    rows = [(i, t, 7) for i, t in enumerate(["zebra", None, "", "zebra", "e" * 100000])]
    df = spark.createDataFrame(rows, "id long, t string, `a.b` int").repartition(3)
    got = {r.id: r.v for r in EN.embed(df, "t", encoder).collect()}
    plain = letter_encoder(encoder.file)
    assert got == {i: plain([t])[0] if t is not None else None for i, t, _ in rows}
    assert EN.embed(df.limit(0), "t", encoder).columns == ["id", "t", "a.b", "v"]


def bad_loaders():
    def wrong(_):
        return lambda texts: np.zeros((len(texts), 3))

    def broken(_):
        def encode(texts):
            raise KeyError("no such word")

        return encode

    return [(wrong, "gave shape"), (broken, "no such word")]


@pytest.mark.parametrize("load, said", bad_loaders())
def test_bad_encoders_say_so(spark, load, said):
    df = spark.createDataFrame([("x",)], "t string")
    with pytest.raises(Exception, match=said):
        EN.embed(df, "t", EN.Encoder(f"bad_{load.__name__}", 4, load)).collect()


def test_negatives_by_an_encoder(spark, encoder):
    positives = ["wound infection", "mortality", "pain", None, "mortality", ""]
    cands = [(1, "infection wound"), (1, "hospital"), (2, "hospital"), (2, "1234"), (3, "zz"), (3, None), (3, "")]
    pos = spark.createDataFrame(list(enumerate(positives)), "item_id long, text string")
    cand = spark.createDataFrame(cands, "doc_id long, phrase string")
    plain = letter_encoder(encoder.file)
    want = {c: max(cosine(plain([c])[0], plain([p])[0]) for p in positives if p is not None) if c is not None else 0.0 for _, c in cands}
    for size in (1000, 1):
        got = {r.phrase: r.max_sim for r in EN.best_similarity(cand, "phrase", pos, "text", encoder, size, size).collect()}
        assert got == pytest.approx(want, abs=1e-6)
    kept = SIM.negatives_by_similarity(cand, ["doc_id"], "phrase", pos, "item_id", "text", encoder=encoder)
    assert {(r.doc_id, r.phrase) for r in kept.collect()} == {(d, c) for d, c in cands if c is not None and want[c] <= 0.85}
    assert {r.max_sim for r in EN.best_similarity(cand, "phrase", pos.limit(0), "text", encoder).collect()} == {0.0}


def test_heads_take_an_encoder(spark, encoder):
    rows = [(i, ("zoo maze" if i % 2 else "tree bee") + " abc"[: i % 4], "x" if i % 2 else "y") for i in range(40)] + [(99, None, "y")]
    df = spark.createDataFrame(rows, "vec_id long, t string, cls string")
    head = LG.fit(df, "t", "cls", encoder=encoder)
    out = LG.predict(df, head, "t", encoder).collect()
    assert all(r.predicted == r.cls for r in out if r.t) and all(0.5 <= r.prob <= 1 for r in out)
    held = EN.embed(df.where("t is not null"), "t", encoder)
    assert C.nearest_centroid(held).where((F.col("label") == F.col("y_pred")) & (F.col("y_true") != F.col("y_pred"))).count() == 0


T = TG.Token


def test_phrases_of_a_parsed_sentence():
    # "The severe wound infections of treated patients, painful, after surgery were rare"
    tokens = [T("The", "DET", 3, "det"), T("severe", "ADJ", 3, "amod"), T("wound", "NOUN", 3, "compound"), T("infections", "NOUN", 11, "nsubj"),
              T("of", "ADP", 3, "prep"), T("treated", "ADJ", 6, "amod"), T("patients", "NOUN", 4, "pobj"), T(",", "PUNCT", 3, "punct"),
              T("painful", "ADJ", 3, "amod"), T("after", "ADP", 3, "prep"), T("surgery", "NOUN", 9, "pobj"), T("were", "AUX", 11, "ROOT"), T("rare", "ADJ", 11, "acomp")]
    assert TG.noun_phrases(tokens) == ["painful The severe wound infections of treated patients after surgery"]
    assert TG.noun_phrases([T("pain", "NOUN", 0), T("and", "CCONJ", 0), T("30-day", "ADJ", 3), T("mortality", "NOUN", 0)]) == ["pain", "30-day mortality"]


def test_phrases_of_tags_alone():
    tokens = [T(w, t) for w, t in [("the", "DET"), ("rate", "NOUN"), ("of", "ADP"), ("the", "DET"), ("deep", "ADJ"), ("infection", "NOUN"), ("in", "ADP"), ("patients", "NOUN"),
                                   ("was", "VERB"), ("5", "NUM"), ("high", "ADJ"), ("at", "ADP")]]
    assert TG.noun_phrases(tokens) == ["the rate of the deep infection", "patients"]
    assert TG.noun_phrases(tokens, tails=2) == ["the rate of the deep infection in patients"]
    assert TG.noun_phrases([]) == [] and TG.chunks(["ADJ", "ADJ", "DET"]) == []
    assert TG.chunks(["DET", "ADJ", "VERB", "NOUN", "NUM", "NOUN", "ADJ"]) == [(3, 6)]


def test_the_default_rule_as_a_tagger_gives_the_same_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "The incidence of the wound infection and 30-day mortality of patients in 2020. Of the 5 of 6 in pain, x of y of z."), (-2, None), (-3, "")], docs.schema)
    sents = P.explode_sentences(docs.union(extra), "text", ["doc_id"])
    plain = P.explode_phrases(sents, ["doc_id"])
    hooked = P.explode_phrases(sents, ["doc_id"], tagger=TG.stop_words())
    a, b = (sorted((r.doc_id, r.sent_idx, r.phrase_idx, r.phrase) for r in d.collect()) for d in (plain, hooked))
    assert len(a) > 100 and a == b


def test_taggers_that_fail_say_so(spark):
    sents = spark.createDataFrame([(1, 0, "a b")], "doc_id long, sent_idx int, sentence string")

    def load():
        return lambda sentences: []

    with pytest.raises(Exception, match="gave 0 results"):
        P.explode_phrases(sents, ["doc_id"], tagger=TG.Tagger("empty", load)).collect()
