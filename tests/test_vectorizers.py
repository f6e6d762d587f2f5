"""Text vectorisers against numpy, and the search over them."""

import hashlib
import math
from collections import Counter

import numpy as np

from sectio.operators import textmodel as TM
from sectio.operators import vectorizers as V
from sectio.plans import load_all, q_encoders, stages

SMALL = "/root/testdata/sf0.001"
TEXTS = ["wound infection rate", "infection of the wound", "mortality at 30 days", "30 day mortality", "pain scores", "pain", "zz", None, "severe pain scores at day 30", "quality of life"]


def plain():
    """Dense TF-IDF matrix, rows by text, columns by gram."""
    counts = [Counter(t.lower()[i:i + 3] for i in range(len(t) - 2)) if t else Counter() for t in TEXTS]
    grams = sorted(set().union(*counts))
    df = {g: sum(g in c for c in counts) for g in grams}
    x = np.array([[c[g] * math.log(len(TEXTS) / df[g]) for g in grams] for c in counts])
    norm = np.sqrt((x**2).sum(1, keepdims=True))
    return grams, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def bits(g):
    return int(hashlib.md5(g.encode()).hexdigest()[:8], 16)


def test_vectors_against_numpy(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    w = V.weights(df, "doc_id", "text")
    grams, x = plain()
    real = [i for i in range(len(TEXTS)) if x[i].any()]
    got = {(r.doc_id, r.gram): r.x for r in w.collect()}
    assert set(got) == {(i, g) for i in range(len(TEXTS)) for g, v in zip(grams, x[i]) if v}
    assert all(abs(v - x[i, grams.index(g)]) < 1e-12 for (i, g), v in got.items())
    omega = np.array([[1.0 if bits(g) >> j & 1 else -1.0 for j in range(32)] for g in grams])
    want = {"projected": x @ omega, "hashed": np.stack([np.bincount([bits(g) % V.BUCKETS for g in grams], x[i] * omega[:, 31], V.BUCKETS) for i in range(len(TEXTS))])}
    q, r = np.linalg.qr(x.T @ (x @ omega[:, :V.NARROW]))
    want["reduced"] = x @ (q * np.sign(np.diag(r)))
    for name, make in V.VECTORIZERS.items():
        v = {r.doc_id: r.v for r in make(w, "doc_id").collect()}
        assert sorted(v) == real
        assert all(np.allclose(v[i], want[name][i], atol=1e-6) for i in real), name
    # The basis holds nearly all of what the best of its size could.
    best = np.linalg.svd(x, compute_uv=False)
    assert (want["reduced"] ** 2).sum() > 0.9 * (best[:V.NARROW] ** 2).sum()
    assert V.hashed(w.limit(0), "doc_id").collect() == [] and V.reduced(w.limit(0), "doc_id").collect() == []


def test_search_halves_and_reads_no_test_rows(spark, monkeypatch):
    load_all()
    stages.clear()
    seen = []
    real = q_encoders.scored
    monkeypatch.setattr(q_encoders, "scored", lambda rows, test, q: seen.append((test, sorted(r.split for r in rows.select("split").distinct().collect()), sorted(r.model for r in rows.select("model").distinct().collect()))) or real(rows, test, q))
    trials = q_encoders.halving(spark, SMALL).orderBy("number").collect()
    assert [s[:2] for s in seen] == [("eval", ["eval", "train"])] * 3 and [len(s[2]) for s in seen] == [3, 2, 1]
    assert [t.number for t in trials] == list(range(6)) and [t.run for t in trials] == [1, 1, 1, 2, 2, 4]
    first = sorted(trials[:3], key=lambda t: (-t.value, t.model))
    assert {t.model for t in trials[3:5]} == {t.model for t in first[:2]}


def test_logistic_head_against_plain_steps(spark):
    """Probabilities, and that the steps come near the optimum of the penalised loss."""
    rows = [(f"k{i}", ("wound infection " if i % 2 else "we thank all ") + "abcdefgh"[i % 8:] , "outcome" if i % 2 else "not outcome") for i in range(40)] + [("n", None, "outcome"), ("m", "x", None)]
    train = spark.createDataFrame(rows, "k string, text string, cls string")
    model = TM.fit_head(train, "k", "text", "cls")
    scored = {r.t: r for r in TM.score_texts(spark.createDataFrame([("infection",), ("thank",), ("qqq",), ("",), (None,)], "t string"), "t", model).collect()}
    assert scored["infection"].label == "outcome" and scored["thank"].label == "not outcome" and scored["infection"].prob > 0.7
    assert all(abs(sum(s.score for s in r.scores) - 1) < 2e-6 and r.prob == max(s.score for s in r.scores) for r in scored.values())
    assert scored["qqq"].scores == scored[""].scores == scored[None].scores
    rng = np.random.default_rng(0)
    row, gram, y = np.repeat(np.arange(60), 5), rng.integers(0, 30, 300), rng.integers(0, 3, 60)
    value = np.full(300, 5**-0.5)

    def loss(w, b):
        x = np.zeros((60, 30))
        np.add.at(x, (row, gram), value)
        s = x @ w + b
        return np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(60), y]) + (w**2).sum() / 120

    few, many = (loss(*TM.fit_steps(row, gram, value, y, 30, 3, steps=n)) for n in (TM.STEPS, 2000))
    assert many <= few < many + 1e-3
