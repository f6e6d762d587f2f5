"""The text model is fitted on every training text, on the driver and in jobs alike."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from sectio.functions.labels import NOT_OUTCOME, OUTCOME
from sectio.operators import textmodel as TM
from sectio.plans import load_all, q_cascade, stages

MORE = 4300  # training texts: more than a draw of FIT_ROWS


def plain(rows):
    """Weights by gram, and intercepts, of dense steps over all texts with a class."""
    held = [(t or "", y) for _, t, y in rows if y is not None]
    counts = [Counter(t.lower()[i:i + 3] for i in range(len(t) - 2)) for t, _ in held]
    grams, labels = sorted(set().union(*counts)), sorted({y for _, y in held})
    x = np.array([[c[g] for g in grams] for c in counts], float)
    x /= np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)
    target, mean = np.eye(len(labels))[[labels.index(y) for _, y in held]], x.mean(0)
    x -= mean
    w = z = np.zeros((len(grams), len(labels)))
    b = zb = np.zeros(len(labels))
    for t in range(TM.STEPS):
        p = np.exp(x @ z + zb)
        rest = (p / p.sum(1, keepdims=True) - target) / len(held)
        new, newb = z - TM.RATE * (x.T @ rest + TM.PENALTY / len(held) * z), zb - TM.RATE * rest.sum(0)
        z, zb, w, b = new + t / (t + 3) * (new - w), newb + t / (t + 3) * (newb - b), new, newb
    return labels, dict(zip(grams, w)), b - mean @ w


def in_draw_order(keys):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{TM.SEED}|{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("local", [TM.LOCAL_FEATURES, 0])
def test_all_texts_are_fitted(spark, local, monkeypatch):
    """Same weights as dense steps over all texts; the last ones of the draw's order hold a class of their own."""
    monkeypatch.setattr(TM, "SLOT_BYTES", 240)
    keys = in_draw_order(f"k{i}" for i in range(MORE))
    rows = [(k, f"{'wound pain days'.split()[i % 3]} {'abcdefgh'[i % 8:]}", ("a", "b")[i % 2] if i < TM.FIT_ROWS else "late") for i, k in enumerate(keys)]
    rows += [("x", None, "a"), ("y", "ab", "b"), ("z", "unseen gram", None), ("k1", "twice the key", "b"), (None, "no key", "a")]
    train = spark.createDataFrame(rows, "k string, text string, cls string").repartition(5)
    got = {r.gram: r for r in TM.fit_head(train, "k", "text", "cls", local=local).collect()}
    labels, w, b = plain(rows)
    assert got.pop("").w == pytest.approx(b) and labels == ["a", "b", "late"]
    assert set(got) == set(w) and all(np.allclose(got[g].w, v) for g, v in w.items())


@pytest.mark.parametrize("local", [TM.LOCAL_FEATURES, 0])
def test_texts_without_grams_and_without_classes(spark, local):
    train = spark.createDataFrame([("k", None, "a"), ("l", "ab", "b"), ("m", "", "b")], "k string, text string, cls string")
    model = TM.fit_head(train, "k", "text", "cls", local=local).collect()
    assert [(r.gram, r.labels) for r in model] == [("", ["a", "b"])] and model[0].w[1] > model[0].w[0]
    with pytest.raises(ValueError):
        TM.fit_head(train.where("k = 'n'"), "k", "text", "cls", local=local)


@pytest.fixture
def cascade(spark, tmp_path, monkeypatch):
    """Small tables in place of the cascade's inputs: the texts that come after the
    first ``FIT_ROWS`` in seeded order are the only ones of their class."""
    load_all()
    stages.clear()

    def train(text, cls, late_text, late):
        keys = in_draw_order(f"k{i}" for i in range(MORE))
        return spark.createDataFrame([(k, text, cls) if i < TM.FIT_ROWS else (k, late_text, late) for i, k in enumerate(keys)], "k string, text string, cls string")

    one, two = train("wound infection", OUTCOME, "thank the nurses", NOT_OUTCOME), train("wound infection", "Pain", "death rate", "Mortality")
    phrases = [(1, 0, 0, "wound infection", "Wound infection."), (2, 0, 0, "thank the nurses", "We thank the nurses.")]
    loc = spark.createDataFrame([(1, "s1", "ok"), (2, "s2", "ok"), (4, "s4", "no_results"), (5, "s5", "ok")], "doc_id long, source string, status string")
    outcomes = spark.createDataFrame([(1, "wound infection"), (2, "death rate"), (2, "death rate"), (None, None)], "item_id long, text string")
    held = spark.createDataFrame(phrases, "doc_id long, sent_idx int, phrase_idx int, phrase string, sentence string")
    for name, df in (("stage1_train", one), ("stage2_train", two), ("phrases", held), ("sections", loc), ("outcome_texts", outcomes)):
        monkeypatch.setattr(q_cascade, name, lambda s, d, df=df: df)
    yield lambda name: sorted(map(tuple, getattr(q_cascade, f"q_{name}")(spark, str(tmp_path)).collect()), key=repr)
    stages.clear()


def test_articles_without_outcomes_by_all_texts(cascade):
    """An article of a phrase that only the last training texts tell from an outcome."""
    assert cascade("articles_without_outcomes") == [(2, "s2"), (5, "s5")]


def test_corpus_status_by_all_texts(cascade):
    assert cascade("corpus_status") == [("no_outcomes", 2), ("no_results", 1), ("ok", 1)]


def test_reject_option_by_all_texts(cascade):
    """A domain that only the last training texts have is one that a text can get."""
    assert [r[:2] for r in cascade("reject_option")] == [(1, "Pain"), (2, "Mortality"), (2, "Mortality")]
