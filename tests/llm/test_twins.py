"""Quality classifier and language identification against plain Python, score by
score: the learned numbers are taken over, all the rest is done again."""

import math
import re
import zlib

import numpy as np
import pytest

from sectio.llm import language as L
from sectio.llm import quality as Q


def plain_grams(text):
    """Hashed n-grams of one text, by the definition: 1 to 4 characters of a word
    and the marks at its two ends."""
    codes = [0] + [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else (ord(c) if c.isalpha() else 0) for c in text] + [0]
    out = []
    for n in range(1, 5):
        for i in range(len(codes) - n + 1):
            own = codes[i:i + n]
            if n == 1 and not own[0]:
                continue
            if n > 1 and (not all(own[1:-1]) or not (own[0] or own[-1])):
                continue
            h = 0
            for c in own:
                h = ((h ^ (c or 1)) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            out.append((((h * ((0x85EBCA6B + 2 * n) & 0xFFFFFFFF)) & 0xFFFFFFFF) >> 16) % L.DIMS)
    return out


def plain_decide(model, text):
    grams = plain_grams(text)
    if not grams or not model.families:
        return "und", 0.0
    margins = [sum(float(model.weights[g, k]) for g in grams) / len(grams) + model.bias[k] for k in range(model.weights.shape[1])]
    own, pairs = margins[:len(model.families)], margins[len(model.families):]
    top = max(range(len(own)), key=lambda i: own[i])
    squash = lambda v: 1 / (1 + math.exp(-3 * max(-30, min(30, v))))
    score = squash((own[top] - max(v for i, v in enumerate(own) if i != top)) / 2) if len(own) > 1 else 1.0
    langs = model.members[model.families[top]]
    if len(langs) == 1:
        return langs[0], score
    votes, total = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
    least = {x: math.inf for x in langs}
    for (a, b), v in zip(model.pairs, pairs):
        if a in votes:
            votes[a if v >= 0 else b] += 1
            total[a] += v
            total[b] -= v
            least[a], least[b] = min(least[a], v), min(least[b], -v)
    best = max(langs, key=lambda x: (votes[x], total[x]))
    return best, score * squash(least[best])


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    extra = [(9001, None, "en"), (9002, "", "en"), (9003, "12 !!", None), (9004, "a", "de"), (9005, "Ünïcode Straße İstanbul ñ", None), (9006, "abc" * 30000, "en"), (9007, "word " * 20000, "en")]
    return [(r.doc_id, r.text, r.lang) for r in docs] + extra


def test_language_scores(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df.where(~L.held_out()))
    assert len(model.families) >= 2 and model.pairs
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(df, model).collect()}
    for doc, text, _ in [r for r in rows if r[0] % 4 == 0 or r[0] > 9000]:
        lang, score = plain_decide(model, text or "")
        assert got[doc][0] == lang and got[doc][1] == pytest.approx(score, abs=1e-4), doc


def test_long_runs_of_letters_have_no_ends_inside():
    text = "".join(chr(97 + (i * i) % 26) for i in range(2 * L.BLOCK + 5)) + " " + "xy" * L.BLOCK
    want = np.bincount(plain_grams(text), minlength=L.DIMS)
    assert np.array_equal(np.round(L.frequencies(text) * want.sum()).astype(int), want)
    w = np.random.default_rng(0).normal(size=(L.DIMS, 3)).astype(np.float32)
    got = L.mean_weights(["short one", text, "", "z"], w)
    assert np.allclose(got[1], want @ w.astype(float) / want.sum(), atol=1e-5) and got[2] is None
    assert np.allclose(got[0], w[plain_grams("short one")].astype(float).mean(0), atol=1e-5)


def plain_buckets(text):
    tokens = re.findall(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+", text or "")
    out = []
    for i, t in enumerate(tokens):
        kind = "<digits>" if t.isdigit() else "<shout>" if len(t) > 1 and t.isupper() else t.lower()
        b = zlib.crc32(kind.encode()) % Q.BUCKETS
        before = tokens[i - 1] if i else ""
        again = i and t.lower() == before.lower() and t[0].isalpha() and Q.bucket(t) == Q.bucket(before)
        out.append(Q.AGAIN_BUCKET if again else b)
    return out


def plain_vectors(texts):
    """Word vectors: every token adds the index vectors of two neighbours a side."""
    index, total = Q.index_vectors(), np.zeros((Q.BUCKETS, Q.DIMS), np.int64)
    for t in texts:
        own = plain_buckets(t)
        for i, b in enumerate(own):
            for j in range(max(0, i - 2), min(len(own), i + 3)):
                if j != i:
                    total[b] += index[own[j]]
    norm = np.sqrt((total.astype(float) ** 2).sum(1, keepdims=True))
    return np.divide(total, norm, out=np.zeros(total.shape), where=norm > 0)


def test_word_vectors_and_scores(spark, rows, monkeypatch):
    some = [(d, t) for d, t, _ in rows if d % 5 == 0 or d > 9000]
    df = spark.createDataFrame(some, "doc_id long, text string")
    words = plain_vectors([t for _, t in some])
    assert np.allclose(Q.word_vectors(df), words, atol=1e-12)
    labels = spark.createDataFrame([(d, i % 2) for i, (d, _) in enumerate(some)], "doc_id long, quality int")
    fitted = []
    real = Q.fit_network
    monkeypatch.setattr(Q, "fit_network", lambda x, y: fitted.append(real(x, y)) or fitted[-1])
    got = {r.doc_id: r.score for r in Q.score(df, labels).collect()}
    net, table = fitted[0], np.hstack([words, Q.index_vectors()]).astype(np.float32)
    for doc, text in some:
        own = table[plain_buckets(text)].astype(float)
        x = np.concatenate([own.mean(0), own.std(0)]) if len(own) else np.zeros(4 * Q.DIMS)
        hidden = [math.tanh(float(((x - net.shift) / net.scale) @ net.w1[:, k] + net.b1[k])) for k in range(len(net.b1))]
        logit = (sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / net.temperature
        assert got[doc] == pytest.approx(1 / (1 + math.exp(-logit)), abs=2e-3), doc
