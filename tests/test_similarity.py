"""Trigram cosine against brute force, whatever the number of blocks."""

import itertools
import math
from collections import Counter

import pytest

from sectio.operators import similarity as SIM


def grams(t):
    t = t.lower()
    return Counter(t[i:i + 3] for i in range(len(t) - 2))


def cos(a, b):
    ga, gb = grams(a), grams(b)
    na = math.sqrt(sum(v * v for v in ga.values()))
    nb = math.sqrt(sum(v * v for v in gb.values()))
    if not na or not nb:
        return 0.0
    return sum(v * gb[g] for g, v in ga.items()) / (na * nb)


POS = ["wound infection rate", "all-cause mortality at 30 days", "pain scores", "ab"]
CAND = ["wound infection", "mortality", "hospital stay", "xy", "pain score at rest", "infection rate"]


def test_best_similarity_matches_brute_force_in_any_number_of_blocks(spark):
    pos = spark.createDataFrame(list(enumerate(POS)), ["item_id", "text"])
    cand = spark.createDataFrame([(c,) for c in CAND], ["phrase"])
    want = {c: round(max(cos(c, p) for p in POS), 6) for c in CAND}
    a = {r["phrase"]: r["max_sim"] for r in SIM.best_similarity(cand, "phrase", pos, "item_id", "text").collect()}
    b = {r["phrase"]: r["max_sim"] for r in SIM.best_similarity(cand, "phrase", pos, "item_id", "text", block_postings=10, slice_rows=2).collect()}
    assert a == pytest.approx(want) and b == pytest.approx(want)


def test_cosine_of_one_in_128_rounds_alike_in_blocks(spark):
    """1/128 = 0.0078125 lies on a half at six digits: rounded up, as SQL does."""
    text = lambda n, first: first + "".join(chr(0x4E00 + i) for i in range(n + 2 - len(first)))
    pos = spark.createDataFrame([(1, text(256, "xyz")), (2, "unrelated")], ["item_id", "text"])
    other = "xyz" + "".join(chr(0x6E00 + i) for i in range(63))
    cand = spark.createDataFrame([(other,), (None,), ("",)], "phrase string")
    for cells in (10**9, 50):
        got = {r["phrase"]: r["max_sim"] for r in SIM.best_similarity(cand, "phrase", pos, "item_id", "text", block_postings=cells).collect()}
        assert got == {other: 0.007813, None: 0.0, "": 0.0}


def test_pair_stats_against_brute_force(spark):
    pos = spark.createDataFrame(list(enumerate(POS[:3] + ["blood loss"])), ["item_id", "text"])
    texts = POS[:3] + ["blood loss"]
    vals = sorted(round(cos(a, b), 6) for a, b in itertools.combinations(texts, 2))
    r = SIM.pair_stats(pos, "item_id", "text").first()
    mid = (vals[2] + vals[3]) / 2
    assert r["n_pairs"] == 6 and r["min_sim"] == vals[0] and r["median_sim"] == pytest.approx(mid)


def test_pair_histogram_in_blocks(spark):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in range(70)] + ["same text"] * 5 + [None, "ab"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    real = [t for t in texts if t and len(t) >= 3]
    want: Counter = Counter(round(cos(a, b), 6) for a, b in itertools.combinations(real, 2))
    for side in (7, 1000):
        got = {r["cos"]: r["freq"] for r in SIM.pair_histogram(items, "item_id", "text", side).collect()}
        assert sum(got.values()) == len(real) * (len(real) - 1) // 2
        assert {round(k, 5): 0 for k in got}.keys() == {round(k, 5): 0 for k in want}.keys()
    none = SIM.pair_stats(items.where("item_id < 0"), "item_id", "text").first()
    assert tuple(none) == (0, 0, None, None)


def test_rounding_is_half_up_on_the_decimal_form():
    import numpy as np

    x = [0.0078125, 0.0000005, 0.1234565, 0.12345649999999999, 2.5e-7, 0.0, 1.0, 0.9999995, 0.3333333333333333]
    from decimal import ROUND_HALF_UP, Decimal

    want = [float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in x]
    assert SIM.rounded(np.array(x)).tolist() == want


def test_bounds_never_lose_the_best(spark):
    """Lists stop being read early and few exact dots are taken, on texts with
    shared grams, ties and repeated positives."""
    import random

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(60)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    positives = [say(rng.randint(1, 30)) for _ in range(200)] + ["tie one", "one tie", "tie one", None, "", "xy"]
    cands = [say(rng.randint(1, 4)) for _ in range(150)] + positives[:5] + ["zzzz", "", None, "tie", "aaaaaaa"]
    pos = spark.createDataFrame([(i, p) for i, p in enumerate(positives)], "item_id long, text string")
    cand = spark.createDataFrame([(c,) for c in cands], "phrase string")
    want = {c: max(cos(c, p) for p in positives if p) if c else 0.0 for c in cands}
    for postings in (10**6, 900):
        got = {r["phrase"]: r for r in SIM.best_similarity(cand, "phrase", pos, "item_id", "text", postings, 40, counters=True).collect()}
        assert {c: r["max_sim"] for c, r in got.items()} == pytest.approx(want, abs=1e-6)
        if postings == 10**6:
            assert sum(r["n_dots"] for r in got.values()) < 0.2 * len(got) * 203


def test_negatives_threshold(spark):
    pos = spark.createDataFrame(list(enumerate(POS)), ["item_id", "text"])
    cands = spark.createDataFrame([(1, "wound infection rate"), (1, "hospital stay"), (2, "hospital stay")], ["doc_id", "phrase"])
    kept = sorted((r["doc_id"], r["phrase"]) for r in SIM.negatives_by_similarity(cands, ["doc_id"], "phrase", pos, "item_id", "text").collect())
    assert kept == [(1, "hospital stay"), (2, "hospital stay")]


def test_blocks_of_about_one_positive(spark):
    pos = spark.createDataFrame(list(enumerate(POS)), ["item_id", "text"])
    cand = spark.createDataFrame([(c,) for c in CAND], ["phrase"])
    want = {c: round(max(cos(c, p) for p in POS), 6) for c in CAND}
    got = {r["phrase"]: r["max_sim"] for r in SIM.best_similarity(cand, "phrase", pos, "item_id", "text", block_postings=1, slice_rows=1).collect()}
    assert got == pytest.approx(want)


def test_article_without_negatives_keeps_one_empty_row(spark):
    from pyspark.sql import functions as F

    pos = spark.createDataFrame(list(enumerate(POS)), ["item_id", "text"])
    cands = spark.createDataFrame([(1, "wound infection rate"), (2, "hospital stay")], ["doc_id", "phrase"])
    ok = spark.createDataFrame([(1,), (2,)], ["doc_id"])
    neg = SIM.negatives_by_similarity(cands, ["doc_id"], "phrase", pos, "item_id", "text").select("doc_id", "phrase")
    j = ok.join(neg, "doc_id", "left").select("doc_id", F.coalesce("phrase", F.lit("")).alias("text"),
                                             F.col("phrase").isNotNull().alias("has_negatives"))
    got = sorted(tuple(r) for r in j.collect())
    assert got == [(1, "", False), (2, "hospital stay", True)]


def test_short_lists_are_read_in_full_for_many_candidates_at_once(monkeypatch):
    """The same values to the last bit as by bounds, in chunks of any size, for
    candidates without grams and with long lists among them; no dot by itself."""
    import random

    import numpy as np
    import pyarrow as pa

    from sectio.functions.grams import count_slice

    rng = random.Random(3)
    say = lambda k: "".join(rng.choices("abcde ", k=k))
    index = SIM.PositiveIndex.build(pa.array([[t[i:i + 3] for i in range(len(t) - 2)] for t in (say(rng.randint(3, 40)) for _ in range(50))], pa.list_(pa.string())))
    row, gram, n, names = count_slice(pa.array([say(rng.randint(0, 60)) for _ in range(200)] + ["", None, "zzz"]))
    norm = np.sqrt(np.bincount(row, n * n, 203))
    code = {g: i for i, g in enumerate(index.vocab.to_pylist())}
    known = np.array([code.get(g, -1) for g in names.to_pylist()])[gram]
    row, gram, n = row[known >= 0], known[known >= 0], n[known >= 0]
    want = [index.best(gram[row == i], n[row == i], norm[i])[0] for i in range(203)]
    for limit, chunk in ((10**6, 10**6), (10**6, 100), (200, 300), (0, 100)):
        monkeypatch.setattr(SIM, "FULL_READ", limit)
        monkeypatch.setattr(SIM, "FULL_CHUNK", chunk)
        value, read, dots = index.best_of(row, gram, n, norm)
        assert value.tolist() == want
        assert (dots.sum() == 0) == (limit == 10**6) and read.sum() > 0
