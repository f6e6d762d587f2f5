"""Seeded ordering and splits: exact ranks, half-even sizes, disjoint and
covering splits, balanced folds, sampling rules."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sectio.functions.ordering import hash_first, hash_rank
from sectio.operators import splits as S


def md5_order(keys, seed=4220):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


def test_hash_rank_equals_global_row_number_and_ignores_partitioning(spark):
    data = [(i, "g%d" % (i % 3)) for i in range(500)]
    df = spark.createDataFrame(data, ["k", "grp"])
    for parts in (1, 7):
        got = {r["k"]: (r["rn"], r["n"]) for r in hash_rank(df.repartition(parts), 4220, "k", partition_by=["grp"]).collect()}
        for g in ("g0", "g1", "g2"):
            keys = [k for k, gg in data if gg == g]
            for pos, k in enumerate(md5_order(keys), start=1):
                assert got[k] == (pos, len(keys))


def test_hash_first_equals_the_first_ranks(spark):
    data = [(i, "g%d" % min(i % 4, i % 7), i * 2) for i in range(600)] + [(i, None, 0) for i in range(900, 910)]
    df = spark.createDataFrame(data, ["k", "grp", "all"]).repartition(5)
    for n in (0, 1, 7, 599, 600, 10**6):
        got = [r["k"] for r in hash_first(df.where("grp is not null"), 4220, "k", n).collect()]
        assert sorted(got) == sorted(md5_order(range(600))[:n])
    table = spark.createDataFrame([("g0", 5), ("g1", 0), ("g2", 10**6)], ["grp", "n"])
    for want, n in (({"g0": 5, "g2": 10**6}, table), ({"g0": 3, "g1": 3, "g2": 3, "g3": 3}, 3)):
        got = [tuple(r) for r in hash_first(df, 4220, "k", n, ["grp"]).collect()]
        own = {g: md5_order([k for k, x, _ in data if x == g])[:m] for g, m in want.items()}
        assert sorted(got) == sorted((k, g, k * 2) for g, ks in own.items() for k in ks)
    one = spark.createDataFrame([(4,)], ["n"])
    assert hash_first(df.where("grp = 'g1'"), 4220, "k", one).count() == 4 and hash_first(df.limit(0), 4220, "k", 3).collect() == []


def test_ten_studies_quarter_is_half_even(spark):
    df = spark.createDataFrame([("s%d" % i,) for i in range(10)], ["study_id"])
    sp = S.split_studies(df)
    counts = {r["split"]: r["count"] for r in sp.groupBy("split").count().collect()}
    assert counts["test"] == 2  # bround(2.5) = 2, not 3
    assert counts["train"] == 6 and counts["eval"] == 2  # bround(0.8 * 8) = 6


def test_splits_disjoint_and_cover(spark):
    df = spark.createDataFrame([("s%d" % i,) for i in range(37)], ["study_id"])
    sp = S.split_studies(df, n_use=20).collect()
    ids = [r["study_id"] for r in sp]
    assert len(ids) == len(set(ids)) == 37
    splits = {r["split"] for r in sp}
    assert splits == {"test", "train", "eval", "unused"}
    order = md5_order([f"s{i}" for i in range(37)])
    test_ids = {r["study_id"] for r in sp if r["split"] == "test"}
    assert test_ids == set(order[:9])  # bround(9.25) = 9


def test_stratified_folds_balanced(spark):
    data = [(i, "pos" if i % 4 == 0 else "neg") for i in range(203)]
    f = S.stratified_folds(spark.createDataFrame(data, ["k", "label"]), "k", "label", k=5)
    per = {}
    for r in f.groupBy("label", "fold").count().collect():
        per.setdefault(r["label"], []).append(r["count"])
    for counts in per.values():
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_balance_negatives_strict_raises_and_loose_takes_all(spark):
    pos = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], ["split", "k"])
    neg = spark.createDataFrame([("a", 10), ("a", 11)], ["split", "k"])
    with pytest.raises(ValueError):
        S.balance_negatives(pos, neg, "split", "k", strict=True)
    assert S.balance_negatives(pos, neg, "split", "k").count() == 2
    more = spark.createDataFrame([("a", i) for i in range(10, 20)], ["split", "k"])
    got = sorted(r["k"] for r in S.balance_negatives(pos, more, "split", "k").collect())
    assert got == sorted(md5_order(list(range(10, 20)))[:3])


def test_ratio_negatives_capped(spark):
    pos = spark.createDataFrame([("a", i) for i in range(9)], ["split", "k"])
    neg = spark.createDataFrame([("a", 100 + i) for i in range(2)], ["split", "k"])
    assert S.ratio_negatives(pos, neg, 2, "split", "k").count() == 2  # bround(4.5)=4, capped at 2


def test_sample_with_replacement_draws(spark):
    pool = spark.createDataFrame([(i, "p") for i in range(3)], ["pk", "x"])
    draws = spark.createDataFrame([(100 + i,) for i in range(20)], ["dk"])
    out = S.sample_with_replacement(pool, draws, "pk", "dk").collect()
    assert len(out) == 20
    assert {r["pk"] for r in out} <= {0, 1, 2}
    assert len({r["draw"] for r in out}) == 20


def test_train_size_grid(spark):
    df = spark.createDataFrame([("s%d" % i,) for i in range(20)], ["study_id"])
    g = S.train_size_grid(S.split_studies(df), step=5)
    sizes = {r["n_articles"]: r["count"] for r in g.groupBy("n_articles").count().collect()}
    assert sizes == {5: 5, 10: 10, 15: 15}
    tr = g.where((F.col("n_articles") == 5) & (F.col("split") == "train")).count()
    assert tr == 4


def test_hash_rank_exact_with_a_hot_group(spark):
    # one group holds a third of all rows; ranks stay exact and the work is
    # spread over the group's md5 buckets, not one window partition
    data = [(i, "hot" if i % 3 == 0 else "g%d" % (i % 50)) for i in range(3000)]
    df = spark.createDataFrame(data, ["k", "grp"])
    r = hash_rank(df, 7, "k", partition_by=["grp"])
    hot = sorted((row["rn"], row["k"]) for row in r.where("grp = 'hot'").collect())
    keys = md5_order([k for k, g in data if g == "hot"], seed=7)
    assert [k for _, k in hot] == keys and [n for n, _ in hot] == list(range(1, len(keys) + 1))


def test_first_studies_in_encounter_order(spark):
    rows = spark.createDataFrame([(5, "b"), (1, "c"), (3, "a"), (2, "c"), (0, None), (3, "d")], "doc_id long, study_id string")
    assert [tuple(r) for r in S.first_studies(rows, 3, "doc_id").collect()] == [("c", 1), ("a", 3), ("d", 3)]


def test_stage1_fit_sees_training_studies_only(spark):
    from pyspark.sql import functions as F

    from sectio.plans import load_all, q_cascade as Q

    load_all()
    d = "/root/testdata/sf0.01"
    used = {r[0] for r in Q.training_studies(spark, d).collect()}
    train = Q.stage1_train(spark, d).collect()
    n_pos = sum(r.cls == "outcome" for r in train)
    assert n_pos and len(train) - n_pos <= n_pos
    negs = [r.text for r in train if r.cls != "outcome"]
    of = Q.negative_pool(spark, d).where(F.col("text").isin(negs)).select("study_id").distinct().collect()
    assert {r[0] for r in of} <= used
    items = {r.item_id: r.study_id for r in Q.outcome_texts(spark, d).collect()}
    assert {items[int(r.k[2:])] for r in train if r.cls == "outcome"} <= used
