"""Deterministic sampling and splitting.

Python's seeded generators cannot be reproduced in a distributed plan, so
every seeded draw is "first n rows in md5('<seed>|<key>') order" (see
``sectio.functions.ordering``): partition-independent, identical in DuckDB,
and computed without a single-task window. Sizes use half-even rounding
(``bround``), as Python's ``round`` does; eval = used - train.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.functions.frames import with_scalars as _with_scalars
from sectio.functions.ordering import hash_first, hash_rank, seeded_key

SEED = 4220


def rank_studies(rows: DataFrame, study: str = "study_id", seed: int = SEED) -> DataFrame:
    """Distinct studies with their seeded rank ``rn`` and count ``n``."""
    return hash_rank(rows.select(study).distinct(), seed, study)


def split_studies(rows: DataFrame, study: str = "study_id", seed: int = SEED, test_share: float = 0.25,
                  n_use: int | None = None, eval_share: float = 0.2) -> DataFrame:
    """M1 + M2: a fixed test set of bround(test_share * n) studies, then the
    next ``n_use`` studies (all remaining when None) split into train
    (bround((1 - eval_share) * used)) and eval (the rest); others 'unused'.
    Output: study, rn, split."""
    r = rank_studies(rows, study, seed)
    k = F.bround(F.lit(test_share) * F.col("n"), 0).cast("bigint")
    rest = F.col("n") - F.col("k")
    u = rest if n_use is None else F.least(F.lit(n_use).cast("bigint"), rest)
    r = r.withColumn("k", k).withColumn("u", u)
    r = r.withColumn("t", F.bround(F.lit(1.0 - eval_share) * F.col("u"), 0).cast("bigint"))
    split = (
        F.when(F.col("rn") <= F.col("k"), "test")
        .when(F.col("rn") <= F.col("k") + F.col("t"), "train")
        .when(F.col("rn") <= F.col("k") + F.col("u"), "eval")
        .otherwise("unused")
    )
    return r.select(study, "rn", split.alias("split"))


def first_studies(rows: DataFrame, n: int, order: str, study: str = "study_id") -> DataFrame:
    """O3: the first ``n`` distinct studies in encounter order, the order of
    their smallest ``order`` value (ties by study). Null studies are no studies.
    Output: study, ``first``. A limit of ``n`` is the feature."""
    firsts = rows.where(F.col(study).isNotNull()).groupBy(study).agg(F.min(order).alias("first"))
    return firsts.orderBy("first", study).limit(n)


def balance_negatives(pos: DataFrame, neg: DataFrame, by: str, key: str, seed: int = SEED,
                      strict: bool = False) -> DataFrame:
    """M3: per group ``by``, as many negatives as positives, drawn without
    replacement in seeded order. ``strict`` raises when a group has fewer
    negatives than positives (the reference raises); otherwise all of them
    are taken. The per-group positive counts are one row per group."""
    n_pos = pos.groupBy(by).agg(F.count(F.lit(1)).alias("n_pos"))
    if strict:
        avail = neg.groupBy(by).agg(F.count(F.lit(1)).alias("n_avail"))
        short = n_pos.where(F.col(by).isNotNull()).join(avail, by, "left").where(F.coalesce("n_avail", F.lit(0)) < F.col("n_pos"))
        if not short.isEmpty():
            raise ValueError("fewer negatives than positives in a group")
    return hash_first(neg, seed, key, n_pos.withColumnRenamed("n_pos", "n"), [by])


def ratio_negatives(pos: DataFrame, neg: DataFrame, n_labels: int, by: str, key: str, seed: int = SEED) -> DataFrame:
    """M4: per group, bround(positives / n_labels) negatives, capped at what
    exists; seeded (the reference's draw is unseeded)."""
    n_pos = pos.groupBy(by).agg(F.count(F.lit(1)).alias("n_pos"))
    return hash_first(neg, seed, key, n_pos.select(by, F.bround(F.col("n_pos") / F.lit(n_labels), 0).cast("bigint").alias("n")), [by])


def hash_int(seed: int | str, key) -> F.Column:
    """32-bit unsigned integer from the md5 of '<seed>|<key>'."""
    return F.conv(F.substring(seeded_key(seed, key), 1, 8), 16, 10).cast("bigint")


def sample_with_replacement(pool: DataFrame, draws: DataFrame, pool_key: str, draw_key: str,
                               seed: int = SEED) -> DataFrame:
    """M5: one pool row per draw, with replacement. Draw i (its seeded rank
    among ``draws``) picks pool row ``hash(seed|i) % avail + 1`` in the pool's
    seeded order: an equi-join on that position, so a popular pick fans out
    on the probe side only. Output: draw columns, pos, pool columns."""
    p = hash_rank(pool, seed, pool_key, rank_col="pos", count_col="avail")
    avail = p.groupBy().agg(F.max("avail").alias("avail"))
    d = hash_rank(draws.select(F.col(draw_key).alias("__dk")), seed, "__dk", rank_col="draw", count_col=None).drop("__dk")
    d = _with_scalars(d, avail).withColumn("pos", F.pmod(hash_int(seed, F.col("draw")), F.col("avail")) + 1)
    return d.join(p.drop("avail"), "pos").drop("avail")


def split_rows(rows: DataFrame, key: str, seed: int = 22, first_share: float = 0.5,
               first: str = "test", second: str = "eval") -> DataFrame:
    """M6: row-level split: the first bround(share * n) rows in seeded order
    go to ``first``."""
    r = hash_rank(rows, seed, key)
    k = F.bround(F.lit(first_share) * F.col("n"), 0)
    return r.withColumn("split", F.when(F.col("rn") <= k, first).otherwise(second)).drop("rn", "n")


def stratified_folds(rows: DataFrame, key: str, label: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """fold = (seeded rank within label - 1) % k + 1, so every fold holds
    each label within one row of its share."""
    r = hash_rank(rows, seed, key, partition_by=[label], count_col=None)
    return r.withColumn("fold", ((F.col("rn") - 1) % k + 1).cast("int")).drop("rn")


FRACTIONS = 10


def train_fraction_grid(rows: DataFrame, key: str, keep: list[str], seed: int = SEED, steps: int = FRACTIONS) -> DataFrame:
    """W8, the form by fractions: for 1/steps, 2/steps, ... 1 of the training rows,
    the first floor(fraction * n) of them in seeded order, every fraction in one
    job. Output: ``tenths`` (the step), key, keep..."""
    r = hash_rank(rows.select(key, *keep), seed, key)
    each = F.filter(F.sequence(F.lit(1), F.lit(steps)), lambda t: F.col("rn") <= F.floor(F.col("n") * t / steps))
    return r.select(F.explode(each).alias("tenths"), key, *keep)


def train_size_grid(split: DataFrame, study: str = "study_id", step: int = 5, max_n: int | None = None,
                    eval_share: float = 0.2) -> DataFrame:
    """For n = step, 2*step, ... up to the number of non-test studies
    (or ``max_n``), the first n non-test studies in seeded order, split into
    train/eval as in M2 -- every size in one job. Input: ``split_studies``
    output. Output: n_articles, study, split."""
    sizes = split.groupBy().agg(
        F.count_if(F.col("split") == "test").alias("k"),
        F.count_if(F.col("split") != "test").alias("m"),
    )
    r = _with_scalars(split.where(F.col("split") != "test"), sizes)
    limit = F.col("m") if max_n is None else F.least(F.col("m"), F.lit(max_n).cast("bigint"))
    r = r.withColumn("pos", F.col("rn") - F.col("k")).withColumn("lim", limit)
    r = r.withColumn("n_articles", F.explode(F.sequence(F.lit(step).cast("bigint"), F.greatest(F.col("lim"), F.lit(step).cast("bigint")), F.lit(step).cast("bigint"))))
    r = r.where((F.col("pos") <= F.col("n_articles")) & (F.col("n_articles") <= F.col("lim")))
    t = F.bround(F.lit(1.0 - eval_share) * F.col("n_articles"), 0)
    return r.select("n_articles", study, F.when(F.col("pos") <= t, "train").otherwise("eval").alias("split"))
