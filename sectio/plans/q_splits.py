"""Step 2: deterministic splits and samples (md5 order, checked exactly)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectio.operators import labels as L
from sectio.operators import splits as S
from sectio.plans import fixtures as fx
from sectio.plans.oracle import compose, register
from sectio.plans.q_dataset import mapping_clean
from sectio.plans.registry import query

N_USE = 10


def rank_sql(src: str, key: str, seed: int = 4220, part: str | None = None, rn: str = "rn", n: str | None = "n") -> str:
    """DuckDB: seeded rank (and group size) over ``src``."""
    pb = f"PARTITION BY {part} " if part else ""
    cnt = f", count(*) OVER ({pb.strip()}) AS {n}" if n else ""
    return (f"SELECT *, row_number() OVER ({pb}ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR)), {key}) AS {rn}{cnt} "
            f"FROM {src}")


def split_sql(src: str, key: str, n_use: int | None) -> str:
    u = "n - k" if n_use is None else f"least({n_use}, n - k)"
    return f"""SELECT {key}, rn, CASE WHEN rn <= k THEN 'test' WHEN rn <= k + t THEN 'train'
        WHEN rn <= k + u THEN 'eval' ELSE 'unused' END AS split FROM (
        SELECT *, CAST(round_even(0.8 * u, 0) AS BIGINT) AS t FROM (
        SELECT *, {u} AS u FROM (
        SELECT *, CAST(round_even(0.25 * n, 0) AS BIGINT) AS k FROM ({rank_sql(src, key)}) a) b) c) d"""


register("lab_sp", ["labelled"], split_sql("(SELECT DISTINCT study_id FROM labelled WHERE label = 'outcome') s", "study_id", N_USE))
register("lab_sp_all", ["labelled"], split_sql("(SELECT DISTINCT study_id FROM labelled WHERE label = 'outcome') s", "study_id", None))
register("map_sp", ["mapping"], split_sql("(SELECT DISTINCT study_id FROM mapping) s", "study_id", N_USE))


def lab_split(spark, sf_dir, n_use=N_USE):
    lab = fx.labelled(spark, sf_dir)
    return S.split_studies(lab.where(F.col("label") == "outcome"), n_use=n_use)


@query("split_studies", compose(["lab_sp"], "SELECT study_id, rn, split FROM lab_sp"))
def q_split_studies(spark, sf_dir):
    return lab_split(spark, sf_dir)


@query("first_studies", compose(["labelled"], """SELECT study_id, min(doc_id) AS first FROM labelled WHERE study_id IS NOT NULL
    GROUP BY study_id ORDER BY first, study_id LIMIT 10"""))
def q_first_studies(spark, sf_dir):
    """O3: the first ten studies in the order in which they turn up."""
    return S.first_studies(fx.labelled(spark, sf_dir), 10, "doc_id")


@query("split_balanced", compose(["lab_sp", "labelled"], """
SELECT split, study_id, doc_id, label FROM rws WHERE label = 'outcome'
UNION ALL
SELECT n.split, n.study_id, n.doc_id, n.label FROM negr n JOIN npos p ON n.split = p.split WHERE n.draw <= p.n_pos""", local=[
    ("rws", "SELECT l.study_id, l.doc_id, l.label, sp.split FROM labelled l JOIN lab_sp sp ON l.study_id = sp.study_id WHERE sp.split <> 'unused'"),
    ("npos", "SELECT split, count(*) AS n_pos FROM rws WHERE label = 'outcome' GROUP BY split"),
    ("negr", rank_sql("rws WHERE label = 'not outcome'", "doc_id", part="split", rn="draw", n=None)),
]))
def q_split_balanced(spark, sf_dir):
    sp = lab_split(spark, sf_dir).where(F.col("split") != "unused").select("study_id", "split")
    rows = fx.labelled(spark, sf_dir).select("study_id", "doc_id", "label").join(sp, "study_id")
    pos = rows.where(F.col("label") == "outcome")
    neg = S.balance_negatives(pos, rows.where(F.col("label") == "not outcome"), by="split", key="doc_id")
    return pos.unionByName(neg.select(*pos.columns)).select("split", "study_id", "doc_id", "label")


register("dom_pos", ["mapping_clean"], """SELECT m.vec_id, m.study_id, m.label FROM mapping_clean m WHERE m.label IN (
    SELECT label FROM mapping_clean WHERE label NOT IN ('Hospital', 'Need for further intervention', 'Economics')
    GROUP BY label ORDER BY count(*) DESC, label LIMIT 6)""")
register("dom_sp", ["dom_pos"], split_sql("(SELECT DISTINCT study_id FROM dom_pos) s", "study_id", None))


def dom_pos(spark, sf_dir):
    mc = mapping_clean(spark, sf_dir)
    top = L.top_labels(L.exclude_labels(mc), 6).select("label")
    return mc.join(top, "label", "left_semi").select("vec_id", "study_id", "label")


def lab_negatives(spark, sf_dir):
    """Negatives (not outcome documents) keyed by the mapping's study id."""
    lab = fx.labelled(spark, sf_dir).where(F.col("label") == "not outcome")
    return lab.select(F.expr("try_cast(substring(study_id, 4) AS bigint)").alias("study_id"), "doc_id", "label")


@query("split_ratio_negatives", compose(["dom_sp", "dom_pos", "labelled"], """
SELECT p.split, p.study_id, p.vec_id, NULL::BIGINT AS doc_id, p.label FROM pp p
UNION ALL
SELECT n.split, n.study_id, NULL::BIGINT AS vec_id, n.doc_id, n.label FROM nr n JOIN npos c ON n.split = c.split
WHERE n.draw <= least(CAST(round_even(c.n_pos / 6, 0) AS BIGINT), n.n_avail)""", local=[
    ("pp", "SELECT d.*, s.split FROM dom_pos d JOIN dom_sp s ON d.study_id = s.study_id"),
    ("npos", "SELECT split, count(*) AS n_pos FROM pp GROUP BY split"),
    ("nl", """SELECT CAST(substr(l.study_id, 4) AS BIGINT) AS study_id, l.doc_id, l.label, s.split FROM labelled l
        JOIN dom_sp s ON CAST(substr(l.study_id, 4) AS BIGINT) = s.study_id WHERE l.label = 'not outcome'"""),
    ("nr", rank_sql("nl", "doc_id", part="split", rn="draw", n="n_avail")),
]))
def q_split_ratio_negatives(spark, sf_dir):
    pos = dom_pos(spark, sf_dir)
    sp = S.split_studies(pos).select("study_id", "split")
    pp = pos.join(sp, "study_id")
    neg = lab_negatives(spark, sf_dir).join(sp, "study_id")
    picked = S.ratio_negatives(pp, neg, 6, by="split", key="doc_id")
    a = pp.select("split", "study_id", "vec_id", F.lit(None).cast("bigint").alias("doc_id"), "label")
    b = picked.select("split", "study_id", F.lit(None).cast("bigint").alias("vec_id"), "doc_id", "label")
    return a.unionByName(b)


@query("sample_with_replacement", compose(["mapping_clean"], """
SELECT p.draw, p.pos, pool.vec_id, pool.study_id FROM picks p JOIN pool ON p.pos = pool.pos""", local=[
    ("ovr", """SELECT vec_id, study_id, CASE WHEN label IS NOT DISTINCT FROM 'Mortality' THEN label ELSE 'Other outcome' END AS label
        FROM mapping_clean"""),
    ("pool", rank_sql("ovr WHERE label = 'Mortality'", "vec_id", rn="pos", n="avail")),
    ("dr", rank_sql("ovr WHERE label = 'Other outcome'", "vec_id", rn="draw", n=None)),
    ("picks", """SELECT draw, CAST(CAST(('0x' || substr(md5('4220|' || CAST(draw AS VARCHAR)), 1, 8)) AS UBIGINT)
        % (SELECT max(avail) FROM pool) AS BIGINT) + 1 AS pos FROM dr"""),
]))
def q_sample_with_replacement(spark, sf_dir):
    """M5 with the classes swapped: as many rows from the small class as the
    large one has, so draws repeat (FIXTURES)."""
    ovr = L.collapse_one_vs_rest(mapping_clean(spark, sf_dir), "Mortality").select("vec_id", "study_id", "label")
    pool = ovr.where(F.col("label") == "Mortality").select("vec_id", "study_id")
    draws = ovr.where(F.col("label") == "Other outcome").select("vec_id")
    return S.sample_with_replacement(pool, draws, "vec_id", "vec_id").select("draw", "pos", "vec_id", "study_id")


@query("split_rows", compose(["labelled"], """
SELECT doc_id, study_id, 'train' AS split FROM labelled WHERE study_id IN (SELECT study_id FROM ls WHERE rn <= k)
UNION ALL
SELECT doc_id, study_id, CASE WHEN rn <= CAST(round_even(0.5 * n, 0) AS BIGINT) THEN 'test' ELSE 'eval' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5('22|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER () AS n
      FROM labelled WHERE study_id IN (SELECT study_id FROM ls WHERE rn > k)) r""", local=[
    ("ls", f"SELECT *, CAST(round_even(0.5 * n, 0) AS BIGINT) AS k FROM ({rank_sql('(SELECT DISTINCT study_id FROM labelled) s', 'study_id')}) a"),
]))
def q_split_rows(spark, sf_dir):
    """M6: half of the studies train; the other studies' rows split 50/50
    into test and eval at row level (seed 22)."""
    lab = fx.labelled(spark, sf_dir).select("doc_id", "study_id")
    st = S.split_studies(lab, test_share=0.5, eval_share=0.0).select("study_id", F.col("split").alias("ss"))
    rows = lab.join(st, "study_id")
    train = rows.where(F.col("ss") == "test").select("doc_id", "study_id", F.lit("train").alias("split"))
    rest = S.split_rows(rows.where(F.col("ss") != "test").drop("ss"), "doc_id", seed=22)
    return train.unionByName(rest.select("doc_id", "study_id", "split"))


@query("stratified_folds", compose(["labelled"], f"""SELECT doc_id, label, CAST((rn - 1) % 5 + 1 AS INTEGER) AS fold FROM (
    {rank_sql('labelled', 'doc_id', part='label', n=None)}) r"""))
def q_stratified_folds(spark, sf_dir):
    lab = fx.labelled(spark, sf_dir).select("doc_id", "label")
    return S.stratified_folds(lab, "doc_id", "label", k=5)


@query("train_size_grid", compose(["lab_sp_all"], """
SELECT g.n_articles, r.study_id, CASE WHEN r.rn - c.k <= CAST(round_even(0.8 * g.n_articles, 0) AS BIGINT) THEN 'train' ELSE 'eval' END AS split
FROM lab_sp_all r, c, (SELECT unnest(range(5, (SELECT m FROM c) + 1, 5)) AS n_articles) g
WHERE r.split <> 'test' AND r.rn - c.k <= g.n_articles""", local=[
    ("c", "SELECT count(*) FILTER (WHERE split = 'test') AS k, count(*) FILTER (WHERE split <> 'test') AS m FROM lab_sp_all"),
]))
def q_train_size_grid(spark, sf_dir):
    return S.train_size_grid(lab_split(spark, sf_dir, n_use=None), step=5)


@query("train_fraction_grid", compose(["lab_sp_all", "labelled"], f"""SELECT CAST(t.tenths AS INTEGER) AS tenths, r.doc_id, r.label
FROM ({rank_sql("(SELECT l.doc_id, l.label FROM labelled l JOIN lab_sp_all s ON l.study_id = s.study_id WHERE s.split = 'train') x", 'doc_id')}) r,
  (SELECT unnest(range(1, {S.FRACTIONS + 1})) AS tenths) t WHERE r.rn <= floor(r.n * t.tenths / {S.FRACTIONS})"""))
def q_train_fraction_grid(spark, sf_dir):
    """W8 by fractions 0.1 to 1.0 of the training rows of the split."""
    train = lab_split(spark, sf_dir, n_use=None).where(F.col("split") == "train").select("study_id")
    rows = fx.labelled(spark, sf_dir).select("study_id", "doc_id", "label").join(train, "study_id", "left_semi")
    return S.train_fraction_grid(rows, "doc_id", ["label"])


@query("training_flag", compose(["lab_sp", "labelled"], """SELECT l.doc_id, l.study_id, l.label,
    coalesce(s.split IN ('train', 'eval'), false) AS used_in_training
    FROM labelled l LEFT JOIN lab_sp s ON l.study_id = s.study_id"""))
def q_training_flag(spark, sf_dir):
    used = lab_split(spark, sf_dir).where(F.col("split").isin("train", "eval")).select("study_id")
    lab = fx.labelled(spark, sf_dir).select("doc_id", "study_id", "label")
    return L.membership_flag(lab, used, "study_id", "used_in_training")


@query("domain_training_set", compose(["mapping_clean", "map_sp"], """
SELECT vec_id, study_id, label, 'test' AS split FROM ex WHERE study_id IN (SELECT study_id FROM dt WHERE rn <= k)
UNION ALL
SELECT e.vec_id, e.study_id, e.label, CASE WHEN u.rn2 <= u.t THEN 'train' ELSE 'eval' END AS split
FROM ex e JOIN ur u ON e.study_id = u.study_id""", local=[
    ("ex", "SELECT vec_id, study_id, label FROM mapping_clean WHERE label NOT IN ('Hospital', 'Need for further intervention', 'Economics') OR label IS NULL"),
    ("dt", f"SELECT *, CAST(round_even(0.25 * n, 0) AS BIGINT) AS k FROM ({rank_sql('(SELECT DISTINCT study_id FROM ex) s', 'study_id')}) a"),
    ("uu", """SELECT study_id FROM map_sp WHERE split IN ('train', 'eval')
        AND study_id NOT IN (SELECT study_id FROM dt WHERE rn <= k)"""),
    ("ur", f"""SELECT *, CAST(round_even(0.8 * n, 0) AS BIGINT) AS t FROM (
        {rank_sql('uu', 'study_id', rn='rn2')}) a"""),
]))
def q_domain_training_set(spark, sf_dir):
    """Cleaned, excluded domain rows; a 25 % test set re-drawn over the
    domain studies; training studies are those the binary stage used, minus
    the domain test studies (anti join), split 80/20."""
    ex = L.exclude_labels(mapping_clean(spark, sf_dir)).select("vec_id", "study_id", "label")
    dt = S.split_studies(ex, test_share=0.25)
    test_ids = dt.where(F.col("split") == "test").select("study_id")
    used = S.split_studies(fx.mapping(spark, sf_dir), n_use=N_USE).where(F.col("split").isin("train", "eval")).select("study_id")
    used = used.join(test_ids, "study_id", "left_anti")
    ur = S.split_studies(used, test_share=0.0, eval_share=0.2).select("study_id", "split")
    test = ex.join(test_ids, "study_id", "left_semi").withColumn("split", F.lit("test"))
    rest = ex.join(ur, "study_id")
    return test.unionByName(rest.select(*test.columns))
