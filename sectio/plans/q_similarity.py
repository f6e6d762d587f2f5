"""Step 5: trigram vectors, pair statistics and negative mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectio.operators import phrases as P
from sectio.operators import sections as S
from sectio.operators import similarity as SIM
from sectio.plans.oracle import compose, register
from sectio.plans.stages import stage
from sectio.plans.q_text import PRE_START, abbreviations, sections, sql_marked, sql_runs, sql_sentences
from sectio.plans.registry import query
from sectio.sources import tables


def grams_sql(src: str, key: str, text: str) -> str:
    return f"""SELECT {key}, gram, count(*) AS n FROM (
        SELECT {key}, substring(lower({text}), unnest(range(1, length(lower({text})) - 1)), 3) AS gram
        FROM {src} WHERE length(lower({text})) >= 3) q GROUP BY {key}, gram"""


def norms_sql(src: str, key: str) -> str:
    return f"SELECT {key}, sqrt(sum(n * n)) AS norm FROM {src} GROUP BY {key}"


register("bg", [], grams_sql("benchmark", "item_id", "text"))
register("bn", ["bg"], norms_sql("bg", "item_id"))
register("pre_cand", ["sec_loc", "abbr_all"], f"""SELECT DISTINCT doc_id, unnest({sql_runs(sql_marked('sentence'), True)}) AS phrase FROM (
    SELECT doc_id, lang, unnest({sql_sentences('pre')}) AS sentence FROM (
      SELECT doc_id, lang, substring(text, {PRE_START + 1}, greatest(res_start - {PRE_START}, 0)) AS pre, abbr FROM sec_loc, abbr_all WHERE status = 'ok') a) b""")
register("pc_g", ["pre_cand"], grams_sql("(SELECT DISTINCT phrase FROM pre_cand) t", "phrase", "phrase"))
register("pc_n", ["pc_g"], norms_sql("pc_g", "phrase"))
register("pc_best", ["pc_g", "pc_n", "bg", "bn"], """SELECT d.phrase, max(round(d.dot / (cn.norm * bn.norm), 6)) AS max_sim FROM (
    SELECT g.phrase, b.item_id, sum(g.n * b.n) AS dot FROM pc_g g JOIN bg b ON g.gram = b.gram GROUP BY g.phrase, b.item_id) d
    JOIN pc_n cn ON d.phrase = cn.phrase JOIN bn ON d.item_id = bn.item_id GROUP BY d.phrase""")
register("negs", ["pre_cand", "pc_best"], """SELECT c.doc_id, c.phrase, coalesce(b.max_sim, 0.0) AS max_sim
    FROM pre_cand c LEFT JOIN pc_best b ON c.phrase = b.phrase WHERE coalesce(b.max_sim, 0.0) <= 0.85""")


def bench(spark, sf_dir):
    return tables.benchmark(spark, sf_dir).select("item_id", "text")


def pre_candidates(spark, sf_dir):
    """Candidate negatives: covered phrases of the pre-results text, one
    row per distinct (article, phrase); materialized (read twice)."""
    pre = sections(spark, sf_dir).where(F.col("status") == S.STATUS_OK)
    sents = P.explode_sentences(pre, "preresults", ["doc_id"], ["lang"], abbreviations(spark, sf_dir).where("learned"))
    return stage(spark, sf_dir, "pre_candidates",
                 lambda: P.explode_phrases(sents, ["doc_id"], lang="lang").select("doc_id", "phrase").distinct())


def negatives(spark, sf_dir):
    """Mined negatives (stage output, materialized)."""
    return stage(spark, sf_dir, "negatives", lambda: SIM.negatives_by_similarity(
        pre_candidates(spark, sf_dir), ["doc_id"], "phrase", bench(spark, sf_dir), "item_id", "text"))


@query("ngram_vectors", compose(["bg", "bn"], """SELECT g.item_id, g.gram, CAST(g.n AS BIGINT) AS n, round(g.n / b.norm, 6) AS w
    FROM bg g JOIN bn b ON g.item_id = b.item_id"""))
def q_ngram_vectors(spark, sf_dir):
    v = SIM.gram_vectors(bench(spark, sf_dir), "item_id", "text").where(F.col("gram").isNotNull())
    return v.select("item_id", "gram", F.col("n").cast("bigint").alias("n"), F.round(F.col("n") / F.col("norm"), 6).alias("w"))


@query("pairwise_cosine_stats", compose(["bg", "bn"], """SELECT (SELECT CAST(count(*) AS BIGINT) FROM bn) AS n_items, CAST(count(*) AS BIGINT) AS n_pairs,
    round(min(cos), 6) AS min_sim, round(quantile_cont(cos, 0.5), 6) AS median_sim FROM (
    SELECT p.a, p.b, round(coalesce(d.dot, 0) / (na.norm * nb.norm), 6) AS cos FROM
      (SELECT x.item_id AS a, y.item_id AS b FROM bn x JOIN bn y ON x.item_id < y.item_id) p
      LEFT JOIN (SELECT x.item_id AS a, y.item_id AS b, sum(x.n * y.n) AS dot FROM bg x JOIN bg y ON x.gram = y.gram AND x.item_id < y.item_id
                 GROUP BY x.item_id, y.item_id) d ON p.a = d.a AND p.b = d.b
      JOIN bn na ON p.a = na.item_id JOIN bn nb ON p.b = nb.item_id) q"""))
def q_pairwise_cosine_stats(spark, sf_dir):
    return SIM.pair_stats(bench(spark, sf_dir), "item_id", "text")


@query("negatives_by_similarity", compose(["negs"], "SELECT doc_id, phrase, max_sim FROM negs"))
def q_negatives_by_similarity(spark, sf_dir):
    return negatives(spark, sf_dir).select("doc_id", "phrase", "max_sim")


@query("negatives_by_article", compose(["sec_loc", "negs"], """SELECT a.doc_id, coalesce(n.phrase, '') AS text, true AS has_results,
    n.phrase IS NOT NULL AS has_negatives FROM (SELECT doc_id FROM sec_loc WHERE status = 'ok') a LEFT JOIN negs n ON a.doc_id = n.doc_id"""))
def q_negatives_by_article(spark, sf_dir):
    """One row per negative of every article with a results section; an
    article without negatives keeps one row with empty text. Articles without
    results produce no row (as in the reference, whose frame for them is
    never returned), so has_results is true on every row."""
    ok = sections(spark, sf_dir).where(F.col("status") == S.STATUS_OK).select("doc_id")
    n = negatives(spark, sf_dir).select("doc_id", "phrase")
    j = ok.join(n, "doc_id", "left")
    return j.select("doc_id", F.coalesce("phrase", F.lit("")).alias("text"), F.lit(True).alias("has_results"),
                    F.col("phrase").isNotNull().alias("has_negatives"))
