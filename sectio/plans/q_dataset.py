"""Step 1: dataset work -- sources, label clean-up, joins, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectio.operators import labels as L
from sectio.plans import fixtures as fx
from sectio.plans.oracle import clean_label_sql, compose, register
from sectio.plans.registry import query
from sectio.sources import tables

EXCL = "('Hospital', 'Need for further intervention', 'Economics')"

register("mapping_clean", ["mapping"], f"SELECT study_id, verbatim, domain, vec_id, {clean_label_sql('domain')} AS label FROM mapping")
register("mapping_ind", ["mapping", "indicator"], """SELECT m.study_id, m.verbatim, m.domain, m.vec_id, i.has_results, i.has_negatives
    FROM mapping m LEFT JOIN (SELECT DISTINCT * FROM indicator) i ON m.study_id = i.study_id""")


def mapping_clean(spark, sf_dir):
    return L.clean_labels(fx.mapping(spark, sf_dir))


@query("corpus_scan", """SELECT doc_id, source, lang, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
    n_chars = length(coalesce(text, '')) AS length_ok FROM documents""")
def q_corpus_scan(spark, sf_dir):
    """Every document; a null text counts as empty, as in the article view."""
    length = F.length(F.coalesce("text", F.lit("")))
    return tables.documents(spark, sf_dir).select("doc_id", "source", "lang", length.cast("bigint").alias("n_chars"), (F.col("n_chars") == length).alias("length_ok"))


@query("mapping_scan", compose(["mapping"], "SELECT study_id, verbatim, domain FROM mapping"))
def q_mapping_scan(spark, sf_dir):
    return fx.mapping(spark, sf_dir).select("study_id", "verbatim", "domain")


@query("mapping_with_indicator", compose(["mapping_ind"], "SELECT study_id, verbatim, domain, has_results, has_negatives FROM mapping_ind"))
def q_mapping_with_indicator(spark, sf_dir):
    m = fx.mapping(spark, sf_dir).select("study_id", "verbatim", "domain")
    return L.with_indicator(m, fx.indicator(spark, sf_dir))


@query("labelled_examples", compose(["mapping_ind", "labelled", "indicator"], """
SELECT study_id, verbatim AS text, 'outcome' AS label FROM mapping_ind WHERE has_results
UNION ALL
SELECT CAST(substr(l.study_id, 4) AS BIGINT) AS study_id, l.text, 'not outcome' AS label
FROM labelled l JOIN (SELECT DISTINCT study_id, has_results FROM indicator) i
  ON CAST(substr(l.study_id, 4) AS BIGINT) = i.study_id
WHERE l.label = 'not outcome' AND i.has_results AND l.text IS NOT NULL AND l.text <> ''"""))
def q_labelled_examples(spark, sf_dir):
    """Stage-02 data handling: outcomes from the mapping, negatives from the
    articles, both only for studies whose indicator says has_results (null
    counts as false), renamed to (study_id, text, label)."""
    ind = fx.indicator(spark, sf_dir)
    pos = (L.with_indicator(fx.mapping(spark, sf_dir), ind)
           .where(F.col("has_results"))
           .select("study_id", F.col("verbatim").alias("text"), F.lit("outcome").alias("label")))
    lab = fx.labelled(spark, sf_dir).where(F.col("label") == "not outcome")
    lab = lab.where(F.col("text").isNotNull() & (F.col("text") != ""))
    neg = (lab.withColumn("study_id", F.expr("try_cast(substring(study_id, 4) AS bigint)"))
           .join(ind.select("study_id", "has_results").dropDuplicates(), "study_id")
           .where(F.col("has_results"))
           .select("study_id", "text", F.lit("not outcome").alias("label")))
    return pos.unionByName(neg)


@query("label_clean", compose(["mapping_clean"], "SELECT study_id, verbatim, domain, label FROM mapping_clean"))
def q_label_clean(spark, sf_dir):
    return mapping_clean(spark, sf_dir).select("study_id", "verbatim", "domain", "label")


@query("label_exclude", compose(["mapping_clean"], f"SELECT study_id, verbatim, label FROM mapping_clean WHERE label NOT IN {EXCL} OR label IS NULL"))
def q_label_exclude(spark, sf_dir):
    return L.exclude_labels(mapping_clean(spark, sf_dir)).select("study_id", "verbatim", "label")


@query("label_freq_filter", compose(["mapping_clean"], """SELECT study_id, verbatim, label FROM mapping_clean
    WHERE label IN (SELECT label FROM mapping_clean WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 25)"""))
def q_label_freq_filter(spark, sf_dir):
    return L.frequent_labels(mapping_clean(spark, sf_dir), threshold=25).select("study_id", "verbatim", "label")


@query("top_labels", compose(["mapping_clean"], f"""SELECT label, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS rank FROM (
    SELECT label, count(*) AS n FROM mapping_clean WHERE (label NOT IN {EXCL} OR label IS NULL) AND label IS NOT NULL
    GROUP BY label ORDER BY n DESC, label LIMIT 6) t"""))
def q_top_labels(spark, sf_dir):
    return L.top_labels(L.exclude_labels(mapping_clean(spark, sf_dir)), 6)


@query("one_vs_rest", compose(["mapping_clean"], """SELECT study_id, verbatim,
    CASE WHEN label IS NOT DISTINCT FROM 'Mortality' THEN label ELSE 'Other outcome' END AS label FROM mapping_clean"""))
def q_one_vs_rest(spark, sf_dir):
    return L.collapse_one_vs_rest(mapping_clean(spark, sf_dir), "Mortality").select("study_id", "verbatim", "label")


@query("corpus_counts", compose(["labelled"], """SELECT CAST(count(DISTINCT study_id) AS BIGINT) AS n_studies,
    CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE label <> 'not outcome') AS BIGINT) AS n_outcomes FROM labelled"""))
def q_corpus_counts(spark, sf_dir):
    return L.corpus_counts(fx.labelled(spark, sf_dir))
