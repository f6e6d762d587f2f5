"""Derived views over the driver tables (FIXTURES.md part 3), Spark side.

Every view reads the given tables, so its size grows with them. The DuckDB
twins live in ``sectio.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectio.functions.labels import NOT_OUTCOME, OUTCOME, clean_label
from sectio.sources import tables

SEED = 4220

# --- fixed values: heading texts inserted into the article fixture -----------
H_INTRO = "1. Introduction"
H_METHODS = "2. Methods"
H_RESULTS = "3. Results"
H_APPENDIX = "3. Appendix"
H_DISCUSSION = "4. Discussion"
# Dirty domain spellings by embedding label 0..9 (9 = missing).
MAPPING_DOMAINS = [
    "Adverse_x000D_ events",
    "Blood and lymphatic system _x000D_outcomes",
    "Infection and infestation\n outcomes",
    "Hospital",
    "Need for further intervention",
    "Economics",
    " Mortality ",
    "Pain\n",
    "Delivery of care",
    None,
]
N_STUDIES = 20
# -----------------------------------------------------------------------------


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (a null text counts as empty) with four headings inserted
    at 10/30/50/80 % of their length. ``doc_id % 10 = 0``: the results heading
    reads "Appendix"; ``doc_id % 10 = 1``: discussion precedes results."""
    d = tables.documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    L = F.length("text")
    c1 = F.floor(L * 1 / 10).cast("int")
    c2 = F.floor(L * 3 / 10).cast("int")
    c3 = F.floor(L * 5 / 10).cast("int")
    c4 = F.floor(L * 8 / 10).cast("int")
    d = d.select("doc_id", "source", "lang", "text", c1.alias("c1"), c2.alias("c2"), c3.alias("c3"), c4.alias("c4"))
    t = F.col("text")
    part = lambda a, b: F.substring(t, F.col(a) + 1, F.col(b) - F.col(a))
    h3 = F.when(F.col("doc_id") % 10 == 0, F.lit(H_APPENDIX)).otherwise(F.lit(H_RESULTS))
    swap = F.col("doc_id") % 10 == 1
    ha = F.when(swap, F.lit(H_DISCUSSION)).otherwise(h3)
    hb = F.when(swap, h3).otherwise(F.lit(H_DISCUSSION))
    wrap = lambda h: F.concat(F.lit("\n\n"), h, F.lit("\n\n"))
    text = F.concat(
        F.substring(t, 1, F.col("c1")),
        wrap(F.lit(H_INTRO)),
        part("c1", "c2"),
        wrap(F.lit(H_METHODS)),
        part("c2", "c3"),
        wrap(ha),
        part("c3", "c4"),
        wrap(hb),
        F.expr("substring(text, c4 + 1)"),
    )
    return d.select("doc_id", "source", "lang", text.alias("text"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled examples: study = source; quality 0 -> outcome."""
    d = tables.documents(spark, sf_dir).select("doc_id", "source", "text")
    lab = tables.labels(spark, sf_dir).select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        F.col("source").alias("study_id"),
        "doc_id",
        "text",
        F.when(F.col("quality") == 0, F.lit(OUTCOME)).otherwise(F.lit(NOT_OUTCOME)).alias("label"),
    )


def _domain_of(label_col) -> F.Column:
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in MAPPING_DOMAINS]), label_col + 1)


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping sheet stand-in: one verbatim outcome per embedding."""
    e = tables.embeddings(spark, sf_dir).select("vec_id", "label")
    return e.select(
        (F.col("vec_id") % N_STUDIES).alias("study_id"),
        F.concat(F.lit("phrase "), F.col("vec_id").cast("string")).alias("verbatim"),
        _domain_of(F.col("label")).alias("domain"),
        "vec_id",
    )


def indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-study flags as mined with the negatives: studies 0-16 of the
    mapping, each row twice (so the join needs the distinct); 17-19 absent."""
    m = mapping(spark, sf_dir).select("study_id").where(F.col("study_id") < 17).distinct()
    flags = m.select(
        "study_id",
        (F.col("study_id") % 4 != 3).alias("has_results"),
        (F.col("study_id") % 3 != 0).alias("has_negatives"),
    )
    return flags.unionByName(flags)


def class_embeddings(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    """Embeddings with their class name: the cleaned mapping domain (missing
    domain = not outcome); binary form: labels 0-4 are outcomes."""
    e = tables.embeddings(spark, sf_dir)
    if binary:
        cls = F.when(F.col("label") < 5, F.lit(OUTCOME)).otherwise(F.lit(NOT_OUTCOME))
    else:
        cls = F.coalesce(clean_label(_domain_of(F.col("label"))), F.lit(NOT_OUTCOME))
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), cls.alias("cls"))
