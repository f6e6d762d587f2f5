"""Explicit schemas: every read names its columns and types (no inference)."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

LABELS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("quality", T.IntegerType()),
    T.StructField("toxic", T.IntegerType()),
])

EMBEDDINGS = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

BENCHMARK = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("text", T.StringType()),
])

TABLES = {
    "documents": DOCUMENTS,
    "labels": LABELS,
    "embeddings": EMBEDDINGS,
    "pages": PAGES,
    "conversations": CONVERSATIONS,
    "benchmark": BENCHMARK,
}

# Mapping sheet (one study, one verbatim outcome, one domain), after the one
# rename step at the source: `Study ID` -> study_id, `Verbatim Outcomes` ->
# verbatim, `Outcome Domains` -> domain, `Core Areas` -> core_area.
MAPPING = T.StructType([
    T.StructField("study_id", T.LongType()),
    T.StructField("verbatim", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("core_area", T.StringType()),
])

MAPPING_RENAMES = {
    "Study ID": "study_id",
    "Study-id": "study_id",
    "Verbatim Outcomes": "verbatim",
    "Outcome Domains": "domain",
    "Core Areas": "core_area",
    "non outcome": "text",
    "has results": "has_results",
    "has negatives": "has_negatives",
}
