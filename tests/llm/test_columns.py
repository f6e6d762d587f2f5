"""Extra columns whose names clash with anything used inside stay as they are."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sectio.llm import common, decontaminate, encode, filter_audit, html_text, language, line_dedup, merkle, quality, simhash, suffix_dedup, token_count

CLASH = ["__id", "__n", "__", "__rid", "a.b", "x`y", "rest", "f0", "kept", "id", "n_bytes", "score", "lang_pred", "body", "marks", "mask", "part", "leaf", "carrier", "ids", "decoded", "h", "c", "rid"]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows]
    rows += [(rows[0][0], rows[0][1], "en", "s", 1), (None, "null id, some text", None, None, None), (9001, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).withColumn("no", F.monotonically_increasing_id())
    return common.cut(df).select("*", *(F.concat(F.lit(c), F.lit(":"), F.col("no").cast("string")).alias(c) for c in CLASH))


def same_extras(out, dropped=()):
    """Every kept extra column still holds the value that was made for its row."""
    names = [c for c in CLASH if c not in dropped]
    assert set(names) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    for r in out.select("no", *map(common.quoted, names)).collect():
        assert list(r)[1:] == [f"{c}:{r[0]}" for c in names]


def test_operators_that_keep_columns(spark, docs):
    path = common.tokenizer_path(P.PIECES)
    items = spark.createDataFrame([(1, "an item that no text holds")], "item_id long, text string")
    model = language.fit(docs.where("doc_id is not null"))
    same_extras(language.predict(docs, model), ("score", "lang_pred"))
    assert language.predict(docs.drop("text", "score").withColumnRenamed("no", "text").withColumn("score", F.lit("some words")), model, text_col="score").count() == 43
    same_extras(language.keep_known(docs))
    same_extras(simhash.keep_one(docs))
    same_extras(suffix_dedup.remove_repeats(docs), ("kept", "n_bytes"))
    same_extras(suffix_dedup.clean_texts(docs))
    same_extras(decontaminate.keep_clean(docs, items))
    same_extras(encode.encode(docs, path), ("ids", "decoded"))
    same_extras(token_count.count_tokens(docs, path), ("n_bytes",))
    same_extras(html_text.extract(docs.withColumnRenamed("text", "html").drop("n_chars")))


def test_operators_that_take_what_they_need(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert simhash.near_duplicates(docs).count() == quality.score(docs, labels).count() == 43
    assert line_dedup.drop_common_lines(docs).count() == 43
    assert merkle.prove(merkle.build(docs, ["doc_id", "text"])).count() == 43
    assert filter_audit.audit(docs, labels).count() % 600 == 0
    assert decontaminate.find_leaks(docs, labels.select(F.col("doc_id").alias("item_id"), F.lit("zzz qqq").alias("text"))).count() == 0


def test_stages_keep_such_columns(spark, docs):
    for name, stage in P.STAGES[:-1]:
        out = common.cut(stage(spark, docs.select(*(common.quoted(c) for c in docs.columns if c not in ("a.b", "x`y"))), SMALL))
        assert set(out.columns) == set(docs.columns) - {"a.b", "x`y"}, name
