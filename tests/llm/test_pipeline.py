"""The pipeline: each stage on its own input, and all of them."""

import sentencepiece

import corpus_pipeline as P
from sectio.llm import common, decontaminate

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece"]
    for _, stage in P.STAGES[:-1]:
        out = common.cut(stage(spark, docs, SMALL))
        assert out.columns == columns and out.count() <= docs.count()
        docs = out


def test_run_over_planted_cases(spark, words, tmp_path):
    item, passage = words(35, 1), words(80, 2)
    base = [(i, words(120, 10 + i)) for i in range(1, 21)]
    rows = base + [(31, base[0][1]), (32, base[1][1] + " tail"), (40, words(60, 41) + " " + item + " " + words(60, 42)),
                   (50, words(90, 51) + " " + passage + " " + words(90, 52)), (51, words(90, 53) + " " + passage + " " + words(90, 54)),
                   (60, None), (61, ""), (62, "12 34 !!"), (None, words(100, 63)), (20, base[19][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in base} | {50, 51, None}
    text = dict(base)
    lib = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(P.PIECES))
    for i in range(1, 21):
        assert got[i].decoded == text[i] and got[i].ids == lib.encode(text[i], add_bos=True, add_eos=True)
    assert passage in got[50].decoded and passage not in got[51].decoded and got[51].decoded.startswith(words(90, 53))


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "the item text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
    assert decontaminate.normalise("") == ""
