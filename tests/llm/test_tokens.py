"""Encoding, decoding and counting against the installed library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sectio.llm import common, encode as E, queries, token_count as T
from sectio.llm.pieces import Kept, vocabulary

SMALL = "/root/testdata/sf0.001"
PATH = common.tokenizer_path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENC, CNT = E.encoder(PATH), T.counter(PATH)
DEC = E.Decoder(ENC.vocab)
HARD = ["", " ", "  a  b ", "▁a ▁▁ b", "a\x00b\r\n\t x", "日本語😀 é", "<s> </s><0x41> <unk>", "a" * 500, " \n \n\n  ", "﻿x‍", "ab" * 300,
        "\U0001f468‍\U0001f469", "x" + " " * 50 + "y", "=" * 100, "thethethethe" * 40]


def check(text):
    want = LIB.encode(text, add_bos=True, add_eos=True)
    ids = ENC.encode(text)
    assert ids.tolist() == want
    assert DEC.decode(ids) == LIB.decode(want)
    assert CNT.count(text) == len(want) - 2


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


def test_pieces_in_random_order():
    rng = random.Random(1)
    letters = list(" etaoinshr\n▁éß😀") + rng.sample(sorted(ENC.vocab.id), 200)
    for _ in range(1500):
        check("".join(rng.choice(letters) for _ in range(rng.randint(1, 30))))


def test_compatibility_is_what_merging_says():
    rng = random.Random(2)
    pieces = rng.sample(sorted(ENC.vocab.id), 1500)
    for _ in range(10000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert ENC.remerged(a, b) == (E.merge(a + b, ENC.vocab.score)[0] == [a, b]), (a, b)


def test_decoding_any_identifiers():
    rng = random.Random(3)
    ids = list(ENC.vocab.byte_of) + [1, 2, 28705, 264, 259, 500, 28949]
    for _ in range(1500):
        own = [rng.choice(ids) for _ in range(rng.randint(0, 8))]
        assert DEC.decode(np.array(own, "<u4")) == LIB.decode(own), own


def test_units_are_forgotten_not_wrong():
    kept = Kept(len, limit=40)
    assert [kept[w] for w in ["aa", "bbb", "cccc", "aa", "dd"]] == [2, 3, 4, 2, 2] and len(kept) < 4
    assert vocabulary(PATH) is vocabulary(PATH)


def test_operator_cases(spark, words):
    rows = [(1, None, "i"), (2, "", "j"), (3, words(20000, 1), "k"), (3, "again", None), (3, "again", None), (None, "x", "l")]
    df = spark.createDataFrame([(i, t, e, 7) for i, t, e in rows], "doc_id long, text string, ids string, n_tokens int")
    out = E.encode(df, PATH)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    for r in out.collect():
        assert r.ids == LIB.encode(r.text or "", add_bos=True, add_eos=True) and r.decoded == (r.text or "")
    counted = T.count_tokens(df, PATH, limit=100)
    assert counted.columns == ["doc_id", "ids", "n_bytes", "n_tokens", "over_limit"]
    by = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in counted.collect())
    want = sorted((len((t or "").encode()), n := len(LIB.encode(t or "")), n > 100) for _, t, _ in rows)
    assert by == want
    assert E.encode(df.limit(0), PATH).collect() == [] and T.count_tokens(df.limit(0), PATH).collect() == []


def test_queries_match_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got3 = queries.QUERIES["op3_sentencepiece"](spark, SMALL).collect()
    assert len(got3) == len(docs)
    for r in got3:
        ids = LIB.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(LIB.decode(ids).encode()))
    for r in queries.QUERIES["op5_token_counts"](spark, SMALL).collect():
        n = len(LIB.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
