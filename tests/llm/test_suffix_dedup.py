"""Substring dedup against a dictionary of all windows."""

import hashlib
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from sectio.llm import queries, rolling, suffix_dedup as S

SMALL = "/root/testdata/sf0.001"


def brute(texts, length, mode):
    seen = defaultdict(list)
    for k, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen[t[p:p + length]].append((k, p))
    cover = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places if mode == "all" else sorted(places)[1:]:
                cover[k][p:p + length] = True
    out = []
    for c, t in zip(cover, texts):
        edge = np.diff(np.concatenate([[0], c.astype(int), [0]]))
        out.append((np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), bytes(b for b, x in zip(t, c) if not x)))
    return out


def got(df):
    return {r.doc_id: (r.span_start, r.span_end, bytes(r.kept)) for r in df.collect()}


@pytest.mark.parametrize("mode", ["all", "first"])
@pytest.mark.parametrize("bucket_limit", [2000, 2])
def test_against_all_windows(spark, words, mode, bucket_limit):
    shared, line = words(60, 1), words(30, 2)
    texts = [words(20, 10 + i) + shared[:250 + i] + words(15, 50 + i) for i in range(12)]
    texts += [shared, shared, line + line, "", "x" * 300, "ab" * 200, "é" * 90 + line, words(5000, 99) + line, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = brute([(t or "").encode() for t in texts], 60, mode)
    assert got(S.remove_repeats(df, 60, mode, gram=16, bucket_limit=bucket_limit)) == dict(enumerate(want))


def test_texts_over_one_part(spark, words, monkeypatch):
    body = words(400, 7)
    texts = [body, words(30, 8) + body[100:900], words(50, 9)]
    data = [t.encode() for t in texts]
    monkeypatch.setattr(S, "PART", 500)
    rows = []
    import pyarrow as pa
    for b in S._super_rows(60, 16)(iter([pa.record_batch([pa.array([0, 1, 2]), pa.array(texts)], ["rid", "text"])])):
        rows += b.to_pylist()
    windows = sorted((r["rid"], p) for r in rows for p in range(r["at"] >> 16, (r["at"] >> 16) + (r["at"] & 65535)))
    assert windows == [(i, p) for i, t in enumerate(data) for p in range(len(t) - 60 + 1)]


def test_columns_nulls_repeats_and_empty_table(spark, words):
    line = words(40, 3)
    rows = [(1, line, "a", 5, "k"), (1, line, "b", 6, "k"), (None, line, None, None, None), (2, None, "c", 7, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string, n_bytes int, mh string")
    out = S.remove_repeats(df, 60, "all", gram=16)
    assert out.columns == ["doc_id", "rid", "mh", "span_start", "span_end", "n_bytes", "kept"] or set(out.columns) == {"doc_id", "rid", "mh", "span_start", "span_end", "n_bytes", "kept"}
    res = {(r.doc_id, r.rid): (bytes(r.kept), r.n_bytes) for r in out.collect()}
    n = len(line.encode())
    assert res == {(1, "a"): (b"", n), (1, "b"): (b"", n), (None, None): (b"", n), (2, "c"): (b"", 0)}
    first = S.remove_repeats(df, 60, "first", gram=16)
    assert sorted(len(r.kept) for r in first.collect()) == [0, 0, 0, n]
    assert S.remove_repeats(df.limit(0), 60).collect() == []


def test_previous_factors_on_hand_case():
    data = np.frombuffer(b"abcabcabx", np.uint8)
    back, on = S.previous_factors(data, np.arange(7), 3)
    assert back.tolist() == [0, 0, 0, 3, 3, 3, 0]
    assert on.tolist() == [3, 3, 3, 0, 0, 0, 0]


def test_jumping_links_agree_with_a_scan():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 400):
        place, lcp = rng.permutation(n), rng.integers(0, 9, n)
        want = []
        for i in range(n):
            best, found = 99, 0
            for j in range(i - 1, -1, -1):
                best = min(best, lcp[j + 1])
                if place[j] < place[i]:
                    found = best
                    break
            want.append(found if found >= 3 else 0)
        assert S.neighbour_match(place, lcp, 3).tolist() == want


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 99, 57, dtype=np.uint64)
    assert rolling.sliding_min(x, 8).tolist() == [int(x[i:i + 8].min()) for i in range(50)]


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = {}
    for r, (a, b, kept) in zip(rows, brute([(r.text or "").encode() for r in rows], 200, "all")):
        n = len((r.text or "").encode())
        want[r.doc_id] = (n, n - len(kept), len(a), hashlib.sha256(kept).hexdigest())
    found = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op1_suffix_array_dedup"](spark, SMALL).collect()}
    assert found == want


def test_kept_text_is_valid(spark):
    df = spark.createDataFrame([(1, bytearray("éa".encode()[1:]), [0], [1], 3)], "doc_id long, kept binary, span_start array<long>, span_end array<long>, n_bytes long")
    assert S.kept_texts(df).collect() == [(1, "a")]


@pytest.mark.parametrize("n", [2000, 30000])
def test_memory_of_previous_factors(n):
    """The windows themselves and little more: no index for each of their bytes."""
    length = 200
    data = np.tile(np.random.default_rng(3).integers(0, 255, n // 2 + 100, dtype=np.uint8), 2)
    starts = np.arange(n)
    tracemalloc.start()
    back, on = S.previous_factors(data, starts, length)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    half = len(data) // 2
    assert (back == np.where(starts >= half, length, 0)).all()
    assert (on == np.where(starts + half < n, length, 0)).all()
    assert peak < 1.5 * n * length + 3 * S.ROWS * length


@pytest.mark.parametrize("rows", [1, 7])
def test_neighbours_in_blocks(monkeypatch, rows):
    data = np.frombuffer(b"abcabcabcabxabcabcabc" * 3, np.uint8)
    starts = np.arange(len(data) - 8 + 1)
    whole = S.previous_factors(data, starts, 8)
    monkeypatch.setattr(S, "ROWS", rows)
    for a, b in zip(whole, S.previous_factors(data, starts, 8)):
        assert (a == b).all()
    cut = [bytes(data[i:i + 8]) for i in starts]
    assert (whole[0] >= 8).tolist() == [c in cut[:i] for i, c in enumerate(cut)]
    assert (whole[1] >= 8).tolist() == [c in cut[i + 1:] for i, c in enumerate(cut)]


def test_texts_are_cut_and_decoded_in_one_python_step(spark, words):
    shared = words(60, 1)
    texts = [words(20, 10 + i) + shared for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = S.clean_texts(docs)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    kept = brute([t.encode() for t in texts], S.LENGTH, "first")
    assert {r.doc_id: r.text for r in done.collect()} == {i: k[2].decode() for i, k in enumerate(kept)}
