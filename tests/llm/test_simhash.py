"""SimHash near-dedup against all pairs."""

import numpy as np
import xxhash

from sectio.llm import queries, simhash as S
from sectio.llm.components import components

SMALL = "/root/testdata/sf0.001"


def plain(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    grams = [" ".join(ws[i:i + size]) for i in range(len(ws) - size + 1)] if len(ws) > size else ([" ".join(ws)] if ws else [])
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if grams and 2 * bits[b] > len(grams))


def roots(ids, fps, bits=3):
    fps = np.array(fps, np.uint64)
    label = np.array(ids)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprint_rule():
    for t in ["", "one", "one two", "One TWO three", "a b c d É é x\tq\n", " \t\n", "x " * 5000]:
        assert S.simhash(t) == plain(t), t


def test_every_pattern_of_three_errors_shares_a_key():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64 - 1, 4000, dtype=np.uint64)
    other = base.copy()
    for _ in range(3):
        other ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    ra, ka = S.bucket_keys(base)
    rb, kb = S.bucket_keys(other)
    mine = set(zip(ra.tolist(), ka.tolist()))
    assert len({r for r, k in zip(rb.tolist(), kb.tolist()) if (r, k) in mine}) == 4000


def test_golay_code_is_perfect():
    table, number = S.golay_tables()
    assert table.shape == (2048, 6) and sorted(set(number.tolist())) == [1, 6]
    assert (number == 1).sum() == 1 + 23 + 253


def test_links_with_and_without_large_buckets(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**64 - 1, 5, dtype=np.uint64)
    fps = {int(c) for c in centre}
    for c in centre:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [(i, x - 2**64 if x >= 2**63 else x) for i, x in enumerate(fps)]
    nodes = spark.createDataFrame(signed, "id long, fp long")
    want = roots(range(len(fps)), fps)
    for limit in (512, 3):
        comp = {r.node: r.component for r in components(S.links(nodes, 3, limit)).collect()}
        assert [comp.get(i, i) for i in range(len(fps))] == want


def test_cases(spark, words):
    a = words(80, 1)
    rows = [(5, a), (3, a), (9, a + " tail"), (7, None), (8, ""), (6, " \n"), (1, words(90, 2)), (None, a), (1, words(90, 2)), (11, words(20000, 3)), (12, words(20000, 3))]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, fp int, id string")
    found = S.near_duplicates(df).collect()
    assert len(found) == len(rows)
    named = [(i, plain(t)) for i, t in rows if i is not None]
    want = dict(zip([i for i, _ in named], roots([i for i, _ in named], [f for _, f in named])))
    for r in found:
        assert r.component_id == want.get(r.doc_id)
    assert {r.component_id for r in found if r.doc_id in (6, 7, 8)} == {6}
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted({*want.values(), 0})
    assert S.near_duplicates(df.limit(0)).collect() == [] and S.keep_one(df.limit(0)).collect() == []


def test_repeated_id_ties_its_texts(spark, words):
    rows = [(1, words(50, 1)), (2, words(50, 2)), (2, words(50, 1)), (4, words(50, 2))]
    found = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {1}


def test_query_matches_all_pairs(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, roots([r.doc_id for r in rows], fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op8_simhash_near_dedup"](spark, SMALL).collect()} == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 300))


def test_no_broadcast_grows_with_the_rows(spark, words, monkeypatch):
    """Tables that shuffle to under the broadcast limit are joined as larger ones
    are: nothing of them is a hash table in the driver."""
    from sectio import session
    from sectio.llm import common, components as C

    made = []

    def seen(write):
        def run(df):
            made.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df)
        return run

    monkeypatch.setattr(common, "write_shared", seen(common.write_shared))
    monkeypatch.setattr(C, "cut_lineage", seen(session.cut_lineage))
    base = [words(60, seed=i) for i in range(12)]
    rows = [(i, base[i % 12] + (" x" if i % 24 > 11 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = S.near_duplicates(df)
    got = {r.doc_id: r.component_id for r in out.collect()}
    made.append(out._jdf.queryExecution().executedPlan().toString())
    fps = [S.simhash(t) for _, t in rows]
    assert [got[i] for i, _ in rows] == roots([i for i, _ in rows], fps)
    joins = [line for plan in made for line in plan.splitlines() if "Join" in line]
    assert joins and not [line for line in joins if "SortMergeJoin" not in line], joins
