"""Filter audit against applying every order to every document."""

from collections import Counter
from itertools import permutations

import pytest

from sectio.llm import filter_audit as A

WS = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in WS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def failing(text):
    ws = words_of(text)
    caps = sum("A" <= c <= "Z" for c in text)
    return {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * caps > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for doc, text, part in rows:
        text = text or ""
        fails = failing(text)
        fails["E"] = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)
        docs.append((part or "", fails, doc in good, doc in toxic))
    out, total = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                total[part, f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), sum(d[1][f] for d in own) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone))
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_against_every_order(spark, words):
    rows = []
    for i in range(60):
        text = words(20 + i, i) if i % 3 else words(12, i) + (" again and again" * i)
        text = text.upper() if i % 7 == 0 else text
        rows.append((i, text + (" $5" if i % 5 == 0 else ""), [None, "a", "b", ""][i % 4]))
    copy = words(90, 999)
    rows += [(100 + i, copy, "c" if i % 2 else "a") for i in range(30)] + [(50, copy, "c"), (50, copy, "c")]
    rows += [(200, None, "a"), (201, "", None), (202, " \t", "a"), (None, copy, "a"), (None, None, None), (203, " ".join(["x"] * 80), "a"), (204, "é" * 40 + "AB", "a"), (205, "w " * 60000, "b")]
    labels = [(i, i % 2, 1 if i % 6 == 0 else 0) for i in range(0, 130)] + [(3, 0, 1), (None, 1, 1), (9999, 1, 1), (7, None, None), (103, 1, None)]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, source string, part int, `a.b` string").repartition(6)
    got = A.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain(rows, labels)
    assert len(got) == len(want) == 600 * 4
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "x", None)], docs.schema)
    rows = A.audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.shapley for r in rows if r.filter_order == "ABCDE") == 120


def test_potential_is_the_mean_over_orders():
    counts = {0: 5, 1: 3, 6: 10, 9: 2, 31: 4, 16: 7, 12: 1}
    w = A.worths(counts)
    p = A.potentials(w)
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[:order.index(i)])
            total += w[before | 1 << i] - w[before]
        assert p[31] - p[31 ^ 1 << i] == total
    assert sum(p[31] - p[31 ^ 1 << i] for i in range(5)) == 120 * w[31]


@pytest.mark.parametrize("text", ["", "a", "É" * 50, "A" * 6 + "b" * 94, "A" * 5 + "b" * 95, "x|y", "x y", "one two " * 40, "\x1f\x1c a \x85 b"])
def test_masks(text):
    want = sum(1 << i for i, f in enumerate("ABCD") if failing(text)[f])
    assert A.Rules().mask(text.encode()) == want
