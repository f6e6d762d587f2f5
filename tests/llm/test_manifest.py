"""Merkle manifest against a plain recursive tree."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectio.llm import merkle as M

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fan):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i:i + fan])) for i in range(0, len(now), fan)])
    return levels


def path(levels, place, fan):
    out = []
    for level in levels[:-1]:
        run = place // fan * fan
        out.append((level[run:place], level[place + 1:run + fan]))
        place //= fan
    return out


def plain(rows, fan, tampered):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf_of(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = climb([x[1] for x in groups[s]], fan)
    top = climb([trees[s][-1][0] for s in names], fan)
    out = []
    for i, s in enumerate(names):
        for place, (doc, leaf, row) in enumerate(groups[s]):
            steps = path(trees[s], place, fan) + path(top, i, fan)
            folded = leaf_of(tampered(row)) if tampered(row) is not None else leaf
            for before, after in steps:
                folded = sha("".join(before) + folded + "".join(after))
            proof = [d for before, after in steps for d in before + after]
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], sha("".join(proof)), folded, folded == top[-1][0], proof))
    return sorted(out, key=repr)


def lowered(row):
    return (*row[:4], row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])) if row[0] is not None and row[0] % 3 == 0 else None


def claim():
    cols = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in COLUMNS]
    return F.when(F.col("doc_id") % 3 == 0, M.leaf_digest(cols))


def table(n=150):
    rng = random.Random(3)
    rows = [(i, "big" if i % 2 else f"s{i % 23}", rng.choice(["en", None]), i * 7, f"Text {i} É{rng.random()}") for i in range(n)]
    rows += [(4, "big", "en", 1, "again"), (4, "big", "en", 1, "again"), (5, None, None, None, None), (None, "big", "x", 1, "No id"), (None, None, None, None, ""),
             (900, "", "en", 2, "ÀBC " * 20000), (901, "é", "en", 2, "A"), (902, "z", "en", 2, "lower only"), (903, "lone", "en", 2, "Upper")]
    return rows


@pytest.mark.parametrize("fan, part_bits", [(16, 12), (2, 1), (3, 2), (16, 0)])
def test_all_proofs(spark, monkeypatch, fan, part_bits):
    monkeypatch.setattr(M, "PART_BITS", part_bits)
    rows = table()
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", tree int, leaf int, `a.b` string").repartition(5)
    got = [tuple(r) for r in M.prove(M.build(df, COLUMNS, claim=claim(), fan=fan), proofs=True).collect()]
    assert sorted(got, key=repr) == plain(rows, fan, lowered)
    bad = {r[0] for r in got if not r[6]}
    assert 903 in bad and 901 not in bad and 0 in bad


def test_some_leaves_only(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_BITS", 3)
    rows = table()
    made = M.build(spark.createDataFrame(rows, SCHEMA), COLUMNS, fan=4)
    got = [tuple(r) for r in M.prove(made, made.leaves.where("id % 7 = 0 or id is null"), proofs=True).collect()]
    want = [r for r in plain(rows, 4, lambda r: None) if r[0] is None or r[0] % 7 == 0]
    assert sorted(got, key=repr) == want and all(r[6] for r in got)


def test_many_groups_and_tiny_tables(spark):
    for rows in ([(i, f"host{i}", "en", 1, f"T{i}") for i in range(300)], [(1, None, None, None, None)], [(1, "a", "b", 3, "T")] * 40):
        got = [tuple(r) for r in M.prove(M.build(spark.createDataFrame(rows, SCHEMA), COLUMNS, claim=claim()), proofs=True).collect()]
        assert sorted(got, key=repr) == plain(rows, 16, lowered)
    assert M.prove(M.build(spark.createDataFrame([], SCHEMA), COLUMNS)).collect() == []


def test_missing_is_minimal():
    """Fetched nodes are those that a proof needs and nothing known derives."""
    rng = random.Random(1)
    for _ in range(300):
        fan, size = rng.choice([2, 3, 16]), rng.randint(1, 200)
        known = sorted(rng.sample(range(size), rng.randint(1, size)))
        need, derived, n, level = set(), set(known), size, 0
        want: set = set()
        while n > 1:
            for k in derived:
                run = k // fan * fan
                need |= {(level, i) for i in range(run, min(run + fan, n)) if i not in derived}
            derived, n, level = {k // fan for k in derived}, -(-n // fan), level + 1
        want = need
        got = [(level, int(i)) for level, places in M.missing(np.array(known), size, fan) for i in places]
        assert len(got) == len(set(got)) and set(got) == want
    assert M.missing(np.arange(50), 50, 16) and sum(len(p) for _, p in M.missing(np.arange(50), 50, 16)) == 0


def test_bad_fan(spark):
    with pytest.raises(ValueError):
        M.build(spark.createDataFrame([], SCHEMA), COLUMNS, fan=1)
