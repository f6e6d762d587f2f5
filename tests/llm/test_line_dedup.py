"""Line dedup against plain counting, and the perfect hash on its own."""

import random

import numpy as np
import pytest

from sectio.llm import line_dedup as L


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, min_docs, min_chars=1):
    found: dict = {}
    for _, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            found[k] = found.get(k, 0) + 1
    gone = {k for k, n in found.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in gone]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def table():
    rng = random.Random(8)
    lines = [f"Line {i} é" for i in range(300)] + ["", " ", "\t", " ", "Ä", "ä", "x", "X ", "\x0bx\r", "a b"]
    weight = [1 / (i + 1) for i in range(len(lines))]
    rows = [(i, "\n".join(rng.choices(lines, weight, k=rng.randint(1, 30)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "line 0 É\nLINE 0 é\r\nline 0 é"), (None, "Line 0 é"), (None, None), (3, rows[3][1]), (3, rows[3][1]), (4, "Line 1 é\nonly here"),
             (504, "long " * 50000 + "\n" + "y\n" * 50000)]
    return rows


@pytest.mark.parametrize("heavy, shard_keys, min_docs, min_chars", [(1 << 16, 1 << 13, 10, 1), (20, 16, 10, 1), (1, 7, 5, 1), (3, 1, 2, 3), (50, 1000, 1, 1)])
def test_against_plain_counts(spark, heavy, shard_keys, min_docs, min_chars):
    rows = table()
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, id int, `a.b` string").repartition(7)
    got = [tuple(r) for r in L.drop_common_lines(df, min_docs, min_chars, shard_keys, heavy).collect()]
    assert sorted(got, key=repr) == plain(rows, min_docs, min_chars)


def test_empty_table_and_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = L.drop_common_lines(df)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept"] and out.collect() == []
    blank = spark.createDataFrame([(i, None if i % 2 else "") for i in range(20)], df.schema)
    assert {tuple(r)[1:] for r in L.drop_common_lines(blank).collect()} == {(1, 0, "")}
    with pytest.raises(ValueError):
        L.drop_common_lines(df, min_docs=0)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    pair = rng.integers(0, 2**64 - 1, (n, 2), dtype=np.uint64)
    pair[: n // 3, 0] = 77  # equal first halves
    number = rng.integers(1, 2**40, n)
    index = L.LineIndex.build(pair[:, 0].copy(), pair[:, 1].copy(), number)
    at = index.number(pair[:, 0], pair[:, 1])
    assert sorted(at.tolist()) == list(range(n))
    again = L.LineIndex.of(*index.row())
    assert (again.count(pair[:, 0], pair[:, 1]) == np.minimum(number, 2**32 - 1)).all()
    other = rng.integers(0, 2**64 - 1, (1000, 2), dtype=np.uint64)
    assert (again.count(other[:, 0], other[:, 1]) == 0).all()
    if n > 1000:
        assert sum(index.sizes) < 4 * n  # bits a key


def test_keys_of_bytes():
    for line in ["", " a B\t", "ÀB é ", "\x0b\x0cQ\r", " x ", "a b"]:
        assert L.line_key(line.encode()).decode() == key(line)
