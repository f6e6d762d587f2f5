"""Three text vectorisers over one table of weighted grams.

``weights`` holds a row per text and trigram with its TF-IDF weight, the texts'
vectors scaled to length one. Trigrams are counted inside the tasks, and the tables
of grams are written, so that their size is known and they go to the rows, not the
rows to their gram. From it, each by one aggregate per text:

* ``hashed``: TF-IDF with the grams hashed, with signs, to ``BUCKETS`` places;
* ``projected``: a random projection to ``WIDE`` places, the signs taken from the
  bits of each gram's md5;
* ``reduced``: a randomised SVD. ``NARROW`` random directions, pulled once through
  the matrix and back, span nearly the space of its leading singular vectors; their
  ``NARROW`` x ``NARROW`` products, the only thing collected, make them orthonormal,
  and a text's vector are its coordinates in that basis.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectio.functions.frames import materialize, with_scalars
from sectio.functions.grams import key_gram_counts

BUCKETS = 64
WIDE = 32
NARROW = 8


def gram_bits(gram: Column) -> Column:
    """32 bits of the gram's md5."""
    return F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("bigint")


def sign(bits: Column, place: int) -> Column:
    return F.when(F.shiftright(bits, place).bitwiseAND(F.lit(1)) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def weights(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, bits, x): TF-IDF (count times log of texts over texts with the
    gram) over the text's length, and the gram's bits. Grams that all texts hold
    weigh nothing; texts without any other have no rows."""
    held = materialize(key_gram_counts(texts, key, text, "__g"))
    df = held.select(F.inline("__g").alias("gram", "n")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    total = texts.groupBy().agg(F.count(F.lit(1)).alias("total"))
    idf = materialize(with_scalars(df, total).where(F.col("df") < F.col("total"))
                      .select("gram", gram_bits(F.col("gram")).alias("bits"), F.log(F.col("total") / F.col("df")).alias("idf")))
    w = held.select(key, F.inline("__g").alias("gram", "n")).join(idf, "gram").select(key, (F.col("n") * F.col("idf")).alias("__w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__norm"))
    own = held.join(norm, key).select(key, "__norm", F.inline("__g").alias("gram", "n"))
    return own.join(idf, "gram").select(key, "gram", "bits", (F.col("n") * F.col("idf") / F.col("__norm")).alias("x"))


def hashed(w: DataFrame, key: str) -> DataFrame:
    """(key, v): TF-IDF hashed to ``BUCKETS`` places."""
    own = w.select(key, F.pmod(F.col("bits"), F.lit(BUCKETS)).alias("b"), (F.col("x") * sign(F.col("bits"), 31)).alias("y"))
    per = own.groupBy(key, "b").agg(F.sum("y").alias("y")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "y"))).alias("m"))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(BUCKETS - 1).cast("bigint"))
    return per.select(key, F.transform(places, lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("v"))


def projected(w: DataFrame, key: str, dims: int = WIDE) -> DataFrame:
    """(key, v): random projection to ``dims`` places (32 at most)."""
    return w.groupBy(key).agg(F.array(*(F.sum(F.col("x") * sign(F.col("bits"), j)) for j in range(dims))).alias("v"))


def orthonormal(products: np.ndarray) -> np.ndarray:
    """The matrix that makes columns with these inner products orthonormal, each
    from itself and the ones before (as Gram and Schmidt do)."""
    return np.linalg.inv(np.linalg.cholesky(products)).T


def reduced(w: DataFrame, key: str, dims: int = NARROW) -> DataFrame:
    """(key, v): coordinates in the basis of a randomised SVD."""
    places = range(dims)
    y = projected(w, key, dims).withColumnRenamed("v", "y")
    back = materialize(w.join(y, key).groupBy("gram").agg(*(F.sum(F.col("x") * F.col("y")[j]).alias(f"b{j}") for j in places)))
    got = back.agg(*(F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"p{i}_{j}") for i in places for j in places if i <= j)).first()
    products = np.array([[got[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in places] for i in places])
    turn = orthonormal(products) if products.any() else np.zeros((dims, dims))
    basis = back.select("gram", *(sum((F.col(f"b{i}") * float(turn[i, j]) for i in range(j + 1)), F.lit(0.0)).alias(f"q{j}") for j in places))
    return w.join(basis, "gram").groupBy(key).agg(F.array(*(F.sum(F.col("x") * F.col(f"q{j}")) for j in places)).alias("v"))


VECTORIZERS = {"hashed": hashed, "projected": projected, "reduced": reduced}
