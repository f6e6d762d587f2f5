"""Language identification by hierarchical discrimination.

Features are hashed character n-grams (1 to 4) of the lower-cased letter runs,
with marks for word ends; a document's vector is its relative frequencies, so a
linear machine's score of a document is the mean weight of its n-grams, summed
in numpy over blocks of characters.

Two levels: one-versus-rest linear support vector machines choose the family;
inside a family of several languages, one-versus-one machines vote (ties go to
the larger sum of margins). Machines have squared hinge loss with an L2 penalty,
fitted on the driver on a bounded, hash-drawn sample of labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectio.functions.ordering import hash_first
from sectio.llm.common import carry, cut, lean, sized_batches, texts, typed, unpack

# Families of common languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
}
UND = "und"
GRAMS = 4
DIMS = 2048
BLOCK = 1 << 15
EDGE = np.uint32(1)  # stands for the end of a word inside an n-gram


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0] in members), lang)


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Lower-case code of every code point of the first plane; 0: no letter."""
    return np.array([ord(low) if (c := chr(i)).isalpha() and len(low := c.lower()) == 1 else (i if c.isalpha() else 0) for i in range(1 << 16)], np.uint32)


def letters(text: str) -> np.ndarray:
    """Lower-case codes of the letters, 0 for anything else, one per character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = letter_table()[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    out[high] = [c if chr(c).isalpha() else 0 for c in codes[high].tolist()]
    return out


def grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the n-grams of one length after the other. An n-gram
    lies within a word and the marks at its two ends."""
    solid = codes != 0
    marked = np.where(solid, codes, EDGE)
    h = np.zeros(len(codes), np.uint32)
    inner = np.ones(len(codes), bool)
    for n in range(1, GRAMS + 1):
        size = len(codes) - n + 1
        if size <= 0:
            return
        h = (h[:size] ^ marked[n - 1:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n >= 3:
            inner = inner[:size] & solid[n - 2:n - 2 + size]
        ok = solid if n == 1 else inner[:size] & (solid[:size] | solid[n - 1:])
        at = np.flatnonzero(ok)
        yield at, ((h[at] * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(16)).astype(np.int64) % DIMS


def blocks(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """A text's codes with a mark at either end, in blocks, and how many n-grams
    start in each: a block goes on by what the last of them need."""
    codes = np.concatenate([[0], letters(text), [0]]).astype(np.uint32)
    for at in range(0, len(codes), BLOCK):
        part = codes[at:at + BLOCK + GRAMS - 1]
        yield part, min(BLOCK, len(codes) - at)


def frequencies(text: str) -> np.ndarray | None:
    """Relative frequencies of the hashed n-grams; None without letters."""
    total = np.zeros(DIMS)
    for part, starts in blocks(text):
        for at, h in grams(part):
            total += np.bincount(h[at < starts], minlength=DIMS)
    n = total.sum()
    return total / n if n else None


def mean_weights(bodies: list[str], weights: np.ndarray) -> list[np.ndarray | None]:
    """Mean row of ``weights`` over the n-grams of each text; None without
    letters. Short texts share a block, a long one takes several."""
    sums, counts = np.zeros((len(bodies), weights.shape[1])), np.zeros(len(bodies))
    held, owner, own, size = [], [], [], 0

    def add():
        codes = np.concatenate(held)
        of = np.repeat(owner, [len(x) for x in held])
        counted = np.concatenate([np.arange(len(x)) < n for x, n in zip(held, own)])
        score, number = np.zeros((len(codes), weights.shape[1]), np.float32), np.zeros(len(codes), np.int32)
        for at, h in grams(codes):
            here = counted[at]
            at, h = at[here], h[here]
            score[at] += weights[h]
            number[at] += 1
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        sums[of[first]] += np.add.reduceat(score.astype(float), first, axis=0)
        counts[of[first]] += np.add.reduceat(number, first)

    gap = np.zeros(1, np.uint32)
    for i, t in enumerate(bodies):
        for part, starts in blocks(t):
            held += [part, gap]  # no n-gram reaches from one block into the next
            owner += [i, i]
            own += [starts, 0]
            size += len(part)
            if size >= BLOCK:
                add()
                held, owner, own, size = [], [], [], 0
    if held:
        add()
    return [s / n if n else None for s, n in zip(sums, counts)]


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine for labels -1 and 1, both classes weighing
    the same; accelerated gradient descent from zero (deterministic)."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1.0 / (2 * (weight * (np.einsum("ij,ij->i", x, x, dtype=float) + 1)).sum() + penalty)
    w = z = np.zeros(x.shape[1] + 1)  # the last is the intercept, which is not penalised
    for t in range(rounds):
        pull = weight * y * np.maximum(0, 1 - y * (x @ z[:-1].astype(x.dtype) + z[-1]))
        new = z - step * np.append(penalty * z[:-1] - 2 * (pull.astype(x.dtype) @ x), -2 * pull.sum())
        z, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Machines as columns of ``weights``: one a family, then one a pair."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        """Language and score from the margins of all machines."""
        m = margins + self.bias
        own = m[:len(self.families)]
        family = self.families[int(own.argmax())]
        # Squashed so that a margin of one (the hinge's target) counts 0.95.
        squash = lambda v: 1 / (1 + np.exp(-3 * np.clip(v, -30, 30)))
        rest = np.delete(own, own.argmax())
        score = squash((own.max() - rest.max()) / 2) if len(rest) else 1.0
        langs = self.members[family]
        if len(langs) == 1:
            return langs[0], float(score)
        votes, margin = Counter(dict.fromkeys(langs, 0)), dict.fromkeys(langs, 0.0)
        for (a, b), v in zip(self.pairs, m[len(self.families):]):
            if a in votes and b in votes:
                votes[a if v >= 0 else b] += 1
                margin[a] += v
                margin[b] -= v
        best = max(langs, key=lambda x: (votes[x], margin[x]))
        against = [v if a == best else -v for (a, b), v in zip(self.pairs, m[len(self.families):]) if best in (a, b)]
        return best, float(score * squash(min(against)))


def sampled(rows: DataFrame, per_lang: int) -> DataFrame:
    """One text with letters (the one with the smallest hash) of each of at most
    ``per_lang`` ids of a language, drawn by a hash of the id."""
    rows = rows.where("id is not null and lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    # Ids and hashes are drawn first, so that only the texts of the sample move; a
    # language's cut-off comes from counts, no task sees all of its ids.
    ids = cut(rows.groupBy("id", "lang").agg(F.min("h").alias("h")))
    drawn = hash_first(ids, "", "id", per_lang, ["lang"], order=lambda k: F.lower(F.lpad(F.hex(F.xxhash64(k)), 16, "0"))).select("id", "lang", "h")
    return rows.join(F.broadcast(drawn), ["id", "lang", "h"], "left_semi").groupBy("lang", "id").agg(F.min("text").alias("text"))


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_lang: int = 500) -> Model:
    """Fit on up to ``per_lang`` documents of each non-null language, drawn by a
    hash of their id. Documents without letters are left out; no labelled
    documents give a model that knows no language."""
    rows = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = sampled(rows, per_lang)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 1 << 20):
            found = [frequencies(t) for t in texts(batch.column("text"))]
            keep = pa.array([i for i, x in enumerate(found) if x is not None], pa.int64())
            yield pa.record_batch([batch.column("lang").take(keep), batch.column("id").take(keep),
                                   pa.array([x.astype("<f4").tobytes() for x in found if x is not None], pa.binary())], ["lang", "id", "x"])

    got = rows.mapInArrow(lean(vectors), "lang string, id long, x binary").toPandas().sort_values(["lang", "id", "x"])
    model = Model()
    langs = sorted(got.lang.unique())
    if not langs:
        return model
    x, y = np.stack([np.frombuffer(b, "<f4") for b in got.x]), got.lang.to_numpy()
    scale = np.float32(1 / np.sqrt((x**2).sum(1)).mean())
    x *= scale
    for lang in langs:
        model.members.setdefault(family_of(lang), []).append(lang)
    model.families = sorted(model.members)
    family = np.array([family_of(v) for v in y])
    machines = [fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in model.families] if len(model.families) > 1 else [(np.zeros(DIMS), 0.0)]
    for f in model.families:
        for a, b in combinations(model.members[f], 2):
            own = (y == a) | (y == b)
            model.pairs.append((a, b))
            machines.append(fit_svm(x[own], np.where(y[own] == a, 1.0, -1.0)))
    model.weights, model.bias = np.stack([w * scale for w, _ in machines], 1).astype(np.float32), np.array([b for _, b in machines])
    return model


def _decided(docs: DataFrame, carried: list[str], model: Model, text_col: str) -> DataFrame:
    """``rest`` (the columns ``carried``, the text among them, so it travels once),
    ``lang_pred`` and ``score``."""
    held, place = carry(docs, carried), carried.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few columns of ``DIMS`` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sized_batches(batches, "rest", 4 << 20):
            body = texts(pc.struct_field(batch.column("rest"), [place]).cast(pa.string()))
            means = mean_weights(body, own.weights) if own.families else [None] * len(body)
            out = [(UND, 0.0) if m is None else own.decide(m) for m in means]
            yield pa.record_batch([batch.column("rest"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                                  ["rest", "lang_pred", "score"])

    return held.mapInArrow(lean(run), typed(held, ["rest"], "lang_pred string, score double"))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row (columns of those names are
    replaced). Null texts, texts without letters, and any text under a model
    without languages give ``und`` with score zero."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return unpack(_decided(docs, rest if text_col in rest else [*rest, text_col], model, text_col), rest, "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that is never learned from; a null id is outside it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_lang: int = 500) -> DataFrame:
    """Fit on the rows of ``docs`` outside the held-out fold (ids not null) and predict all."""
    model = fit(docs.where("doc_id is not null").where(~held_out()), per_lang=per_lang)
    return predict(docs, model).withColumn("held_out", held_out())


def keep_known(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Rows whose language is told with ``min_score`` at least; the columns of ``docs``."""
    model = fit(docs.where("doc_id is not null").where(~held_out()))
    return unpack(_decided(docs, docs.columns, model, "text").where((F.col("lang_pred") != UND) & (F.col("score") >= min_score)), docs.columns)
