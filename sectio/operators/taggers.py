"""Noun phrases from a user's own part-of-speech tagger.

A ``Tagger`` names a function that loads a model in a worker and returns a
function from sentences to lists of ``Token``. A finite-state chunker finds noun
chunks in the tags; each is extended by adjectives and prepositional phrases of
its root, and tokens that a phrase has covered start no other one. With heads and
dependencies in the tokens the extensions are read off the tree; with tags alone
they are the preposition, determiner and chunk that follow directly.

``stop_words`` is the rule of ``functions.text`` as a tagger: its phrases are those
that the library makes without a hook.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.functions import stopwords as SW
from sectio.functions.frames import carry, quoted, sized_batches, typed, unpack

SLICE_BYTES = 1 << 20
NOUNS = {"NOUN", "PROPN"}
_LOADED: dict[str, Callable] = {}


class Token(NamedTuple):
    """``tag`` is a universal part-of-speech tag; ``head`` the number of the token's
    head (its own for the root; -1 unknown), ``dep`` the dependency on it."""

    text: str
    tag: str
    head: int = -1
    dep: str = ""


@dataclass(frozen=True)
class Tagger:
    name: str
    load: Callable[[], Callable[[list[str]], list[list[Token]]]]
    determiners: bool = True  # a determiner before a chunk belongs to it
    tails: int = 1  # prepositional phrases read off tags alone

    def tokens(self, sentences: list[str]) -> list[list[Token]]:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        try:
            out = [[Token(*t) for t in s] for s in _LOADED[self.name](sentences)]
        except Exception as e:
            raise RuntimeError(f"tagger {self.name} failed on {len(sentences)} sentences: {type(e).__name__}: {e}") from e
        if len(out) != len(sentences):
            raise ValueError(f"tagger {self.name} gave {len(out)} results for {len(sentences)} sentences")
        return out


# The chunker: state -> tag -> next state. A chunk is read as far as states go on;
# it ends after its last noun, and a run without a noun is no chunk.
CHUNKER = {
    "start": {"DET": "open", "ADJ": "open", "NUM": "open", "NOUN": "noun", "PROPN": "noun"},
    "open": {"ADJ": "open", "NUM": "open", "NOUN": "noun", "PROPN": "noun"},
    "noun": {"ADJ": "open", "NUM": "open", "NOUN": "noun", "PROPN": "noun"},
}


def chunks(tags: list[str], determiners: bool = True) -> list[tuple[int, int]]:
    """Start and end of each noun chunk, left to right, without overlap."""
    out, at = [], 0
    while at < len(tags):
        state, i, end = "start", at, at
        while i < len(tags) and (state := CHUNKER[state].get(tags[i], "")):
            i += 1
            if state == "noun":
                end = i
        if end > at:
            out.append((at + (not determiners and tags[at] == "DET"), end))
        at = end if end > at else max(i, at + 1)
    return out


def _subtree(tokens: list[Token], top: int) -> list[int]:
    found, todo = {top}, [top]
    while todo:
        at = todo.pop()
        new = [i for i, t in enumerate(tokens) if t.head == at and i not in found]
        found.update(new)
        todo += new
    return sorted(found)


def noun_phrases(tokens: list[Token], determiners: bool = True, tails: int = 1) -> list[str]:
    """Adjectives, chunk and prepositional phrases of each chunk whose tokens no
    earlier phrase has covered. Phrases without a letter are left out."""
    tags, covered, out = [t.tag for t in tokens], set(), []
    found = chunks(tags, determiners)
    start = {a: (a, b) for a, b in found}
    tree = any(t.head >= 0 for t in tokens)
    for a, b in found:
        if any(i in covered for i in range(a, b)):
            continue
        base = " ".join(t.text for t in tokens[a:b])
        before, after = [], []
        if tree:
            inside = [i for i in range(a, b) if tags[i] in NOUNS]
            root = next((i for i in inside if not a <= tokens[i].head < b or tokens[i].head == i), inside[-1])
            for i, t in enumerate(tokens):
                if t.head != root or i == root:
                    continue
                if t.tag == "ADJ" and t.text not in base:
                    before.append(t.text)
                elif t.dep == "prep":
                    own = _subtree(tokens, i)
                    after.append(" ".join(tokens[k].text for k in own))
                    covered.update(own)
        else:
            end = b
            for _ in range(tails):
                at = end + 1
                if end >= len(tags) or tags[end] != "ADP":
                    break
                at += at < len(tags) and tags[at] == "DET" and at not in start
                if at not in start:
                    break
                after.append(" ".join(t.text for t in tokens[end:start[at][1]]))
                covered.update(range(end, start[at][1]))
                end = start[at][1]
        covered.update(range(a, b))
        phrase = " ".join([*before, base, *after])
        if any(c.isalpha() for c in phrase):
            out.append(phrase)
    return out


def phrases(sents: DataFrame, keys: list[str], tagger: Tagger, sentence: str = "sentence") -> DataFrame:
    """Rows (keys, phrase_idx, phrase, sentence) of every sentence's noun phrases;
    a null sentence has none. Sentences go through the tagger in Arrow slices of
    bounded bytes, each worker loads it once."""
    held = carry(sents, keys, sentence=quoted(sentence).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "sentence", SLICE_BYTES):
            body = ["" if s is None else s for s in batch.column("sentence").to_pylist()]
            found = [noun_phrases(t, tagger.determiners, tagger.tails) for t in tagger.tokens(body)]
            yield pa.record_batch([batch.column("rest"), batch.column("sentence"), pa.array(found, pa.list_(pa.string()))], ["rest", "sentence", "found"])

    out = held.mapInArrow(run, typed(held, ["rest", "sentence"], "found array<string>"))
    return unpack(out.select("rest", "sentence", F.posexplode("found").alias("phrase_idx", "phrase")), keys, "phrase_idx", "phrase", F.col("sentence").alias(sentence))


WORD = re.compile(r"[^\W_]+(?:['’\-.][^\W_]+)*|[^ \t\n\r\f\x0b]")


def stop_words(lang: str = "en") -> Tagger:
    """The stop-word rule as a tagger: any word that is no stop word counts as a
    noun, so that a chunk is a run of content words."""
    def load():
        adp, det, other = (set(w[lang]) for w in (SW.PREPOSITIONS, SW.DETERMINERS, SW.OTHER_STOPWORDS))

        def tag(word: str) -> str:
            low = word.lower()
            if low in adp:
                return "ADP"
            if low in det:
                return "DET"
            return "X" if low in other or not any(c.isalnum() for c in word) else "NOUN"

        return lambda sentences: [[Token(w, tag(w)) for w in WORD.findall(s)] for s in sentences]

    return Tagger(f"stop_words_{lang}", load, determiners=False)
