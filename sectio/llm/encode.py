"""Exact encoding and decoding with a merge-type sentencepiece vocabulary.

Encoding is by backtracking. An Aho-Corasick automaton over all pieces finds the
longest piece that starts at each place. From the left, the longest piece is
taken that is compatible with the piece before it; if none is, the place is
marked as failed in a bit field, the piece before it is given up, and its next
shorter prefix is tried. Two adjacent pieces are compatible if merging their
joined characters again, best score first and leftmost on ties, gives just these
two. Only merges across their common edge could prevent that, so the merges of
either side are taken back from the last one on, and at each step the two
symbols at the edge must not have been merged before. An encoding whose
neighbours are all compatible is the one that the merges lead to. Characters in
no piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.llm.common import carry, ending, lean, quoted, sized_batches, texts, typed, unpack
from sectio.llm.pieces import MARK, Kept, Vocabulary, vocabulary


def merge(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Pieces that repeated merging of the best adjacent pair (leftmost on ties)
    leads to, and the last pair that was merged."""
    part, last = list(text), None
    while True:
        pairs = [(s, -i) for i in range(len(part) - 1) if (s := score.get(part[i] + part[i + 1])) is not None]
        if not pairs:
            return part, last
        i = -max(pairs)[1]
        last = (part[i], part[i + 1])
        part[i:i + 2] = ["".join(last)]


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.fits: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str | None] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in vocab.id:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.units = Kept(self.unit_bytes)

    def parts(self, piece: str) -> tuple[int, str, str]:
        """Rank of the last merge that makes a piece, and the two it joins; -1
        for a single character."""
        known = self.made.get(piece)
        if known is None:
            done, last = merge(piece, self.vocab.score)
            if done != [piece]:
                raise ValueError(f"no merges lead to the piece {piece!r}")
            known = self.made[piece] = (self.vocab.rank[piece], *last) if last else (-1, "", "")
        return known

    def remerged(self, left: str, right: str) -> bool:
        rank, parts = self.vocab.rank, self.parts
        before = len(rank)  # merges across the edge with a smaller rank would have come first
        (x, _, inner), (y, outer, _) = parts(left), parts(right)
        while True:
            across = rank.get(left + right)
            if across is not None and across < before:
                return False
            if x > y:
                before, left = x, inner
                x, _, inner = parts(left)
            elif y >= 0:  # of equal ranks, the one further left comes first
                before, right = y + 1, outer
                y, outer, _ = parts(right)
            else:
                return True

    def forget(self) -> None:
        """Drop what was kept of units and pairs (at the end of a task)."""
        self.units.forget()
        self.fits.clear()

    def compatible(self, left: str, right: str) -> bool:
        """Whether re-merging two pieces gives the two again."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= 100_000:
                self.fits.clear()
            known = self.fits[key] = self.remerged(left, right)
        return known

    def prefix(self, piece: str) -> str | None:
        """The longest piece that is a proper prefix of a piece."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.vocab.id), None)
        return self.shorter[piece]

    def known(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all in the vocabulary."""
        longest = lambda at: next(self.automaton.iter_long(text, at))[1]  # noqa: E731  every character is a piece
        open_places = bytearray(b"\x01") * (len(text) + 1)  # zero: no encoding goes on from here
        out: list[str] = []
        place, candidate = 0, longest(0)
        while place < len(text):
            while candidate is not None:
                end = place + len(candidate)
                if open_places[end] and (not out or self.compatible(out[-1], candidate)):
                    break
                candidate = self.prefix(candidate)
            if candidate is not None:
                out.append(candidate)
                place += len(candidate)
                candidate = longest(place) if place < len(text) else None
                continue
            open_places[place] = 0
            if not out:
                raise ValueError("no encoding found")
            candidate = out.pop()
            place -= len(candidate)
        return out

    def unit_ids(self, unit: str) -> list[int]:
        vocab, ids, run = self.vocab, [], []
        if vocab.letters.issuperset(unit):
            return [vocab.id[p] for p in self.known(unit)]
        for c in unit:
            if c in vocab.letters:
                run.append(c)
                continue
            if run:
                ids += (vocab.id[p] for p in self.known("".join(run)))
                run = []
            ids += (vocab.byte_id[b] for b in c.encode())
        if run:
            ids += (vocab.id[p] for p in self.known("".join(run)))
        return ids

    def unit_bytes(self, unit: str) -> bytes:
        return struct.pack(f"<{len(ids := self.unit_ids(unit))}I", *ids)

    def encode(self, text: str, ends: bool = True) -> np.ndarray:
        """Identifiers as little-endian 32-bit integers, with begin and end ids."""
        body = b"".join(map(self.units.__getitem__, self.vocab.units(text)))
        if ends:
            body = b"".join((self.vocab.bos.to_bytes(4, "little"), body, self.vocab.eos.to_bytes(4, "little")))
        return np.frombuffer(body, "<u4")


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One per path and Python worker: tasks share the automaton."""
    return Encoder(vocabulary(path))


class Decoder:
    """Text of identifiers: control ids are silent, runs of byte pieces are
    UTF-8 (a byte that is none gives U+FFFD), one space before the text goes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.plain = [t.replace(MARK, " ") for t in vocab.text]
        for i in vocab.control:
            self.plain[i] = "" if i in (vocab.bos, vocab.eos) else f" {chr(0x2047)} "  # the library's sign for unknown
        self.high = np.zeros(len(self.plain), bool)
        for i, b in vocab.byte_of.items():
            # Bytes over 127 stand as lone surrogates until their run is complete.
            self.plain[i] = chr(b) if b < 128 else chr(0xDC00 + b)
            self.high[i] = b >= 128
        self.run = re.compile("[\udc80-\udcff]+")

    @staticmethod
    def utf8(run: re.Match) -> str:
        body, out, at = run[0].encode("utf-8", "surrogateescape"), [], 0
        while at < len(body):
            for n in (2, 3, 4):
                try:
                    out.append(body[at:at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)

    def decode(self, ids: np.ndarray) -> str:
        text = "".join(map(self.plain.__getitem__, ids.tolist()))
        if self.high[ids].any():
            text = self.run.sub(self.utf8, text)
        if text.startswith(" ") and self.starts_with_mark(ids):
            text = text[1:]
        return text

    def starts_with_mark(self, ids: np.ndarray) -> bool:
        for i in ids.tolist():
            if i not in self.vocab.control:
                return self.vocab.text[i].startswith(MARK)
        return False


def encode(docs: DataFrame, path: str, text_col: str = "text", ends: bool = True) -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded``; columns of these names are
    replaced. Null texts count as empty (begin and end ids only, decoded empty).
    U+2581 inside a text reads as a space, as in the library. One long text is
    one task's work; rows are independent, so copies and ties change nothing."""
    rest = [c for c in docs.columns if c not in ("ids", "decoded")]
    held = carry(docs, rest, text=quoted(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        dec = Decoder(enc.vocab)
        for batch in ending(sized_batches(batches, "text", 4 << 20), enc.forget):
            ids = [enc.encode(t, ends) for t in texts(batch.column("text"))]
            edges = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            yield pa.record_batch([
                batch.column("rest"), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids).astype(np.int32))),
                pa.array([dec.decode(i) for i in ids], pa.string())], ["rest", "ids", "decoded"])

    return unpack(held.mapInArrow(lean(run), typed(held, ["rest"], "ids array<int>, decoded string")), rest, "ids", "decoded")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Digest columns of ``encode`` in the same pass over the text, so that the
    identifiers themselves need not leave the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        dec = Decoder(enc.vocab)
        for batch in ending(sized_batches(batches, "text"), enc.forget):
            out = []
            for t in texts(batch.column("text")):
                ids = enc.encode(t)
                out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(dec.decode(ids).encode()).hexdigest()))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))],
                                  ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"))
