"""Token counts by heap-and-linked-list merging, without making identifiers.

A unit's characters form a linked list of symbols. A heap holds the adjacent
pairs whose concatenation is a piece, best rank first and leftmost on ties;
popping a pair that still stands merges it. The count is the number of initial
symbols minus the number of merges, where a character in no piece counts as its
bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sectio.llm.common import carry, ending, lean, quoted, sized_batches, texts, typed, unpack
from sectio.llm.pieces import Kept, Vocabulary, vocabulary


class Counter:
    def __init__(self, vocab: Vocabulary):
        self.letters = vocab.letters
        self.rank = vocab.rank
        self.units = Kept(self.unit)
        self.vocab = vocab

    def unit(self, text: str) -> int:
        symbols = len(text) if self.letters.issuperset(text) else sum(1 if c in self.letters else len(c.encode()) for c in text)
        return symbols - self.merges(text)

    def merges(self, text: str) -> int:
        """Number of merges; symbol i spans ``text[i:end[i]]``."""
        n, rank = len(text), self.rank
        end = list(range(1, n + 1))       # where the symbol ends, and so where the next one starts
        last = list(range(-1, n - 1))     # where the symbol before starts
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(text[i:i + 2])) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            # It stands if both symbols are still there and reach up to ``stop``.
            if mid <= i or mid >= n or mid >= stop or end[mid] != stop:
                continue
            end[i], end[mid] = stop, -1
            done += 1
            if stop < n:
                last[stop] = i
                r = rank.get(text[i:end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := last[i]) >= 0:
                r = rank.get(text[j:stop])
                if r is not None:
                    heapq.heappush(heap, (r, j, stop))
        return done

    def count(self, text: str) -> int:
        return sum(map(self.units.__getitem__, self.vocab.units(text)))


@lru_cache(4)
def counter(path: str) -> Counter:
    """One per path and Python worker: tasks share the vocabulary."""
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` to every row
    (columns of these names are replaced). Null texts count as empty: no bytes,
    no tokens. Rows are independent; nothing is truncated or padded."""
    added = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in docs.columns if c not in (*added, text_col)]
    held = carry(docs, keep, text=quoted(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in ending(sized_batches(batches, "text"), own.units.forget):
            body = texts(batch.column("text"))
            n = [own.count(t) for t in body]
            yield pa.record_batch([batch.column("rest"), pa.array([len(t.encode()) for t in body], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                                  ["rest", *added])

    return unpack(held.mapInArrow(lean(run), typed(held, ["rest"], "n_bytes long, n_tokens long, over_limit boolean")), keep, *added)
