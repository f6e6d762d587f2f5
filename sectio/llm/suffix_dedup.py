"""Exact substring dedup with longest-previous-factor arrays.

A window is ``length`` bytes of a text; it is repeated if the same bytes start
anywhere else (any document, the same one included, overlaps count). Texts are
judged as they come in. ``mode="first"`` removes every byte covered by a window
that occurs earlier (smaller id, then smaller place), keeping the first copy;
``mode="all"`` removes every byte covered by any repeated window.

Plan. All suffixes of a corpus cannot be sorted in one place, so they are dealt
out such that windows that can be equal meet:

1. ``rolling.super_windows`` cuts each text into super-windows (runs of windows
   that share a minimizer), about one per 65 bytes. Only their hashes travel.
   Minimizers that occur once are dropped by one partial aggregation and a join.
2. Identical super-windows are counted by their hashes (128 bits): each window
   of a later copy has an earlier one.
3. Of minimizers under which different super-windows meet, one representative
   each is fetched as bytes. Per minimizer the suffixes at window starts are
   sorted (as far as ``length`` bytes), and the capped longest-previous-factor
   array follows from the previous and next smaller text position in suffix
   order. Its mirror image, with larger positions, gives matches further on.
   Under a minimizer with over ``bucket_limit`` representatives (a passage that
   a large share of all documents holds, next to varying text), windows are
   dealt out one by one by a 128-bit hash and counted, with partial aggregation.
4. Covered ranges are gathered per document and cut out of its bytes.

Work and shuffled bytes are linear in the input; a document is in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.llm.common import carry, cut, lean, quoted, sized_batches, text_bytes, typed, unpack
from sectio.llm.rolling import Hashed, ranges, super_windows

LENGTH = 200
GRAM = 40
SLICE = 1 << 17
ROWS = 4096  # neighbours compared at once
BUCKET_LIMIT = 2000
ADDED = ["span_start", "span_end", "n_bytes", "kept"]


def neighbour_match(place: np.ndarray, lcp: np.ndarray, floor: int) -> np.ndarray:
    """Longest common prefix of each suffix with the nearest one before it in
    suffix order that starts at a smaller place (zero if under ``floor``).

    ``lcp[i]`` belongs to neighbours ``i - 1`` and ``i``. Links to the previous
    smaller place are found by jumping along the links found so far."""
    n = len(place)
    link = np.arange(-1, n - 1)
    best = lcp.astype(np.int64).copy()
    if n:
        best[0] = 0
    todo = np.flatnonzero((link >= 0) & (best >= floor))
    todo = todo[place[link[todo]] > place[todo]]
    while len(todo):
        via = link[todo]
        best_next = np.minimum(best[todo], best[via])
        link_next = link[via]
        best[todo], link[todo] = best_next, link_next
        best[todo[link_next < 0]] = 0
        todo = todo[(link_next >= 0) & (best_next >= floor)]
        todo = todo[place[link[todo]] > place[todo]]
    return np.where(best >= floor, best, 0)


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Capped longest previous factor and longest following factor of the
    suffixes at ``starts`` (each with at least ``length`` bytes): the longest
    prefix, up to ``length``, that also starts at a smaller (larger) one of
    ``starts``; zero below ``length``. The windows are held once, as bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grid = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
    order = np.argsort(grid.view(f"S{length}").ravel(), kind="stable")
    lcp = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), ROWS):
        rows = grid[order[lo - 1:lo + ROWS]]
        same = rows[1:] == rows[:-1]
        lcp[lo:lo + ROWS] = np.where(same.all(axis=1), length, same.argmin(axis=1))
    del grid
    out = []
    place = starts[order]
    for key in (place, -place):
        before = neighbour_match(key, lcp, length)
        after = neighbour_match(key[::-1], np.concatenate([[0], lcp[1:][::-1]]), length)[::-1]
        found = np.empty(len(key), np.int64)
        found[order] = np.maximum(before, after)
        out.append(found)
    return out[0], out[1]


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _slices(batch: pa.RecordBatch, cols: tuple[str, ...]) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """Rows of a batch, about ``SLICE`` bytes of text at a time."""
    for part in sized_batches(iter([batch]), "text", 8 * SLICE):
        body = text_bytes(part.column("text"))
        rest = [part.column(c) for c in cols]
        at = 0
        while at < len(body):
            end, held = at + 1, len(body[at])
            while end < len(body) and held + len(body[end]) <= SLICE:
                held += len(body[end])
                end += 1
            yield body[at:end], [c.slice(at, end - at) for c in rest]
            at = end


PART = 4 << 20


def _super_rows(length: int, gram: int):
    """``(rid, text)`` -> super-windows; a longer text than ``PART`` goes in
    parts that overlap by one window less a byte. Where parts meet, the run of a
    minimizer is cut in two, which changes no result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, (rid,) in _slices(batch, ("rid",)):
                rid = rid.to_numpy()
                parts = [(i, off, b[off:off + PART + length - 1]) for i, b in enumerate(body) for off in range(0, max(1, len(b) - length + 1), PART)]
                for lo in range(0, len(parts), 1 if len(parts) > len(body) else max(1, len(parts))):
                    own = parts[lo:lo + (1 if len(parts) > len(body) else len(parts))]
                    size = np.array([len(p[2]) for p in own])
                    start = np.concatenate([[0], np.cumsum(size)[:-1]])
                    doc, at, n, mh, fh = super_windows(np.frombuffer(b"".join(p[2] for p in own), np.uint8), start, size, length, gram)
                    if len(doc):
                        row, off = np.array([p[0] for p in own]), np.array([p[1] for p in own])
                        yield pa.record_batch([
                            pa.array(mh.view(np.int64)), pa.array(fh.view(np.int64)), pa.array(rid[row[doc]]),
                            pa.array((at - start[doc] + off[doc]) << 16 | n)], ["mh", "fh", "rid", "at"])

    return run


def _cut_strings(length: int):
    """``(rid, text, want)`` -> bytes of the wanted super-windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, (rid, want) in _slices(batch, ("rid", "want")):
                flat = want.flatten()
                of = np.repeat(np.arange(len(body)), np.diff(want.offsets.to_numpy()))
                at = flat.field("at").to_numpy()
                own = [body[i][a >> 16:(a >> 16) + (a & 65535) - 1 + length] for i, a in zip(of.tolist(), at.tolist())]
                yield pa.record_batch([
                    flat.field("mh"), flat.field("fh"), pa.array(rid.to_numpy()[of]), flat.field("at"), pa.array(own, pa.binary())],
                    ["mh", "fh", "rid", "at", "body"])

    return run


def _factor_rows(length: int):
    """Representatives sorted by minimizer and place -> for each that holds
    repeated windows, bit masks of its windows with an earlier and with any
    other occurrence."""
    def of(mh, fh, body) -> pa.RecordBatch:
        size = np.array([len(b) for b in body])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        number = size - length + 1
        starts = ranges(start, number)
        back, on = previous_factors(np.frombuffer(b"".join(body), np.uint8), starts, length)
        early, other = back >= length, (back >= length) | (on >= length)
        edge = np.concatenate([[0], np.cumsum(number)])
        keep = [i for i in range(len(body)) if other[edge[i]:edge[i + 1]].any()]
        return pa.record_batch([
            pa.array(mh[keep]), pa.array(fh[keep]),
            pa.array([_bits(early[edge[i]:edge[i + 1]]) for i in keep], pa.binary()),
            pa.array([_bits(other[edge[i]:edge[i + 1]]) for i in keep], pa.binary())], ["mh", "fh", "early", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mh, fh, body, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            mh = np.concatenate([mh, batch.column("mh").to_numpy()])
            fh = np.concatenate([fh, batch.column("fh").to_numpy()])
            body += batch.column("body").to_pylist()
            while len(body):
                # Whole minimizers, about SLICE bytes; the last one may go on in the next batch.
                sizes = np.cumsum([len(b) for b in body])
                upto = int(np.searchsorted(sizes, SLICE)) + 1
                end = int(np.searchsorted(mh, mh[min(upto, len(mh)) - 1], side="right"))
                if end >= len(mh):
                    break
                yield of(mh[:end], fh[:end], body[:end])
                mh, fh, body = mh[end:], fh[end:], body[end:]
        while len(body):
            sizes = np.cumsum([len(b) for b in body])
            upto = int(np.searchsorted(sizes, SLICE)) + 1
            end = int(np.searchsorted(mh, mh[min(upto, len(mh)) - 1], side="right"))
            yield of(mh[:end], fh[:end], body[:end])
            mh, fh, body = mh[end:], fh[end:], body[end:]

    return run


def _window_rows(length: int):
    """Each window of the representatives with a 128-bit hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column("body").to_pylist()
            for lo in range(0, len(body), 256):
                part = body[lo:lo + 256]
                data = np.frombuffer(b"".join(part), np.uint8)
                size = np.array([len(b) for b in part])
                start = np.concatenate([[0], np.cumsum(size)[:-1]])
                number = size - length + 1
                at, of = ranges(start, number), np.repeat(np.arange(len(part)), number)
                pick = lambda c: pa.array(batch.column(c).to_numpy()[lo:lo + 256][of])
                yield pa.record_batch([
                    pick("mh"), pick("fh"), pick("rid"), pick("at"), pa.array((at - start[of]).astype(np.int32)), pa.array(number[of].astype(np.int32)),
                    *(pa.array(Hashed(data, w).fixed(length)[at].view(np.int64)) for w in (0, 1))],
                    ["mh", "fh", "rid", "at", "off", "number", "w0", "w1"])

    return run


def _mask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(mh, fh, number, early[], other[])`` of offsets -> bit masks."""
    for batch in batches:
        cols = []
        for name in ("early", "other"):
            masks = []
            for n, offs in zip(batch.column("number").to_pylist(), batch.column(name).to_pylist()):
                flags = np.zeros(n, bool)
                flags[offs] = True
                masks.append(_bits(flags))
            cols.append(pa.array(masks, pa.binary()))
        yield pa.record_batch([batch.column("mh"), batch.column("fh"), *cols], ["mh", "fh", "early", "other"])


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges; ranges that overlap or touch become one."""
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > top[:-1]])
    return start[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(top) - 1)]


def _covered(at: np.ndarray, masks: list[bytes | None], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges covered by the flagged windows of super-windows; a missing
    mask stands for all windows."""
    a, b = [], []
    for code, mask in zip(at.tolist(), masks):
        begin, n = code >> 16, code & 65535
        if mask is None:
            a.append(np.array([begin]))
            b.append(np.array([begin + n - 1 + length]))
            continue
        hit = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=n))
        if not len(hit):
            continue
        gap = np.flatnonzero(np.diff(hit) > 1)
        a.append(begin + hit[np.append(0, gap + 1)])
        b.append(begin + hit[np.append(gap, len(hit) - 1)] + length)
    return merge_spans(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _apply(length: int):
    """``(text, marks, rest)`` -> spans removed and the bytes that stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, (rest, marks) in _slices(batch, ("rest", "marks")):
                starts, ends, kept = [], [], []
                for text, own in zip(body, marks.to_pylist()):
                    if not own:
                        starts.append([])
                        ends.append([])
                        kept.append(text)
                        continue
                    a, b = _covered(np.array([m["at"] for m in own]), [m["mask"] for m in own], length)
                    edges = np.concatenate([[0], np.stack([a, b], 1).ravel(), [len(text)]]).tolist()
                    kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])))
                    starts.append(a)
                    ends.append(b)
                longs = pa.list_(pa.int64())
                yield pa.record_batch([rest, pa.array(starts, longs), pa.array(ends, longs), pa.array([len(t) for t in body], pa.int64()), pa.array(kept, pa.binary())],
                                      ["rest", *ADDED])

    return run


def _texts(length: int):
    """``(text, marks, rest)`` -> the text that stays; in the task that cuts it, as
    a second Python step would hold its own copy of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _apply(length)(batches):
            yield pa.record_batch([batch.column("rest"), pa.array([k.decode("utf-8", "ignore") for k in batch.column("kept").to_pylist()], pa.string())], ["rest", "body"])

    return run


def _keyed(rows: DataFrame) -> DataFrame:
    """Turn ``id`` into ``rid``, a unique long in the order of ids. It is the id itself where
    ids are unique; where ids repeat or are null, rows are sorted by id (nulls
    last), numbered, and written once, so that every later step sees the same
    numbers."""
    if rows.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return rows.withColumnRenamed("id", "rid")
    order = F.col("id").asc_nulls_last()
    return cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("rid", F.monotonically_increasing_id()).drop("id"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, mode: str = "first", gram: int = GRAM,
                   bucket_limit: int = BUCKET_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, and ``span_start``, ``span_end``
    (arrays of the maximal byte ranges removed), ``n_bytes`` (before) and
    ``kept`` (the bytes left; a cut may fall inside a character).

    Null texts count as empty; a text shorter than ``length`` bytes keeps all.
    "Earlier" goes by id (nulls last), then place; rows that share an id follow
    each other in the order in which they were numbered. Columns of ``docs`` named like an added one are
    replaced, others left alone; an empty table gives no rows."""
    rest = [c for c in docs.columns if c != text_col and c not in ADDED]
    found = _marked(docs, rest, length, mode, gram, bucket_limit, id_col, text_col)
    done = found.mapInArrow(lean(_apply(length)), typed(found, ["rest"], "span_start array<long>, span_end array<long>, n_bytes long, kept binary"))
    return unpack(done, rest, *ADDED)


def clean_texts(docs: DataFrame, length: int = LENGTH, mode: str = "first", gram: int = GRAM,
                bucket_limit: int = BUCKET_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, the text without what ``remove_repeats`` takes out;
    bytes of a character that a cut has split are left out."""
    rest = [c for c in docs.columns if c != text_col]
    found = _marked(docs, rest, length, mode, gram, bucket_limit, id_col, text_col)
    out = found.mapInArrow(lean(_texts(length)), typed(found, ["rest"], "body string"))
    return unpack(out, rest, F.col("body").alias(text_col)).select(*map(quoted, docs.columns))


def _marked(docs: DataFrame, rest: list[str], length: int, mode: str, gram: int, bucket_limit: int, id_col: str, text_col: str) -> DataFrame:
    """``rest`` (the carried columns), ``text``, and ``marks`` (super-windows with
    repeated windows; null: none)."""
    if mode not in ("first", "all"):
        raise ValueError("mode must be 'first' or 'all'")
    if not 8 <= gram <= length or length > 60000:
        raise ValueError("8 <= gram <= length <= 60000")
    base = _keyed(carry(docs, rest, id=quoted(id_col).cast("long"), text=quoted(text_col).cast("string")))
    body = base.select("rid", "text")

    supers = body.mapInArrow(lean(_super_rows(length, gram)), "mh long, fh long, rid long, at long")
    # Written, so that the join below is between two plain shuffles and a minimizer of very many rows can be split.
    twice = (supers.groupBy("mh").agg(F.count(F.lit(1)).alias("c"), F.min("fh").alias("lo"), F.max("fh").alias("hi"))
             .where("c > 1").select("mh", (F.col("lo") != F.col("hi")).alias("mixed")))
    hits = cut(supers.join(cut(twice).hint("shuffle_hash"), "mh"))
    # One row for each distinct super-window, with its first place.
    kinds = cut(hits.groupBy("mh", "fh").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rid", "at")).alias("first"), F.first("mixed").alias("mixed")))
    reps = kinds.where("mixed").select("mh", "fh", "first.rid", "first.at")
    crowd = reps.groupBy("mh").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_limit).select("mh")
    wanted = reps.groupBy("rid").agg(F.collect_list(F.struct("mh", "fh", "at")).alias("want"))
    strings = body.join(wanted, "rid").mapInArrow(lean(_cut_strings(length)), "mh long, fh long, rid long, at long, body binary")
    masks = "mh long, fh long, early binary, other binary"
    if crowd.isEmpty():
        found = strings
        crowded = None
    else:
        strings = cut(strings)
        found = strings.join(crowd, "mh", "left_anti")
        windows = strings.join(crowd, "mh", "left_semi").mapInArrow(lean(_window_rows(length)), "mh long, fh long, rid long, at long, off int, number int, w0 long, w1 long")
        place = F.struct("rid", (F.shiftright("at", 16) + F.col("off")).alias("p"))
        seen = windows.groupBy("w0", "w1").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("f")).where("c > 1")
        crowded = (windows.join(cut(seen), ["w0", "w1"]).withColumn("early", place != F.col("f")).groupBy("mh", "fh")
                   .agg(F.first("number").alias("number"), F.collect_list(F.when(F.col("early"), F.col("off"))).alias("early"), F.collect_list("off").alias("other"))
                   .mapInArrow(lean(_mask_rows), masks))
    found = (found.repartition("mh").sortWithinPartitions("mh", "rid", "at").select("mh", "fh", "body")
             .mapInArrow(lean(_factor_rows(length)), masks))
    if crowded is not None:
        found = found.union(crowded)
    # Written for the same reason: very many documents may hold one super-window.
    known = cut(kinds.join(cut(found), ["mh", "fh"], "left"))
    # A later copy of a super-window is covered as a whole (no mask); a first copy by its own mask.
    marked = hits.select("mh", "fh", "rid", "at").join(known.select("mh", "fh", "c", "first", "early", "other"), ["mh", "fh"])
    if mode == "all":
        marked = marked.select("rid", "at", F.when(F.col("c") > 1, None).otherwise(F.col("other")).alias("mask"),
                               (F.col("c") > 1).alias("whole"))
    else:
        marked = marked.select("rid", "at", "early", (F.struct("rid", "at") != F.col("first")).alias("whole"))
        marked = marked.select("rid", "at", F.when(F.col("whole"), None).otherwise(F.col("early")).alias("mask"), "whole")
    marks = marked.where("whole or mask is not null").groupBy("rid").agg(F.collect_list(F.struct("at", "mask")).alias("marks"))
    marks = cut(marks)
    return base.join(marks, "rid", "left")


def digest(bodies: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract columns of the query, from the operator's output."""
    for b in bodies:
        size = [len(k) for k in b.column("kept").to_pylist()]
        yield pa.record_batch([
            b.column("doc_id"), b.column("n_bytes"),
            pa.array([n - k for n, k in zip(b.column("n_bytes").to_pylist(), size)], pa.int64()),
            pa.array([len(s) for s in b.column("span_start").to_pylist()], pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in b.column("kept").to_pylist()])],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def kept_texts(done: DataFrame, text_col: str = "text") -> DataFrame:
    """``kept`` as a string column; bytes of a character that a cut has split are left out."""
    @F.pandas_udf("string")
    def decode(kept):
        return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return done.withColumn(text_col, decode("kept")).drop(*ADDED)
