"""Merkle dataset manifest: a tree of digests per group of rows, a tree over the
groups, and membership proofs of all rows by octopus multiproofs.

A leaf is a digest of a row's columns. In a group leaves ascend by id; while
more than one node is left, every ``fan`` consecutive ones become the digest of
their digests. The roots of the groups, in the order of the groups, are the
leaves of the top tree.

Plan.

1. Leaves are digested where the rows are read and written once. They are sorted
   by range; a row's place in its group is its place in its partition's run plus
   the lengths of the group's runs before (a few rows a partition), so a group
   of any size is numbered without one task seeing it.
2. Each level is one aggregate by (tree, place / fan), at most ``fan`` digests a
   row, on 1 / ``fan`` of the rows of the level below.
3. Proofs. A leaf partition is a run of up to ``PART`` sorted leaves. From the
   places of its leaves alone it computes the minimal union of node coordinates
   that its proofs need and that its leaves don't give (``missing``: siblings
   outside, level by level, of nodes it can derive). All partitions' coordinates
   are fetched by one join with the node table.
4. Each partition then derives the shared inner nodes once, expands every leaf's
   own proof and folds claimed leaves up to the root (``Octopus``). Only leaf
   rows, headers of a partition and the fetched nodes are shuffled, no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectio.llm.common import cut, lean, typed

FAN = 16
PART_BITS = 12  # up to 4096 leaves in a leaf partition
TOP = ""


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 (lower-case hex) over the columns: ``-`` for null, else the number
    of UTF-8 bytes, a colon and the value as text."""
    parts = []
    for c in columns:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``mid`` (a unique number in sorted order) and ``pos`` (place
    in the group, from 0), and ``(group, size)``. Sorted by range and written; the
    offset of a group's run in a partition comes from the counts of its runs."""
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    held = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id()))
    held = held.withColumn("part", F.shiftright("mid", 33))
    runs = held.groupBy("part", group).agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))))
    placed = held.join(runs.select("part", group, "first", "offset"), ["part", group])
    return (placed.select(*rows.columns, "mid", (F.col("mid") - F.col("first") + F.col("offset")).alias("pos")),
            runs.groupBy(group).agg(F.sum("n").alias("size")))


def raise_trees(leaves: DataFrame, largest: int, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """``leaves(tree, idx, digest)`` -> the nodes of every level above, and
    ``(tree, digest)`` of the single node left of each tree."""
    levels, tops, nodes, n = [], None, leaves, largest
    while True:
        kids = F.sort_array(F.collect_list(F.struct("idx", "digest"))).getField("digest")
        grown = cut(nodes.groupBy("tree", F.floor(F.col("idx") / fan).cast("long").alias("up")).agg(kids.alias("kids"))
                    .select("tree", "up", F.size("kids").alias("n"), F.col("kids")[0].alias("only"), F.sha2(F.array_join("kids", ""), 256).alias("digest")))
        alone = (F.col("up") == 0) & (F.col("n") == 1)  # the tree has one node on the level below
        done = grown.where(alone).select("tree", F.col("only").alias("digest"))
        tops = done if tops is None else tops.union(done)
        if n <= 1:
            return levels, tops
        nodes = grown.where(~alone).select("tree", F.col("up").alias("idx"), "digest")
        levels.append(nodes)
        n = -(-n // fan)


@dataclass
class Manifest:
    """``leaves(id, tree, pos, mid, leaf, claim, rank, ...)``, ``nodes(tree,
    level, idx, digest)`` of all trees, ``groups(tree, size, rank, digest)`` and
    ``top(root, groups)``, one row if there are leaves. Trees of groups are named
    by ``0`` (null) or ``1`` and the group; the top tree has the empty name."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    top: DataFrame
    fan: int


def build(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", claim: Column | None = None, fan: int = FAN) -> Manifest:
    """The trees over the rows of ``docs``, leaves from ``columns`` in their
    order. ``claim`` is a leaf digest to be checked in a row's stead (null: the
    row's own).

    Ids ascend with nulls first, groups likewise, by bytes. Rows that share an
    id follow each other by leaf; equal rows are leaves of their own. Other
    columns are ignored. An empty table has no nodes and no root."""
    if fan < 2:
        raise ValueError("fan must be at least 2")
    group = F.col(group_col).cast("string")
    rows = cut(docs.select(F.col(id_col).alias("id"), F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group)).alias("tree"),
                           leaf_digest([F.col(c) for c in columns]).alias("leaf"), (F.lit(None) if claim is None else claim).cast("string").alias("claim"),
                           F.monotonically_increasing_id().alias("tie")))
    placed, sizes = numbered(rows, "tree", ["id", "leaf", "tie"])
    placed = cut(placed.drop("tie"))
    sizes = cut(sizes.select(F.lit(TOP).alias("top"), "tree", "size"))
    ranked, _ = numbered(sizes, "top", ["tree"])
    ranked = ranked.select("tree", "size", F.col("pos").alias("rank"))
    most = sizes.agg(F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count(F.lit(1)).alias("groups")).first()
    own, subroots = raise_trees(placed.select("tree", F.col("pos").alias("idx"), F.col("leaf").alias("digest")), most.largest, fan)
    groups = cut(ranked.join(subroots, "tree"))
    upper = groups.select(F.lit(TOP).alias("tree"), F.col("rank").alias("idx"), "digest")
    above, root = raise_trees(upper, most.groups, fan)
    nodes = None
    for base, levels in ((placed.select("tree", F.col("pos").alias("idx"), F.col("leaf").alias("digest")), own), (upper, above)):
        for level, df in enumerate([base, *levels]):
            df = df.select("tree", F.lit(level).alias("level"), "idx", "digest")
            nodes = df if nodes is None else nodes.union(df)
    return Manifest(placed, nodes, groups, root.select(F.col("digest").alias("root"), F.lit(most.groups).cast("long").alias("groups")), fan)


def missing(known: np.ndarray, size: int, fan: int) -> list[tuple[int, np.ndarray]]:
    """Octopus: the coordinates ``(level, places)`` that the leaves at ``known``
    need for their proofs in a tree of ``size`` leaves, beyond what they and the
    nodes derived from them give."""
    out, level = [], 0
    known = np.unique(known)
    while size > 1:
        up = np.unique(known // fan)
        kids = (up[:, None] * fan + np.arange(fan)).ravel()
        out.append((level, np.setdiff1d(kids[kids < size], known, assume_unique=True)))
        known, size, level = up, -(-size // fan), level + 1
    return out


class Octopus:
    """Nodes of one tree that a leaf partition knows or derives: its own leaves
    and the fetched ones. ``runs[level][parent]`` are the digests under it."""

    def __init__(self, size: int, fan: int, leaves: dict[int, str], fetched: dict[int, dict[int, str]]):
        self.fan, self.runs = fan, []
        level = leaves
        while size > 1:
            level = level | fetched.get(len(self.runs), {})
            runs: dict[int, list[str]] = {}
            for i in sorted(level):
                runs.setdefault(i // fan, []).append(level[i])
            self.runs.append(runs)
            level = {p: digest("".join(kids)) for p, kids in runs.items()}
            size = -(-size // fan)
        self.root = level[0]

    def siblings(self, place: int) -> list[str]:
        """The proof of a leaf: on each level the others of its run, in order."""
        out = []
        for runs in self.runs:
            place, at = divmod(place, self.fan)
            out += runs[place][:at] + runs[place][at + 1:]
        return out

    def fold(self, place: int, leaf: str) -> str:
        """The root that follows from ``leaf`` at ``place`` and its siblings."""
        for runs in self.runs:
            place, at = divmod(place, self.fan)
            leaf = digest("".join([*runs[place][:at], leaf, *runs[place][at + 1:]]))
        return leaf


def _requests(fan: int):
    """One row per leaf partition (its groups and the places of its leaves) ->
    the coordinates it has to fetch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, head, groups in zip(batch.column("block").to_pylist(), batch.column("head").to_pylist(), batch.column("groups").to_pylist()):
                wanted = [(h["tree"], level, need) for h in head for level, need in missing(np.array(h["places"]), h["size"], fan)]
                wanted += [(TOP, level, need) for level, need in missing(np.array([h["rank"] for h in head]), groups, fan)]
                number = [len(need) for _, _, need in wanted]
                if sum(number):
                    yield pa.record_batch([
                        pa.array([part] * sum(number)), pa.array([t for (t, _, _), n in zip(wanted, number) for _ in range(n)], pa.string()),
                        pa.array(np.repeat([v for _, v, _ in wanted], number).astype(np.int32)), pa.array(np.concatenate([need for _, _, need in wanted]).astype(np.int64))],
                        ["block", "tree", "level", "idx"])

    return run


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches -> the rows of each block as a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]).tolist() if len(block) else [0]
        for a, b in zip(edges, edges[1:]):
            if held and held[0].column("block")[0].as_py() != block[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _expand(fan: int, keep: bool):
    """Header, then leaves of each partition -> every leaf's proof."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_block(batches):
            head = {k: table.column(k)[0].as_py() for k in ("head", "groups", "fetched")}
            rows = table.slice(1).combine_chunks()
            tree, pos, leaf, claim = (rows.column(c).to_pylist() for c in ("tree", "pos", "leaf", "claim"))
            own: dict[str, dict[int, str]] = {}
            for t, p, x in zip(tree, pos, leaf):
                own.setdefault(t, {})[p] = x
            fetched: dict[str, dict[int, dict[int, str]]] = {}
            for f in head["fetched"] or ():
                fetched.setdefault(f["tree"], {}).setdefault(f["level"], {})[f["idx"]] = f["digest"]
            rank = {h["tree"]: h["rank"] for h in head["head"]}
            trees = {h["tree"]: Octopus(h["size"], fan, own[h["tree"]], fetched.get(h["tree"], {})) for h in head["head"]}
            top = Octopus(head["groups"], fan, {rank[t]: o.root for t, o in trees.items()}, fetched.get(TOP, {}))
            above = {t: top.siblings(r) for t, r in rank.items()}
            proofs = [trees[t].siblings(p) + above[t] for t, p in zip(tree, pos)]
            cols = [rows.column("id").combine_chunks() if rows.num_rows else None, pa.array(leaf, pa.string()), pa.array([trees[t].root for t in tree], pa.string()),
                    pa.array([digest("".join(x)) for x in proofs], pa.string()),
                    pa.array([top.root if c is None else top.fold(rank[t], trees[t].fold(p, c)) for t, p, c in zip(tree, pos, claim)], pa.string())]
            names = ["id", "leaf", "subroot", "proof_sha256", "folded_root"]
            if keep:
                cols.append(pa.array(proofs, pa.list_(pa.string())))
                names.append("proof")
            yield pa.record_batch(cols, names)

    return run


def prove(manifest: Manifest, chosen: DataFrame | None = None, proofs: bool = False) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of all
    leaves, or of the rows ``chosen`` of ``manifest.leaves``; with ``proofs`` also
    the siblings themselves. ``folded_root`` follows from the claimed leaf (else
    its own) and the siblings, ``verified`` says whether it is the root."""
    leaves = (manifest.leaves if chosen is None else chosen).withColumn("block", F.shiftright("mid", PART_BITS))
    places = leaves.groupBy("block", "tree").agg(F.collect_list("pos").alias("places"))
    header = (places.join(manifest.groups.select("tree", "size", "rank"), "tree")
              .groupBy("block").agg(F.collect_list(F.struct("tree", "rank", "size", "places")).alias("head"))
              .withColumn("groups", manifest.top.select("groups").scalar()))
    header = cut(header)
    wanted = header.mapInArrow(lean(_requests(manifest.fan)), "block long, tree string, level int, idx long")
    fetched = wanted.join(manifest.nodes, ["tree", "level", "idx"]).groupBy("block").agg(F.collect_list(F.struct("tree", "level", "idx", "digest")).alias("fetched"))
    slim = F.transform("head", lambda h: F.struct(h["tree"].alias("tree"), h["rank"].alias("rank"), h["size"].alias("size"))).alias("head")
    first = header.select("block", slim, "groups").join(fetched, "block", "left").withColumn("mid", F.lit(-1).cast("long"))
    rows = first.unionByName(leaves.select("block", "mid", "id", "tree", "pos", "leaf", "claim"), allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block", "mid")
    out = rows.mapInArrow(lean(_expand(manifest.fan, proofs)), typed(rows, ["id"], "leaf string, subroot string, proof_sha256 string, folded_root string" + ", proof array<string>" * proofs))
    out = out.withColumn("root", manifest.top.select("root").scalar())
    return out.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *["proof"] * proofs)
