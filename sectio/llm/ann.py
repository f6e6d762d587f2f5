"""Approximate nearest neighbours with balanced posting lists.

Index. Centroids come from a bounded, hash-drawn sample by hierarchical
k-means: a cluster over the leaf size is split again, so dense regions get more
lists and lists stay balanced. Every vector goes to its nearest list and,
near a boundary, to further lists whose centroid is within ``replicate`` times
the least distance. Centroids form a neighbour graph held in memory (the sample
bounds its size); lists are found by beam search over it, from entries in every
region and with a beam wide enough that nearly all first lists are the nearest. A list longer than
``shard_rows`` is dealt out over several shards; every shard is searched.

Search. A query opens lists in order of distance until the vectors at home there
are several times ``k + 1``, and goes on to ``probe_ratio`` times the distance of
the last of these, to at most ``probes`` lists. Candidates are scored exactly. A
query that still has fewer than ``k`` is compared with all vectors, in blocks.
Equal vectors are indexed once with their smallest ids, so copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectio.llm.common import cut, lean

SAMPLE = 16_384
SPREAD = 8  # centroids for each entry of the graph
BEAM = 64  # centroids held by a search, however few lists are asked for


def split(x: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Cluster number of each row by k-means."""
    centre = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(rounds):
        label = (-2 * x @ centre.T + (centre**2).sum(1)).argmin(1)
        for c in range(parts):
            own = label == c
            if own.any():
                centre[c] = x[own].mean(0)
    return label


def balanced_centroids(x: np.ndarray, leaf: int, branch: int = 8, seed: int = 7) -> np.ndarray:
    """Means of clusters of at most ``leaf`` rows each (more only where rows are equal)."""
    rng, todo, out = np.random.default_rng(seed), [x], []
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own.mean(0))
            continue
        label = split(own, min(branch, -(-len(own) // leaf)), rng)
        if (label == label[0]).all():
            out.append(own.mean(0))
            continue
        todo += [own[label == c] for c in np.unique(label)]
    return np.array(out)


class Graph:
    """Neighbour graph over centroids with batched beam search."""

    def __init__(self, centroids: np.ndarray, degree: int = 24):
        self.x = centroids
        n = len(centroids)
        self.degree = min(degree, n - 1)
        d = ((centroids**2).sum(1)[:, None] - 2 * centroids @ centroids.T + (centroids**2).sum(1)[None, :]) if n > 1 else np.zeros((1, 1))
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, :self.degree]
        # A ring keeps the graph in one piece.
        ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], 1)
        self.near = np.concatenate([near, ring], 1)
        # Centroids of one region follow each other: evenly spread entries reach all regions.
        self.entry = np.unique(np.linspace(0, n - 1, min(n, max(16, n // SPREAD))).astype(int))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best centroids found for each row, nearest first, and distances."""
        n, rows = len(self.x), len(q)
        beam = min(beam, n)
        seen = np.zeros((rows, n), bool)
        dist = np.full((rows, n), np.inf)
        q2, x2 = (q**2).sum(1), (self.x**2).sum(1)

        def visit(r, c):
            dist[r, c] = np.maximum(q2[r] + x2[c] - 2 * (q[r] * self.x[c]).sum(1), 0)
            seen[r, c] = True

        r = np.repeat(np.arange(rows), len(self.entry))
        visit(r, np.tile(self.entry, rows))
        opened = np.zeros((rows, n), bool)
        while True:
            best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
            rr = np.arange(rows)[:, None]
            new = ~opened[rr, best] & np.isfinite(dist[rr, best])
            r, k = np.nonzero(new)
            if not len(r):
                break
            c = best[r, k]
            opened[r, c] = True
            r2, c2 = np.repeat(r, self.near.shape[1]), self.near[c].ravel()
            fresh = ~seen[r2, c2]
            pair = np.unique(r2[fresh] * n + c2[fresh])
            if len(pair):
                visit(pair // n, pair % n)
        best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        return best, np.sqrt(np.take_along_axis(dist, best, 1))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def _lists(shared, ratio: float, most: int, sizes: np.ndarray | None = None, need: int = 0):
    """``(id, embedding, ...)`` -> the same rows, once for each list they take, and
    whether it is the nearest. The ratio is to the distance at which the lists
    hold ``need`` vectors by ``sizes``, without sizes to the least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found, d = graph.search(_matrix(batch.column("embedding")), max(most, BEAM))
                found, d = found[:, :most], d[:, :most]
                reach = d[:, :1]
                if sizes is not None:
                    held = sizes[found].cumsum(1)
                    at_need = np.where(held[:, -1] >= need, (held >= need).argmax(1), held.shape[1] - 1)
                    reach = np.take_along_axis(d, at_need[:, None], 1)
                rows, k = np.nonzero(d <= np.maximum(reach * ratio, 1e-12))
                yield pa.record_batch([pa.array(found[rows, k].astype(np.int32)), pa.array(k == 0), *(c.take(pa.array(rows)) for c in batch.columns)],
                                      ["list", "home", *batch.schema.names])

    return run


def _score(k: int, others: bool = False):
    """Nearest ``k`` members of one shard for each query that comes to it; with
    ``others``, members that hold no id but the query's are passed over."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "vid": [], "ids": [], "score": []}).astype({"query": "int64", "vid": "int64", "ids": "object", "score": "float64"})
        x = np.stack(left.embedding.to_numpy()).astype(float)
        out, x2 = [], (x**2).sum(1)
        alone = np.array([i[0] if len(i) == 1 else None for i in left.ids], object) if others else None
        for lo in range(0, len(right), 256):
            part = right.iloc[lo:lo + 256]
            q = np.stack(part.embedding.to_numpy()).astype(float)
            rough = x2[None, :] - 2 * q @ x.T
            if others:
                rough[part["query"].to_numpy()[:, None] == alone[None, :]] = np.inf
            kth = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            r, c = np.nonzero(np.isfinite(rough) & (rough <= (kth + 1e-9 * (1 + np.abs(kth)))[:, None]))
            out.append(pd.DataFrame({"query": part["query"].to_numpy()[r], "vid": left.vid.to_numpy()[c], "ids": left.ids.to_numpy()[c],
                                     "score": np.sqrt(((q[r] - x[c])**2).sum(1))}))
        return pd.concat(out)

    return run


def valid(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components, not all zero, and the most
    common length (the greater on ties)."""
    ok = vectors.where(F.col(col).isNotNull() & (F.size(col) > 0)).where(
        F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(col, lambda v: v != 0))
    size = ok.groupBy(F.size(col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return ok.where(F.size(col) == (size.n if size else 0))


def _all_pairs(base: DataFrame, asked: DataFrame, n_asked: int, k: int, shard_rows: int) -> DataFrame:
    """``(query_id, found)``: the ``k`` nearest of all vectors for each id asked."""
    shards, blocks = -(-base.count() // shard_rows), -(-n_asked // shard_rows)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    members = base.select(each(blocks).alias("block"), F.pmod(F.xxhash64("vid"), F.lit(shards)).cast("int").alias("shard"), "vid", "ids", "embedding")
    queries = asked.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), each(shards).alias("shard"), F.col("id").alias("query"), "embedding")
    scored = (members.groupBy("block", "shard").cogroup(queries.groupBy("block", "shard"))
              .applyInPandas(_score(k, others=True), "query long, vid long, ids array<long>, score double"))
    best = scored.groupBy("query", "vid").agg(F.min("score").alias("score"), F.first("ids").alias("ids"))
    flat = best.select("query", "score", F.explode("ids").alias("id")).where("id != query")
    return (flat.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))).where(F.col("r") <= k)
            .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("found")).withColumnRenamed("query", "query_id"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", col: str = "embedding", sample: int = SAMPLE, leaf: int = 24,
           replicate: float = 1.06, copies: int = 4, probe_ratio: float = 1.3, probes: int = 192, shard_rows: int = 8192) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each
    row of ``queries``, by Euclidean distance in double precision, ties to the
    smaller id; a query's own id is no candidate.

    Vectors that are null, zero, of another length, or hold null or non-finite
    components take no part, as do rows with a null id. Equal vectors are all
    candidates. Only a query with fewer than ``k`` candidates in the whole table
    has fewer rows; empty tables give none. The centroids are fitted on ``sample``
    vectors; every vector is indexed."""
    spark = vectors.sparkSession
    pick = lambda df: valid(df.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("embedding")).where("id is not null"))
    rows = pick(vectors)
    order = Window.partitionBy("embedding").orderBy("id")
    base = cut(rows.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
               .groupBy("embedding").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("vid", F.col("ids")[0]))
    drawn = base.select("embedding").orderBy(F.xxhash64("vid"), "vid").limit(sample).toPandas()
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(drawn):
        return spark.createDataFrame([], schema)
    graph = spark.sparkContext.broadcast(Graph(balanced_centroids(np.stack(drawn.embedding.to_numpy()).astype(float), leaf)))

    asked = pick(queries)
    names = asked.groupBy("embedding").agg(F.min("id").alias("query"))
    who = asked.join(names, "embedding").select(F.col("id").alias("query_id"), "query").distinct()
    posted = cut(base.select("vid", "ids", "embedding").mapInArrow(lean(_lists(graph, replicate, copies)), "list int, home boolean, vid long, ids array<long>, embedding array<double>"))
    # One row a list: bounded by the sample.
    counts = posted.groupBy("list").agg(F.count("*").alias("n"), F.count_if("home").alias("home")).collect()
    sizes = [(r["list"], -(-r["n"] // shard_rows)) for r in counts]
    home = np.zeros(len(graph.value.x), np.int64)
    home[[r["list"] for r in counts]] = [r["home"] for r in counts]
    wide = names.select("query", "embedding").mapInArrow(lean(_lists(graph, probe_ratio, probes, home, 8 * (k + 1))), "list int, home boolean, query long, embedding array<double>")
    of = lambda: F.broadcast(spark.createDataFrame(sizes, "list int, shards int"))
    posted = posted.join(of(), "list").select("list", F.pmod(F.xxhash64("vid"), F.col("shards")).cast("int").alias("shard"), "vid", "ids", "embedding")
    wide = wide.join(of(), "list").select("list", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), "query", "embedding")
    scored = (posted.groupBy("list", "shard").cogroup(wide.groupBy("list", "shard"))
              .applyInPandas(_score(k + 1), "query long, vid long, ids array<long>, score double"))
    # A vector found in several lists counts once; then the best k + 1 ids.
    best = scored.groupBy("query", "vid").agg(F.min("score").alias("score"), F.first("ids").alias("ids"))
    flat = best.select("query", "score", F.explode("ids").alias("id"))
    top = (flat.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))).where(F.col("r") <= k + 1)
           .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("found")))
    own = cut(who.join(top, "query", "left")
              .select("query_id", F.slice(F.filter(F.coalesce("found", F.array().cast(top.schema["found"].dataType)), lambda f: f["id"] != F.col("query_id")), 1, k).alias("found")))
    short = own.where(F.size("found") < k).select("query_id").distinct()
    n_short = short.count()
    if n_short:
        own = own.join(short, "query_id", "left_anti").unionByName(_all_pairs(base, asked.join(short.withColumnRenamed("query_id", "id"), "id", "left_semi"), n_short, k, shard_rows))
    return (own.select("query_id", F.posexplode("found").alias("p", "f"))
            .select("query_id", (F.col("p") + 1).alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score")))
