"""Connected components of a link table by large-star / small-star rounds.

Every round is a partial-aggregated ``min`` per node and one join on the node,
so a node with very many links is a skewed join that AQE can split, never one
group in one task; none is a broadcast, which would grow with the links in the
driver. Lineage is cut after each round with a reliable
checkpoint, whose old files Spark can clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node onto the node's smallest one."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours onto the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` of longs -> ``(node, component)``: the smallest node
    reachable, for every node that has a link to another node. Null ends and
    self-links are ignored; no links give no rows."""
    cur = cut_lineage(links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())
    state = None
    for _ in range(max_rounds):
        cur = cut_lineage(_small_star(_large_star(cur)))
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
