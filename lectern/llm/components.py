"""Connected components by alternating star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..runtime import Stored


def _state(edges: DataFrame) -> tuple[int, int, int, int]:
    """Number of edges, a checksum of them, and the largest numbers of edges at a low and at a high end."""
    ends = edges.select(
        F.xxhash64("hi", "lo").cast("decimal(38,0)").alias("h"), F.posexplode(F.array("lo", "hi")).alias("side", "node")
    )
    by = ends.groupBy("side", "node").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    low = F.col("side") == 0
    r = by.agg(F.sum(F.when(low, F.col("n"))), F.sum(F.when(low, F.col("h"))), F.max(F.when(low, F.col("n"))), F.max(F.when(~low, F.col("n")))).first()
    return tuple(int(x or 0) for x in r)


def _large_star(edges: DataFrame, total: int, hottest: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour, or to the node if it is the least."""
    least = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
    degree = edges.groupBy(F.col("lo").alias("node")).agg(F.count("*").alias("n"))
    dim = least.join(degree, "node")  # nodes without a smaller neighbour keep their edges as they are
    moved = lookup(edges.withColumnRenamed("lo", "node"), dim, "node", "n", total, hottest, "left")
    return moved.select("hi", F.coalesce("least", "node").alias("lo"))


def _small_star(edges: DataFrame, total: int, hottest: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them.

    A large star leaves a node at most as many smaller neighbours as it had before, ``hottest`` at most.
    """
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"), F.count("*").alias("n"))
    tied = lookup(edges, least.where("n > 1"), "hi", "n", total, hottest).where("lo <> least")
    return tied.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).unionByName(
        least.select("hi", F.col("least").alias("lo"))
    )


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``pairs`` that is linked to another; ``component`` is the least node.

    Large-star and small-star rewrites alternate until the edges no longer change, which takes a number of rounds that
    grows with the logarithm of the longest chain; each state is written to the shared folder. Pairs with a null end, loops and repeated pairs say nothing and are left out. No pairs, no rows.
    """
    start = (
        pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where("_a <> _b")
        .select("hi", "lo")
        .distinct()
    )
    now = Stored(start, "edges")
    state = _state(now.df)
    while state[0]:
        star = _large_star(now.df, state[0], state[2]).distinct()
        nxt = Stored(_small_star(star, state[0], state[3]).distinct(), "edges")
        before, state = state, _state(nxt.df)
        now.drop()
        now = nxt
        if before[:2] == state[:2]:
            break
    e = now.df
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
