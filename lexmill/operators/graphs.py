"""Connected components of graphs of any size, over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.sources.scratch import cut, drop_table

#: From this many edges on, what a round's edges are joined to is a table of its own.
EDGES_IN_ONE_TASK = 1_000_000


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds over tables in the shared folder. Every round
    maps edges to edges, so no group is gathered: the neighbours of a hub meet only in a minimum,
    which is partly computed before the shuffle, and in a join. Where there are edges enough to fill a task, the minima are
    written first, so that both sides of the join are plain shuffles and AQE may split the hub's.
    """
    pair = lambda u, v: [u.cast("long").alias("u"), v.cast("long").alias("v")]
    stars = cut(edges.where("a <> b").select(*pair(F.greatest("a", "b"), F.least("a", "b"))).distinct(), f"{name}-0")
    count = lambda: tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    mark = count()
    for i in range(1, max_rounds + 1):
        settled = (lambda df, k: cut(df, f"{name}-{k}-{i}")) if mark[0] >= EDGES_IN_ONE_TASK else (lambda df, k: df)
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        large = settled(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "between")
        # small star: u and its smaller neighbours go to the smallest of them
        least = settled(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = cut(small.select("e.u", "e.v").where("u <> v").distinct(), f"{name}-{i}")
        drop_table(stars)
        stars, before = new, mark
        mark = count()
        if mark == before:
            roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
