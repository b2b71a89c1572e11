"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond"): every step is a grouped minimum that is handed to the rows of its group.
Neither a component nor the neighbours of one node ever meet in one task, however many they
are: a node's edges are dealt out over many tasks (see with_minimum). The number of rounds grows
with the logarithm of the size. Each round ends in files in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize_counted, spread, with_minimum


#: Edges to a file, of 8 files at least.
EDGES = 100_000


def _written(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, tuple]:
    """The edges as a table, their number and the sum of their hashes; ``most``: how many there can be."""
    if most is not None:
        edges = edges.coalesce(min(spread(edges.sparkSession), 8 + most // EDGES))
    h = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    out, seen = materialize_counted(edges, "edges", n=F.count("*"), h=h)
    return out, (seen["n"], seen["h"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """node, root for every node that has an edge; root is the smallest node of its component.

    Nodes are longs. Loops, repeated edges and edges with a null end mean nothing. An empty
    table gives an empty result.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = _written(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        n = 2 * before[0]  # the most nodes there are, and the most edges that large-star leaves
        both = edges.union(edges.select("b", "a"))
        least = F.least("m", "a")
        large = with_minimum(both, "a", "b", "m", ["b"], n).where("b > a").select(F.col("b").alias("a"), least.alias("b")).where("a <> b").distinct()
        # of the node's smaller neighbours all but the smallest, and the node, go to the smallest
        small = with_minimum(large, "a", "b", "m", ["b"], n)
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        done, after = _written(small.distinct(), n)
        discard(edges, spark)
        edges, same = done, after == before
        before = after
        if same:
            break
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
