"""Connected components of a large, sparse graph as repeated DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.session import cut


_OTHER = 0x5DEECE66D


def apart(key: str, name: str = "k") -> Column:
    """A long key in other words: a join on it shuffles both sides by themselves, also where one was aggregated by the key, and only then does Spark split a hot key. The same turns it back."""
    return F.col(key).bitwiseXOR(F.lit(_OTHER)).alias(name)


def components(edges: DataFrame, a: str = "a", b: str = "b", parts: int = 64) -> DataFrame:
    """A row (node, component) for each node of an edge; component is the smallest node reachable.

    Alternates two steps until nothing moves: each node's larger neighbours are linked to its
    smallest neighbour, then its smaller ones are. Both keep what is connected connected, never
    gather a node's neighbours, and end with a star around each smallest node after about as many
    rounds as the logarithm of the longest path. Edges are cut to the checkpoint folder each round,
    in `parts` parts at most, as many as their number calls for.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = cut(edges, parts)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts)
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), parts)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        new = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = cut(new, parts)
        # nothing moved: as many edges, and the same sum of their hashes
        state = [e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for e in (edges, new)]
        edges = new
        if state[0] == state[1]:
            break
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(edges.select("v", F.col("v").alias("component")).distinct()).coalesce(parts)
