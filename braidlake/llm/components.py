"""Connected components of a table of links by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm.common import cut, discard


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for the nodes of links that are not the least of their component; component is that least node.

    Alternates large stars (a node's larger neighbours are linked to its least neighbour) and small stars (its smaller
    ones), on which a table of links ends as one star per component, in a number of rounds that grows with the logarithm of the nodes.
    A link to a null or to itself is none. No step gathers a node's neighbours: least neighbours are an aggregate, and rows meet them in a join.
    """
    edges = links.filter(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    edges = cut(edges, "edges")
    sign = _sign(edges)
    while sign[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
        large = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        old, edges = edges, cut(small.filter(F.col("u") != F.col("v")).distinct(), "edges")
        discard(old)
        before, sign = sign, _sign(edges)
        if sign == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
