"""Connected components by alternating stars, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b.

    Large: every node links its larger neighbours to the least of its
    neighbours and itself.  Small: every node links its smaller neighbours and
    itself to the least of them.  The least neighbour is combined before the
    shuffle and the join back can be split, so a hub is no single task.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # Neighbours larger than u: the edges (v, u).
        out = edges.join(least, edges["b"] == least["u"]).select(F.col("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        out = (edges.join(least, edges["a"] == least["u"])
               .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge list; component is the least node reached.

    Loops, nulls and repeated edges are allowed.  Rounds go on until every edge
    leads to its component's least node, which takes about log(n) of them
    whatever the diameter; each round is written to the checkpoint folder.
    """
    pairs = edges.select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")).where(
        "x is not null and y is not null and x != y")
    x, y = F.col("x"), F.col("y")
    now = cut_lineage(pairs.select(F.when(x > y, x).otherwise(y).alias("a"),
                                   F.when(x > y, y).otherwise(x).alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                            F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    before = state(now)
    while before[0]:
        now = cut_lineage(_star(_star(now, large=True), large=False))
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("component")).distinct()
