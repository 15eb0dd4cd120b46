"""Mixing sources to target weights.

Documents get hash-random keys and are range-sorted within their source;
distributed prefix sums of their sizes cut each source at its exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0),
                   share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row per source.

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` times all sizes.  A target stops at ``max_epochs`` times its
    source's size and the excess is reshared by weight: with sources ordered by
    how soon they reach their cap, the capped ones are a prefix, and the rest
    share what the prefix leaves.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_cap = Window.orderBy("_level", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = (per.withColumn("_w", w).withColumn("_cap", cap)
           .withColumn("_level", F.col("_cap") / F.col("_w"))
           .withColumn("_all", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
           .withColumn("_rest", F.greatest(F.lit(0.0), F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))))
           .withColumn("_rate", F.col("_rest") / F.sum("_w").over(from_here)))
    # The first source whose cap lies above its share fixes the rate of all after it.
    free = F.min(F.when(F.col("_level") >= F.col("_rate"), F.struct("_level", "source", "_rate"))
                 ).over(Window.partitionBy())
    return per.withColumn("_free", free["_rate"]).select(
        "source", "source_size",
        F.least("_cap", F.coalesce(F.col("_free") * F.col("_w"), F.col("_cap"))).alias("target"))


def mix_sources(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source",
                weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
                max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """(id, source, size, source_size, target, before, taken) for every row of ``docs``.

    ``before`` is the number of units before the row in its source's random
    order and ``taken`` what the mix takes from it: one row size for every
    whole epoch the target holds, and of the last epoch what lies before the
    cut.  The row at the cut gives a part, so each source's sum is its target
    rounded down.

    The order is by md5 of seed and id, then id and size, so reruns agree.
    Repeated rows take part one by one; rows that tie in id and size are alike,
    so it does not matter which comes first.  Null ids hash as the empty text,
    the null source is a source of its own, sizes of null count as 0.  An
    empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    ranged = (rows.withColumn("key", key)
              .repartitionByRange("source", "key", "id", "size")
              .sortWithinPartitions("source", "key", "id", "size"))
    # Written once: every row keeps the number of its range, also after a lost task.
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "mix")
    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("_size"))
    offsets = parts.select(
        "source", "part",
        F.coalesce(F.sum("_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    targets = source_targets(parts.select("source", F.col("_size").alias("size")), weights, share, max_epochs)
    bounds = (offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
              .select("o.source", "part", "_offset", "source_size", "target"))
    inside = Window.partitionBy("part", "source").orderBy("key", "id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    local = ranged.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.alias("l").join(
        bounds.alias("b"), (F.col("l.part") == F.col("b.part")) & F.col("l.source").eqNullSafe(F.col("b.source"))
    ).select("id", "l.source", "size", "source_size", "target",
             (F.col("_before") + F.col("_offset")).alias("before"))
    cut = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(cut / F.col("source_size"))).otherwise(0).cast("long")
    rest = cut - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return joined.withColumn("taken", (epochs * F.col("size") + last).cast("long"))
