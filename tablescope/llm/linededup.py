"""Line de-duplication with DataFrame operations only.

Hashes of long lines are range-partitioned with document and position as
secondary sort keys, and streamed in that order, largest document first: the
first occurrence of a key found in enough documents stays.  Keys that go on
over a range's border, at most two per range, are counted over all ranges.
What comes back per document is a compressed keep bitmap, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, stored


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def _word_of(dropped: Column) -> Column:
    """Sparse bitmap: for each 64-line word with a dropped line, its keep bits."""
    slots = F.array_distinct(F.transform(dropped, lambda p: F.shiftright(p, 6)))

    def keep_bits(s: Column) -> Column:
        return F.aggregate(
            F.filter(dropped, lambda p: F.shiftright(p, 6) == s), F.lit(-1).cast("long"),
            lambda acc, p: acc.bitwiseAND(F.bitwise_not(
                F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64))))))

    return F.map_from_arrays(slots, F.transform(slots, keep_bits))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bit is set; a word missing from the map keeps all its lines."""
    return F.filter(lines, lambda _, i: F.coalesce(
        F.call_function("getbit", F.try_element_at(keep, F.shiftright(i, 6)), F.pmod(i, F.lit(64))),
        F.lit(1)) == 1)


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, text_key, keep): one row per document that loses lines.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents loses all its lines except in the largest id holding it.
    ``keep`` maps the number of a 64-line word to its keep bits; words that
    keep every line are left out.  ``text_key`` tells apart rows that share an
    id (equal rows share one bitmap).

    Null and empty texts are one empty line and lose nothing; rows with a null
    id neither count nor lose lines.  Repeated rows of one id are one document.
    Texts are split whole, however long; an empty table gives no rows, and other
    columns of ``docs`` are not read, whatever their names.
    Keys are told apart by 128 hash bits.
    """
    seeded = lambda c, s: F.xxhash64(F.lit(s), c)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(
        F.col("id").isNotNull() & (F.length("text") >= min_chars))
    keyed = (rows.select("id", F.xxhash64("text").alias("text_key"), F.posexplode(text_lines(F.col("text"))))
             .where(F.length("col") >= min_chars)
             .withColumn("col", line_key(F.col("col"))).where(F.length("col") >= min_chars)
             .select(seeded(F.col("col"), 1).alias("h1"), seeded(F.col("col"), 2).alias("h2"),
                     "id", "text_key", F.col("pos").alias("pos")))
    # Hashes are written before they are ranged: the sampling of the ranges reads them, not texts.
    # Ranges are cut by key, document and position, so a line that fills the corpus spans many.
    keyed = stored(keyed, "line-hashes")
    order = [F.col("h1"), F.col("h2"), F.col("id").desc(), F.col("pos")]
    ranged = stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("part", F.spark_partition_id()), "lines")
    # One stream per range and key, largest document first: the first occurrence stays.
    run = Window.partitionBy("part", "h1", "h2")
    stream = run.orderBy(F.col("id").desc())
    seen = (ranged.withColumn("_nth", F.dense_rank().over(stream))
            .withColumn("_owner", F.first("id").over(stream))
            .withColumn("_docs", F.max("_nth").over(run)))
    # Only the first and the last key of a range can go on in another: at most two rows a range.
    key = F.struct("h1", "h2")
    ends = ranged.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).select(
        "part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("k"))
    crossing = ends.groupBy("k.h1", "k.h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    whole = stored(ranged.join(F.broadcast(crossing), ["h1", "h2"]).groupBy("h1", "h2", "id").agg(F.lit(1))
                   .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_all_docs"), F.max("id").alias("_all_owner")),
                   "border-lines")
    lost = seen.join(F.broadcast(whole), ["h1", "h2"], "left").where(
        (F.coalesce("_all_docs", "_docs") >= min_docs) & (F.col("id") != F.coalesce("_all_owner", "_owner")))
    return (lost.groupBy("id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("_lost"))
            .select("id", "text_key", _word_of(F.col("_lost")).alias("keep")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, lines, keep, kept): every document with its lines and what stays of them."""
    bitmaps = line_keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    joined = rows.withColumn("text_key", F.xxhash64("text")).join(bitmaps, ["id", "text_key"], "left")
    lines = text_lines(F.col("text"))
    kept = F.when(F.col("keep").isNull(), lines).otherwise(kept_lines(lines, F.col("keep")))
    return joined.select("id", lines.alias("lines"), "keep", kept.alias("kept"))
