"""Importance resampling of documents towards a target distribution.

Hashed word features of the documents and of target texts are counted; each
hash bucket has a gain, the log ratio of its shares, and a document's weight is
the sum of its features' gains, looked up in one array.  A draw without
replacement takes the documents with the highest weight plus Gumbel noise: the
last drawn key is found by distributed quickselect, and only the winners are
sorted and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: ASCII bytes that are no digit or letter part words; A-Z are lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """Bucket of each feature met lately; at most ``most`` are remembered."""

    def __init__(self, buckets: int, most: int = 100_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def feature_buckets(rows: DataFrame, buckets: int, longest: int) -> DataFrame:
    """``rows`` of (id, text, row) as (id, row, n_words, buckets): one bucket per feature, repeats kept."""
    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(buckets)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                n_words, sizes, found = [], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    words = (text or b"").translate(WORD_BYTES).split()
                    at = len(found)
                    found += [bucket[w] for w in words]
                    for n in range(2, longest + 1):
                        found += [bucket[b" ".join(words[i:i + n])] for i in range(len(words) - n + 1)]
                    n_words.append(len(words))
                    sizes.append(len(found) - at)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(n_words, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(found, pa.int32()))],
                    names=["id", "row", "n_words", "buckets"])

    return rows.mapInArrow(featurize, "id long, row long, n_words long, buckets array<int>")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket, over all rows; each task sends at most one row per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in features.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * ln) of each bucket's share in the target over its share in the corpus, both with one added."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(scale * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighted(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, row, n_words, n_features, weight) of each row: the gains of its buckets, added up."""
    shared = features.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                lists = part.column(3)
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(shared.value[lists.flatten().to_numpy(zero_copy_only=False)])])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array(np.diff(ends)),
                    pa.array(sums[ends[1:]] - sums[ends[:-1]])], names=["id", "row", "n_words", "n_features", "weight"])

    return features.select("id", "row", "n_words", "buckets").mapInArrow(
        weigh, "id long, row long, n_words long, n_features long, weight long")


def gumbel(key: Column, scale: int) -> Column:
    """floor(scale * Gumbel noise) fixed by the first 32 bits of the key's sha256."""
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def sortable(*longs: Column) -> Column:
    """One text per row that sorts like the numbers: 16 hex digits each, the sign bit flipped."""
    return F.concat(*[F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") for c in longs])


def kth_key(rows: DataFrame, key: str, k: int, pivots: int = 31) -> str | None:
    """The ``k``-th least key of ``rows`` (from 1) by quickselect; None where there are fewer.

    ``key`` is a text column without nulls that no two rows share.  Each round
    takes the rows with the least hashes as random pivots and counts exactly
    how many rows lie below, at and above each; only the gap that holds the
    ``k``-th key is written for the next round.  The driver receives the
    pivots and one count per gap.
    """
    this = F.col(key)
    live, turn = rows.select(key), 0
    while k >= 1:
        turn += 1
        marks = sorted(r[0] for r in live.orderBy(F.xxhash64(key, F.lit(turn)), key).limit(pivots).collect())
        above = sum([(this > m).cast("int") for m in marks], F.lit(0))
        counts = {(r["above"], r["same"]): r["n"] for r in
                  live.groupBy(above.alias("above"), this.isin(marks).alias("same")).agg(F.count("*").alias("n")).collect()}
        gap = 0
        while gap < len(marks) and k > counts.get((gap, False), 0):
            k -= counts.get((gap, False), 0) + 1
            if k == 0:
                return marks[gap]
            gap += 1
        if k > counts.get((gap, False), 0):
            return None
        inside = [this > m for m in marks[max(gap - 1, 0):gap]] + [this < m for m in marks[gap:gap + 1]]
        for part in inside:
            live = live.where(part)
        live = stored(live, "quickselect")
    return None


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in the order of ``key``: ranges sorted apart, counts added up over ranges."""
    placed = stored(rows.repartitionByRange(key).sortWithinPartitions(key)
                    .withColumn("_at", F.monotonically_increasing_id()), "winners")
    # The id of a row is its range number above bit 33 and its place in the range below.
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count("*").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
            .drop("_at", "_part", "_before"))


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        target_text: str = "text", longest: int = 1, buckets: int = 10_000, seed: int = 2024,
                        min_words: int = 20, num: int = 10, den: int = 100, scale: int = 1000) -> DataFrame:
    """(id, n_features, weight, score, rank): every document, ranked where it is drawn.

    Words are runs of ASCII digits and letters, A-Z lower-cased, and of all
    code points from U+0080.  Features are all runs of 1 to ``longest``
    consecutive words; a feature's bucket is the crc32 of its UTF-8 bytes
    modulo ``buckets``.  Whole texts of both tables are counted; ``weight`` adds
    up ``bucket_gains`` over a document's features and ``score`` adds Gumbel
    noise fixed by ``seed`` and id.  Of the N documents with at least
    ``min_words`` words ``num * N // den`` with the highest scores are drawn,
    ties to the smaller id, then to fewer features.

    A null or empty text has no features and weight 0; a null id counts as the
    empty text in the noise and comes after all others in ties.  Repeated rows
    each count and may each be drawn.  Very long texts are one row of bucket
    numbers.  An empty table gives an empty table, an empty target is a target
    without features.  Other columns, whatever their names, are not read.

    Texts are read once.  Broadcast and sent to the driver are ``buckets``
    numbers, quickselect's pivots, and one row per range of winners.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    features = stored(feature_buckets(rows, buckets, longest), "features")
    aims = target.select(F.lit(0).cast("long").alias("id"), F.col(f"`{target_text}`").alias("text"),
                         F.lit(0).cast("long").alias("row"))
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(feature_buckets(aims, buckets, longest), buckets), scale)
    noise = gumbel(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), scale)
    # Composite key of the draw: highest score, smallest id (null last), fewest features, and the row itself.
    scored = stored(
        weighted(features, gains).withColumn("score", F.col("weight") + noise).withColumn("key", sortable(
            -F.col("score"), F.col("id").isNull(), F.coalesce(F.col("id"), F.lit(0)), F.col("n_features"), F.col("row"))), "scored")
    able = F.col("n_words") >= min_words
    last = kth_key(scored.where(able), "key", scored.where(able).count() * num // den)
    out = ["id", "n_features", "weight", "score", "rank"]
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(out)
    drawn = able & (F.col("key") <= last)
    return ranked(scored.where(drawn), "key").select(out).unionByName(
        scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")).select(out))
