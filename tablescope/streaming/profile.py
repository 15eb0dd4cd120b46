"""Incremental column profile over a Structured Streaming source.

The reference analyses only whole, static tables; this module runs the same
per-column moments (A3/A4 without order statistics) over a stream of files so
a profile stays current as data lands.  Every statistic is a mergeable
aggregate kept in Spark's state store (one small row per column); quantiles
are not offered here because exact ones are not mergeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.core import sample_kurtosis, sample_skewness
from ..operators.frames import KEY, VALUE, long_form
from ..session import scratch_folder


def stream_profile(stream: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Streaming aggregate ``(column_name, rows, n, missing, mean, std, min, max,
    skewness, kurtosis)``; use output mode ``complete`` or ``update``."""
    lf = long_form(stream, columns)
    agg = lf.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.count(VALUE).alias("n"),
        F.avg(VALUE).alias("mean"), F.stddev_samp(VALUE).alias("std"),
        F.min(VALUE).alias("min"), F.max(VALUE).alias("max"),
        F.skewness(VALUE).alias("g1"), F.kurtosis(VALUE).alias("g2"))
    return agg.select(KEY, "rows", "n", (F.col("rows") - F.col("n")).alias("missing"),
                      "mean", "std", "min", "max",
                      sample_skewness(F.col("n"), F.col("g1")).alias("skewness"),
                      sample_kurtosis(F.col("n"), F.col("g2")).alias("kurtosis"))


def start_profile(stream: DataFrame, output_path: str, columns: Sequence[str] | None = None,
                  checkpoint_location: str | None = None, available_now: bool = False,
                  processing_time: str | None = None) -> StreamingQuery:
    """Keep ``output_path`` (parquet) equal to the latest profile snapshot.

    The checkpoint (offsets + aggregation state) goes to the shared checkpoint
    folder unless given, so a restarted query resumes where it stopped.
    """
    spark = stream.sparkSession
    ckpt = checkpoint_location or scratch_folder(spark, "stream-profile")

    def publish(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(output_path)

    w = (stream_profile(stream, columns).writeStream.outputMode("complete")
         .option("checkpointLocation", ckpt).foreachBatch(publish))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
