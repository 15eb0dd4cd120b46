import os
import tempfile

import pytest

from tablescope.streaming import start_profile


def test_stream_profile_equals_batch(spark):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "event_id", "user_id", "value")
    d = tempfile.mkdtemp(prefix="ts-stream-", dir="/tmp")
    for i in range(3):
        src.where(f"event_id % 3 = {i}").write.parquet(f"{d}/in/part{i}")
    stream = spark.readStream.schema(src.schema).option("recursiveFileLookup", "true") \
        .parquet(f"{d}/in")
    q = start_profile(stream, f"{d}/out", checkpoint_location=f"{d}/ckpt", available_now=True)
    q.awaitTermination(180)
    got = {r["column_name"]: r for r in spark.read.parquet(f"{d}/out").collect()}
    exp = src.selectExpr("count(value) n", "avg(value) mean", "min(value) mn",
                         "max(value) mx", "stddev_samp(value) sd").first()
    v = got["value"]
    assert v["n"] == exp["n"] and v["min"] == exp["mn"] and v["max"] == exp["mx"]
    assert v["mean"] == pytest.approx(exp["mean"]) and v["std"] == pytest.approx(exp["sd"])
