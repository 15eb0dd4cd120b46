"""Seasonal smoothing against a plain loop: gaps, short keys, null keys, missing values."""

import datetime
import math
import random

from tablescope import api


def smoothed(ys, m, horizon, alpha=0.3, beta=0.1, gamma=0.2):
    mean = lambda v: sum(x for x in v if x is not None) / max(sum(x is not None for x in v), 1) \
        if any(x is not None for x in v) else None
    if mean(ys) is None:
        return [None] * horizon
    whole = len(ys) >= 2 * m
    level, trend, terms, begin = mean(ys), 0.0, [0.0] * m, 0
    if whole:
        one, two, begin = mean(ys[:m]), mean(ys[m:2 * m]), m
        level = mean(ys) if one is None else one
        trend = 0.0 if None in (one, two) else (two - one) / m
        terms = [0.0 if y is None else y - level for y in ys[:m]]
    for t in range(begin, len(ys)):
        y, s = ys[t], terms[t % m]
        if y is None:
            level += trend
            continue
        new = alpha * (y - s) + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
        if whole:
            terms[t % m] = gamma * (y - level) + (1 - gamma) * s
    return [level + h * trend + terms[(len(ys) - 1 + h) % m] for h in range(1, horizon + 1)]


def test_seasonal_forecast_equals_a_loop(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for key, n in (("long", 61), ("two seasons", 24), ("short", 23), ("one", 1), (None, 30), ("empty", 3)):
        ys = []
        for t in range(n):
            day = datetime.datetime(2015 + t // 12, t % 12 + 1, 3)
            gone = 0 < t < n - 1 and rng.random() < 0.15
            y = None if gone else 100 + 3 * t + 40 * math.sin(t * math.pi / 6) + rng.random()
            if key == "empty":
                y = None
                rows.append((key, day, None))
            elif not gone:
                rows += [(key, day, y / 2), (key, day + datetime.timedelta(days=9), y / 2), (key, day, None)]
            ys.append(y)
        want[key] = smoothed(ys, 12, 14)
    rows.append(("long", None, 1e9))
    df = spark.createDataFrame(rows, "`_y` string, ts timestamp, v double").repartition(5)
    got = {}
    for r in api.ts_seasonal_forecast(df, "ts", "v", ["_y"], horizon=14).orderBy("step").collect():
        got.setdefault(r["_y"], []).append(r["forecast"])
        if r["_y"] == "one":
            assert r["period"] == datetime.datetime(2015 + r["step"] // 12, r["step"] % 12 + 1, 1)
    assert got.keys() == want.keys()
    for key in want:
        assert len(got[key]) == 14
        assert all(a is b is None or abs(a - b) < 1e-6 for a, b in zip(got[key], want[key])), key


def test_seasonal_forecast_of_nothing(spark):
    df = spark.createDataFrame([], "ts timestamp, v double")
    assert api.ts_seasonal_forecast(df, "ts", "v").count() == 0
