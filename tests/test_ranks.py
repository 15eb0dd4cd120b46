"""Rank selection against a sort: several rounds, mixed key types, nulls, hot keys."""

import random

import pytest

from tablescope.operators import frames


@pytest.mark.parametrize("limit,fan", [(10, 3), (500, 32), (10**6, 32)])
def test_rows_at_steps_equal_the_sorted_ones(spark, monkeypatch, limit, fan):
    monkeypatch.setattr(frames, "SORTED_ROWS", limit)
    monkeypatch.setattr(frames, "FAN", fan)
    monkeypatch.setattr(frames, "SAMPLED_KEYS", 16 * fan * fan)
    rng = random.Random(6)
    # A third of the rows share their first key; nulls come first.
    rows = [(rng.choice(["hot", None, *"abcdefgh", "hot", "hot", "hot"]), i, float(i)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for m in (7, 100):
        step = len(rows) // m
        got = sorted((r["idx"], r["k"], r["i"], r["v"])
                     for r in frames.rows_at_steps(df, ["k", "i"], step, m, len(rows)).collect())
        assert got == [(p, *ordered[p]) for p in range(0, step * m, step)]


def test_equal_keys_end_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(frames, "SORTED_ROWS", 10)
    df = spark.range(200).selectExpr("1 as k", "id as v")
    got = frames.rows_at_steps(df, ["k"], 20, 10, 200).collect()
    assert sorted(r["idx"] for r in got) == list(range(0, 200, 20)) and len({r["v"] for r in got}) == 10


def test_rows_are_marked_without_a_function_over_all_splitters(spark, monkeypatch, capsys):
    """Per row a few comparisons, none of them interpreted; the kept rows are written once a round."""
    monkeypatch.setattr(frames, "SORTED_ROWS", 100)
    plans, cut = [], frames.cut_lineage
    monkeypatch.setattr(frames, "cut_lineage", lambda df: (plans.append(df), cut(df))[1])
    df = spark.range(2000).selectExpr("id", "(id * 7919) % 2000 as k")
    got = frames.rows_at_steps(df, ["k"], 40, 50, 2000).collect()
    assert sorted((r["idx"], r["k"]) for r in got) == [(i, i) for i in range(0, 2000, 40)]
    kept = [p for p in plans if {"id", "k", "_at"} == set(p.columns)]
    assert kept
    for plan in plans:
        if "_n" in plan.columns or plan in kept:
            plan.explain(True)
            assert "lambda" not in capsys.readouterr().out
