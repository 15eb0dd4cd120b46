import math
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions.core import numeric_text, sample_kurtosis, sample_skewness
from tablescope.functions.normal import cdf_sql, pdf_sql, ppf_sql

# F4 probe strings: (text, parses?)
PROBES = ["1", " 5 ", "1e3", "+3", ".5", "5.", "inf", "-Infinity", "1,000", "0x10", "1_0",
          "1d", "1f", "", "True", None, "NaN", "abc"]


def test_numeric_text_matches_pandas(spark):
    df = spark.createDataFrame([(p,) for p in PROBES], "s string")
    got = [r[0] for r in df.select(numeric_text(F.col("s"))).collect()]
    exp = pd.to_numeric(pd.Series(PROBES, dtype=object), errors="coerce").tolist()
    for g, e in zip(got, exp):
        if e is None or (isinstance(e, float) and math.isnan(e)):
            assert g is None
        else:
            assert g == e


def test_normal_functions(spark):
    ps = [1e-12, 0.001, 0.02, 0.3, 0.5, 0.77, 0.975, 1 - 1e-9] + [random.random() for _ in range(50)]
    df = spark.createDataFrame([(p, (p - 0.5) * 16) for p in ps], "p double, z double")
    rows = df.select("p", "z", F.expr(ppf_sql("p")).alias("q"), F.expr(cdf_sql("z")).alias("c"),
                     F.expr(pdf_sql("z")).alias("d")).collect()
    nd = statistics.NormalDist()
    for r in rows:
        assert r["q"] == pytest.approx(nd.inv_cdf(r["p"]), rel=1e-12, abs=1e-12)
        assert r["c"] == pytest.approx(nd.cdf(r["z"]), abs=1e-14)
        assert r["d"] == pytest.approx(nd.pdf(r["z"]), rel=1e-12, abs=1e-300)
    assert df.select(F.expr(ppf_sql("0e0"))).first()[0] is None


@pytest.mark.parametrize("vals", [[1.0, 2.0, 2.0, 3.0, 10.0], [5.0] * 5, [1.0, 2.0],
                                  [1.0, 2.0, 4.0], [3.0, 1.0, 1.0, 3.0, 2.0, 8.0]])
def test_moment_corrections_match_pandas(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = df.agg(F.count("v").alias("n"), F.skewness("v").alias("g1"),
               F.kurtosis("v").alias("g2")).select(
        sample_skewness(F.col("n"), F.col("g1")).alias("s"),
        sample_kurtosis(F.col("n"), F.col("g2")).alias("k")).first()
    s = pd.Series(vals)
    for got, exp in ((r["s"], s.skew()), (r["k"], s.kurtosis())):
        if math.isnan(exp):
            assert got is None
        else:
            assert got == pytest.approx(exp, abs=1e-9)
