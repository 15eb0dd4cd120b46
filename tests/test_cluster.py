import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope import api


def test_standard_scale_population_std(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    z = api.standard_scale(df, ["c_acctbal", "c_nationkey"]).toPandas()
    assert z.mean().abs().max() < 1e-9
    assert np.allclose(z.std(ddof=0), 1.0)


def test_kmeans_invariants(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    res = api.kmeans(df, ["c_acctbal", "c_nationkey"], k=3, keep=["c_custkey"])
    a = res.assignments.toPandas()
    cen = res.centers.toPandas().pivot(index="cluster", columns="feature", values="center")
    Z = a[["_z0", "_z1"]].to_numpy()
    C = cen[["c_acctbal", "c_nationkey"]].to_numpy()
    nearest = ((Z[:, None, :] - C[None, :, :]) ** 2).sum(-1).argmin(1)
    assert (nearest == a["cluster"].to_numpy()).mean() > 0.99
    sizes = api.cluster_sizes(res.assignments).toPandas()
    assert sizes["size"].sum() == df.count()
    assert list(sizes["size"]) == sorted(sizes["size"], reverse=True)
    imp = api.feature_importance(res).collect()
    assert len(imp) == 2 and imp[0]["importance"] >= imp[1]["importance"]


def test_pca_matches_numpy(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    feats = ["p_size", "p_retailprice", "p_partkey"]
    proj, load = api.pca_projection(df, feats, keep=["p_partkey"])
    X = df.select(*feats).toPandas().to_numpy(float)
    Z = (X - X.mean(0)) / X.std(0)
    w, v = np.linalg.eigh(np.cov(Z.T))
    top = v[:, np.argsort(w)[::-1][:2]]
    for j in range(2):
        col = top[:, j] * (1 if top[np.argmax(np.abs(top[:, j])), j] > 0 else -1)
        assert np.allclose(load[j], col, atol=1e-6)


def test_clustering_report_and_insights(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rep = api.clustering_report(df, ["l_quantity", "l_extendedprice", "l_discount"])
    assert rep["plot_features"] == ["pca_x", "pca_y"] and rep["num_clusters"] == 3
    centers = rep["centers"].collect()
    assert rep["centers"].columns == ["cluster", "pca_x", "pca_y"] and len(centers) == 3
    assert rep["converged"] and rep["iterations"] < 300
    assert rep["sample"].count() == 100
    kinds = [r["type"] for r in rep["insights"].collect()]
    assert "info" in kinds


def test_analysis_results_and_parameters(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    res = api.analyze(df, "statistical", column="value")
    assert not any(callable(v) for k, v in res.items() if k in ("column", "mode", "skewness"))
    assert set(res) == set(res.keys()) and "mode" in res and res.get("nope") is None
    with pytest.raises(ValueError):
        api.analyze(df, "time_series", ts="nope", value="value")
    with pytest.raises(ValueError):
        api.analyze(df, "time_series", ts="ts")
    assert "would be" in api.analyze(df, "regression")["message"]
    assert "would be" not in api.analyze(df, "time_series", ts="ts", value="value")["message"]
    failed = api.run_analysis(df, "nope")
    assert failed["status"] == "failed" and "nope" in failed["error_message"]
    assert api.run_analysis(df, "custom")["status"] == "completed"


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 600).selectExpr("id AS a", "id - 1 AS b").union(
        spark.createDataFrame([(900, 901), (901, 901), (None, 3)], "a long, b long"))
    got = {r["node"]: r["component"] for r in api.connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(600)}, 900: 900, 901: 900}


def test_rows_are_assigned_and_projected_by_plain_columns(spark):
    """No row becomes a vector after the fit; the projection is that of the covariance's eigenvectors."""
    import numpy as np
    rng = np.random.default_rng(4)
    rows = np.vstack([rng.normal(c, 0.5, (60, 3)) * [1.0, 2.0, 0.3] for c in (0.0, 4.0, 9.0)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, a double, b double, c double")
    rep = api.clustering_report(df, ["a", "b", "c"], num_clusters=3, keep=["id"])
    assert "UDF" not in rep["points"]._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r for r in rep["points"].collect()}
    z = (rows - rows.mean(0)) / rows.std(0)
    vec = np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :2]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), [0, 1]])
    assert np.allclose([[got[i]["pca_x"], got[i]["pca_y"]] for i in range(len(rows))], z @ vec, atol=1e-9)
    groups = [{got[i]["cluster"] for i in range(n, n + 60)} for n in (0, 60, 120)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
