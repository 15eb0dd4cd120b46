import numpy as np
import pytest

from brute import dbscan_reference, scale
from tablescope import api

CASES = [("supplier", ["s_acctbal", "s_nationkey"], "s_suppkey", 0.3, 5),
         ("supplier", ["s_acctbal", "s_nationkey"], "s_suppkey", 0.5, 5),
         ("part", ["p_size", "p_retailprice"], "p_partkey", 0.05, 3)]


@pytest.mark.parametrize("table,feats,key,eps,ms", CASES)
def test_dbscan_equals_brute_force(spark, table, feats, key, eps, ms):
    df = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")
    res = api.dbscan(df, feats, eps, ms, id_cols=[key])
    got = dict((r[key], r["cluster"]) for r in res.assignments.collect())
    pdf = df.select(*dict.fromkeys([key, *feats])).toPandas().sort_values(key)
    ref = dbscan_reference(scale(pdf[feats].to_numpy(float)), eps, ms)
    assert [got[k] for k in pdf[key]] == ref


def test_dbscan_chain_border_takes_smaller_label(spark):
    # two dense blobs bridged by one border point, one far point (noise)
    pts = [(0.0, 0.0), (0.1, 0.0), (0.0, 0.1), (0.1, 0.1),
           (1.0, 0.0), (1.1, 0.0), (1.0, 0.1), (1.1, 0.1),
           (0.55, 0.05), (9.0, 9.0)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)],
                               "id long, x double, y double")
    X = np.array(pts)
    # pick eps in scaled units so that the bridge reaches both blobs but is not core
    res = api.dbscan(df, ["x", "y"], eps=0.25, min_samples=4, id_cols=["id"])
    got = [r["cluster"] for r in res.assignments.orderBy("id").collect()]
    assert got == dbscan_reference(scale(X), 0.25, 4)


def test_dbscan_drops_null_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, None, 1.0), (3, 0.1, 1.1)],
                               "id long, x double, y double")
    res = api.dbscan(df, ["x", "y"], eps=5.0, min_samples=2, id_cols=["id"])
    assert sorted(r["id"] for r in res.assignments.collect()) == [1, 3]


def test_repeated_ids_keep_every_row(spark):
    from tablescope import api
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    out = api.dbscan(df, ["c_acctbal"], eps=0.1, id_cols=["c_nationkey"]).assignments
    assert out.count() == df.count()


def test_report_of_three_features(spark):
    from tablescope import api
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    rep = api.clustering_report(df, ["p_size", "p_retailprice", "p_partkey"], "dbscan", eps=0.5,
                                keep=["p_partkey"])
    assert rep["points"].columns == ["p_partkey", "pca_x", "pca_y", "cluster"]
    assert "_rid" not in rep["assignments"].columns and rep["points"].count() == df.count()


def nearly_touching(n, seed):
    """Two wavy lines of n points each, and the least distance between them (brute force)."""
    rng = np.random.default_rng(seed)
    y = np.sort(rng.uniform(-1, 1, n))
    a = np.column_stack([0.3 * np.sin(5 * y), y])
    b = np.column_stack([0.3 * np.sin(5 * y) + 1.5 + rng.uniform(0, 0.1, n), y])
    least = min(float(((b - p) ** 2).sum(1).min()) for p in a) ** 0.5
    return a, b, least


@pytest.mark.parametrize("factor,linked", [(1 - 1e-9, False), (1 + 1e-9, True)])
def test_dense_cells_without_witness(spark, factor, linked):
    from tablescope.operators.dbscan import linked_cells
    a, b, least = nearly_touching(3000, 5)
    a, b = np.vstack([a, a[:500]]) + 1, np.vstack([b, b[:500]]) + 1      # repeated points
    pts = spark.createDataFrame([([0, 0], p.tolist()) for p in a] + [([1, 0], p.tolist()) for p in b],
                                "cell array<long>, z array<double>")
    pair = spark.createDataFrame([([0, 0], [1, 0])], "c1 array<long>, c2 array<long>")
    least = min(float(((b - p) ** 2).sum(1).min()) for p in a) ** 0.5
    assert (linked_cells(pair, pts, 2, 2.0, least * factor).count() == 1) is linked


def test_dense_lines_just_over_eps(spark):
    a, b, _ = nearly_touching(400, 9)
    X = np.vstack([a, b])
    Z = scale(X)
    least = min(float(((Z[400:] - p) ** 2).sum(1).min()) for p in Z[:400]) ** 0.5
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(X)], "id long, x double, y double")
    for eps in (least * (1 - 1e-9), least * (1 + 1e-9)):
        out = api.dbscan(df, ["x", "y"], eps, 5, id_cols=["id"]).assignments.orderBy("id").collect()
        assert [r["cluster"] for r in out] == dbscan_reference(Z, eps, 5)


def test_eight_features(spark):
    rng = np.random.default_rng(3)
    centres = rng.uniform(-4, 4, (6, 8))
    X = np.vstack([c + rng.normal(0, 0.5, (50, 8)) for c in centres] + [rng.uniform(-6, 6, (30, 8))])
    X[:, 6] = 1.0                                                 # a constant feature
    names = [f"f{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(X)],
                               "id long, " + ", ".join(f"{n} double" for n in names))
    for eps in (0.4, 0.9):
        out = api.dbscan(df, names, eps, 4, id_cols=["id"]).assignments.orderBy("id").collect()
        assert [r["cluster"] for r in out] == dbscan_reference(scale(X), eps, 4)


def test_neighbour_cells_are_all_near_pairs_and_no_others(spark):
    from tablescope.operators.dbscan import neighbour_cells
    rng = np.random.default_rng(4)
    cells = np.unique(rng.integers(-4, 5, (150, 5)) * [1, 1, 1, 2, 0], axis=0)
    side, eps = 1.0, 5 ** 0.5
    frame = spark.createDataFrame([(c.tolist(), 1) for c in cells], "cell array<long>, cnt long")
    got = {(tuple(r.c1), tuple(r.c2)) for r in neighbour_cells(frame, [0, 1, 2, 3], side, eps).collect()}
    gap2 = (np.maximum(np.abs(cells[:, None] - cells[None]) - 1, 0) ** 2).sum(-1)
    want = {(tuple(map(int, cells[i])), tuple(map(int, cells[j])))
            for i, j in zip(*np.nonzero(gap2 < eps * eps - 1e-9)) if i != j}
    assert want <= got and all(gap2_of(a, b) <= eps * eps + 1e-9 for a, b in got)


def gap2_of(a, b):
    return sum(max(abs(x - y) - 1, 0) ** 2 for x, y in zip(a, b))


def test_dense_cells_are_linked_without_meeting_all_their_points(spark, monkeypatch):
    """Repeated rows in neighbouring cells: no row is paired with every neighbouring cell for a witness."""
    from tablescope.operators import dbscan as module
    plans, cut = [], module.cut_lineage

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(module, "cut_lineage", kept)
    rng = np.random.default_rng(5)
    # Two bands far from each other.
    spots = [*zip(rng.uniform(0, 4, 150), rng.uniform(0, 0.2, 150)), *zip(rng.uniform(0, 4, 150), rng.uniform(3, 3.2, 150))]
    pts = [p for p in spots for _ in range(6)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    res = api.dbscan(df, ["x", "y"], eps=0.2, min_samples=5, id_cols=["id"])
    got = [r["cluster"] for r in res.assignments.orderBy("id").collect()]
    assert got == dbscan_reference(scale(np.array(pts, float)), 0.2, 5)
    assert not any("min_by" in p for p in plans)
