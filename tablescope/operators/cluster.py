"""Clustering and projection.

Scaling statistics, k-means centres and PCA loadings are the only things the
driver holds (features x k numbers).  Every per-row step (scaling, assignment,
projection) is a column expression evaluated on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import as_double
from .frames import resolve_columns
from .schema import dropna_features


def scale_stats(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per feature (one aggregate)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    row = df.agg(*[F.avg(as_double(c, types[c])).alias(f"m{i}") for i, c in enumerate(features)],
                 *[F.stddev_pop(as_double(c, types[c])).alias(f"s{i}")
                   for i, c in enumerate(features)]).collect()[0]
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(features)}


def _z(c: str, mean: float, std: float, dt) -> Column:
    v = as_double(c, dt)
    if std is None or std == 0:
        return F.when(v.isNotNull(), F.lit(0.0))          # constant column -> 0
    return (v - F.lit(mean)) / F.lit(std)


def standard_scale(df: DataFrame, features: Sequence[str] | None = None,
                   keep: Sequence[str] = (), suffix: str = "") -> DataFrame:
    """M1: ``(x - mean) / std_pop`` per feature after dropping incomplete rows."""
    feats = resolve_columns(df, features)
    clean = dropna_features(df, feats)
    st = scale_stats(clean, feats)
    types = {f.name: f.dataType for f in df.schema.fields}
    return clean.select(*[F.col(f"`{k}`") for k in keep],
                        *[_z(c, *st[c], types[c]).alias(c + suffix) for c in feats])


@dataclass
class Clustering:
    """Result of :func:`kmeans` / :func:`dbscan`."""
    assignments: DataFrame      # keep columns, raw features, cluster
    centers: DataFrame | None   # cluster, feature, center (scaled), center_raw
    features: list[str]
    algorithm: str
    num_clusters: int | str
    iterations: int | None = None
    converged: bool | None = None


def _nearest(df: DataFrame, zcols: Sequence[str], centers: Sequence[Sequence[float]], name: str) -> DataFrame:
    """Append the number of the nearest centre (the first of equally near ones), as plain columns."""
    far = {f"_far{n}": sum(((F.col(z) - F.lit(x)) ** 2 for z, x in zip(zcols, c)), F.lit(0.0)) for n, c in enumerate(centers)}
    df = df.withColumns(far).withColumn("_least", F.array_min(F.array(*far)))
    best = F.coalesce(*[F.when(F.col(f) == F.col("_least"), n) for n, f in enumerate(far)])
    return df.withColumn(name, best).drop("_least", *far)


def kmeans(df: DataFrame, features: Sequence[str] | None = None, k: int = 3, seed: int = 42,
           keep: Sequence[str] = (), max_iter: int = 300) -> Clustering:
    """M2: k-means (k-means||, seed 42) on standard-scaled features.

    The model is fitted on the distinct scaled points, weighted by how many rows
    each stands for: repeated rows cost one point, and the points are dealt over
    all tasks whatever the splits of the input.  They are kept (memory and disk)
    while the model is fitted; the result tells the iterations and whether they
    ended before ``max_iter``.

    Cluster ids are renumbered by (size desc, first centre coordinate) so
    reports are stable.
    """
    feats = resolve_columns(df, features)
    clean = dropna_features(df, feats)
    st = scale_stats(clean, feats)
    types = {f.name: f.dataType for f in df.schema.fields}
    zcols = [f"_z{i}" for i in range(len(feats))]
    scaled = clean.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *feats])],
                          *[_z(c, *st[c], types[c]).alias(z) for c, z in zip(feats, zcols)])
    points = VectorAssembler(inputCols=zcols, outputCol="_vec").transform(
        scaled.groupBy(*zcols).agg(F.count(F.lit(1)).cast("double").alias("_w"))).persist(StorageLevel.MEMORY_AND_DISK)
    model = KMeans(k=k, seed=seed, featuresCol="_vec", predictionCol="_raw", weightCol="_w",
                   maxIter=max_iter).fit(points)
    centers = [list(map(float, c)) for c in model.clusterCenters()]
    sizes = {r["_raw"]: r["n"] for r in _nearest(points, zcols, centers, "_raw").groupBy("_raw").agg(F.sum("_w").alias("n")).collect()}
    steps = model.summary.numIter
    points.unpersist()
    pred = _nearest(scaled, zcols, centers, "_raw")
    order = sorted(range(len(centers)), key=lambda i: (-sizes.get(i, 0), centers[i][0]))
    relabel = {old: new for new, old in enumerate(order)}
    mapping = F.create_map(*[x for o, n in relabel.items() for x in (F.lit(o), F.lit(n))])
    out = pred.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *feats])],
                      mapping[F.col("_raw")].alias("cluster"), *zcols)
    spark = df.sparkSession
    cen_rows = [(relabel[i], f, float(v), float(v * (st[f][1] or 0.0) + st[f][0]))
                for i, c in enumerate(centers) for f, v in zip(feats, c)]
    cen = spark.createDataFrame(cen_rows, "cluster int, feature string, center double, "
                                          "center_raw double")
    return Clustering(out, cen, feats, "kmeans", k, steps, steps < max_iter)


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    """M5: ``(cluster, size)`` ordered by cluster id."""
    return (assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
            .orderBy("cluster"))


def feature_importance(result: Clustering, top: int = 3) -> DataFrame:
    """M6: population std of the (scaled) centres per feature, largest first, top 3."""
    if result.centers is None or result.algorithm != "kmeans":
        raise ValueError("feature importance needs k-means centres")
    return (result.centers.groupBy("feature").agg(F.stddev_pop("center").alias("importance"))
            .orderBy(F.desc("importance"), "feature").limit(top))


def pca_scaled(df: DataFrame, zcols: Sequence[str]) -> tuple[DataFrame, list[list[float]]]:
    """Append ``pca_x, pca_y``: 2-D PCA of already standard-scaled columns.

    The covariance (d x d) is accumulated by Spark ML; the projection is a
    column expression.  The sign of each component is fixed so that its
    largest-magnitude loading is positive (MLlib leaves it free).
    """
    vec = VectorAssembler(inputCols=list(zcols), outputCol="_vec").transform(df)
    pc = PCA(k=2, inputCol="_vec").fit(vec).pc.toArray()          # d x 2
    loadings = []
    for j in range(2):
        col = [float(pc[i, j]) for i in range(len(zcols))]
        big = max(col, key=abs)
        loadings.append([-x for x in col] if big < 0 else col)
    proj = [sum(F.col(f"`{z}`") * F.lit(w) for z, w in zip(zcols, ld)) for ld in loadings]
    return df.withColumns({"pca_x": proj[0], "pca_y": proj[1]}), loadings


def pca_projection(df: DataFrame, features: Sequence[str] | None = None,
                   keep: Sequence[str] = ()) -> tuple[DataFrame, list[list[float]]]:
    """M4: 2-D PCA of the standard-scaled features when there are more than two,
    else the first two features themselves.  Returns ``(*keep, pca_x, pca_y)``."""
    feats = resolve_columns(df, features)
    if len(feats) <= 2:
        cols = feats + feats[:1] if len(feats) == 1 else feats
        clean = dropna_features(df, feats)
        return clean.select(*[F.col(f"`{k}`") for k in keep],
                            F.col(f"`{cols[0]}`").cast("double").alias("pca_x"),
                            F.col(f"`{cols[1]}`").cast("double").alias("pca_y")), []
    zcols = [f"_z{i}" for i in range(len(feats))]
    clean = dropna_features(df, feats)
    st = scale_stats(clean, feats)
    types = {f.name: f.dataType for f in df.schema.fields}
    scaled = clean.select(*[F.col(f"`{k}`") for k in keep],
                          *[_z(c, *st[c], types[c]).alias(z) for c, z in zip(feats, zcols)])
    out, loadings = pca_scaled(scaled, zcols)
    return out.select(*[F.col(f"`{k}`") for k in keep], "pca_x", "pca_y"), loadings


# Cluster-balance thresholds and insight messages of I3.
IMBALANCED_ABOVE, BALANCED_BELOW, TOP_FEATURES = 10, 1.5, 3
CLUSTER_TEXT = {
    "imbalanced": "Clusters are highly imbalanced (largest/smallest ratio: {ratio:.1f}). "
                  "Consider adjusting the number of clusters or using a different algorithm.",
    "balanced": "Clusters are well-balanced in size, suggesting a good separation of data.",
    "features": "The most important features for clustering appear to be: {features}",
}


def cluster_insights(result: Clustering) -> DataFrame:
    """Balance warning/success and the top features (k-means only).

    The sizes are combined to smallest, largest and number of clusters on the
    executors; no row per cluster comes back.
    """
    spark = result.assignments.sparkSession
    size = cluster_sizes(result.assignments).agg(
        F.count(F.lit(1)).alias("clusters"), (F.max("size") / F.min("size")).alias("ratio"))
    rules = [
        (F.col("ratio") > IMBALANCED_ABOVE, "warning",
         F.format_string(CLUSTER_TEXT["imbalanced"].replace("{ratio:.1f}", "%.1f"), "ratio")),
        (F.col("ratio") < BALANCED_BELOW, "success", F.lit(CLUSTER_TEXT["balanced"])),
    ]
    if result.algorithm == "kmeans":
        top = ", ".join(r["feature"] for r in feature_importance(result, TOP_FEATURES).collect())
        rules.append((F.lit(True), "info", F.lit(CLUSTER_TEXT["features"].format(features=top))))
    found = F.array_compact(F.array(*[
        F.when(rule, F.struct(F.lit(kind).alias("type"), text.alias("message")))
        for rule, kind, text in rules]))
    return size.where("clusters > 1").select(F.inline(found))


def clustering_report(df: DataFrame, features: Sequence[str] | None = None,
                      algorithm: str = "kmeans", num_clusters: int = 3, eps: float = 0.5,
                      min_samples: int = 5, keep: Sequence[str] = (),
                      order_by: Sequence[str] | None = None) -> dict[str, object]:
    """M7: points to plot, sizes, centres (raw units for up to 2 features, else
    projected like the points), first 100 rows, insights.  Any algorithm name
    other than 'dbscan' runs k-means.  Without ``order_by`` the first rows are
    by the kept columns and features, so they are the same in every run."""
    feats = resolve_columns(df, features)
    if algorithm == "dbscan":
        from .dbscan import dbscan
        res = dbscan(df, feats, eps=eps, min_samples=min_samples, id_cols=list(keep) or None)
    else:
        res = kmeans(df, feats, k=num_clusters, keep=keep)
    a = res.assignments
    zcols = [f"_z{i}" for i in range(len(feats))]
    loadings: list[list[float]] = []
    if len(feats) > 2:
        points, loadings = pca_scaled(a, zcols)
        plot = ["pca_x", "pca_y"]
    else:
        points = a
        plot = feats[:2]
    points = points.select(*dict.fromkeys([*keep, *plot, "cluster"]))
    a = a.drop(*zcols, "_rid")
    centers = None
    if res.centers is not None and len(feats) <= 2:
        centers = (res.centers.groupBy("cluster")
                   .pivot("feature", feats).agg(F.first("center_raw")).orderBy("cluster"))
    elif res.centers is not None:
        weight = F.create_map(*[x for f, *w in zip(feats, *loadings) for x in (
            F.lit(f), F.array(*[F.lit(v) for v in w]))])[F.col("feature")]
        centers = res.centers.groupBy("cluster").agg(*[
            F.sum(F.col("center") * weight[j]).alias(name)
            for j, name in enumerate(plot)]).orderBy("cluster")
    sample = a.orderBy(*(order_by or [F.col(f"`{c}`") for c in a.columns])).limit(100)
    return {"assignments": a, "points": points, "plot_features": plot,
            "sizes": cluster_sizes(a), "centers": centers, "sample": sample,
            "features": feats, "algorithm": res.algorithm,
            "num_clusters": res.num_clusters if res.algorithm == "kmeans" else "auto",
            "iterations": res.iterations, "converged": res.converged,
            "insights": cluster_insights(res)}
