"""Approximate nearest neighbours with balanced posting lists.

Vectors are kept in the posting lists of several near centroids; centroids are
searched through an in-memory graph, and a distance ratio decides which lists
a vector joins and a query reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


@dataclass
class CentroidIndex:
    """Unit-length centroids and a graph of their nearest neighbours."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids of each row of ``x`` by best-first search with a beam of ``width``.

        All rows advance together: each step expands every row's best centroid
        not expanded yet, until a row has none left in its beam.
        Returns indices and squared distances, nearest first; -1 where fewer were met.
        """
        c, n = self.centroids, len(x)
        width = min(width, len(c))
        norms = (c * c).sum(1)
        seen = np.zeros((n, len(c)), bool)
        ids = np.full((n, width), -1)
        dist = np.full((n, width), np.inf)
        expanded = np.ones((n, width), bool)
        fresh = np.broadcast_to(self.entries, (n, len(self.entries)))
        active = np.arange(n)
        while len(active):
            known = seen[active[:, None], fresh]
            seen[active[:, None], fresh] = True
            d = norms[fresh] - 2 * np.einsum("nd,nkd->nk", x[active], c[fresh]) + (x[active] ** 2).sum(1)[:, None]
            d[known] = np.inf
            all_ids = np.hstack([ids[active], fresh])
            all_dist = np.hstack([dist[active], d])
            all_done = np.hstack([expanded[active], np.zeros(fresh.shape, bool)])
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
            pick = np.arange(len(active))[:, None]
            ids[active], dist[active], expanded[active] = all_ids[pick, order], all_dist[pick, order], all_done[pick, order]
            expanded[active] |= np.isinf(dist[active])
            more = ~expanded[active].all(axis=1)
            active = active[more]
            if len(active):
                nxt = (~expanded[active]).argmax(axis=1)
                expanded[active, nxt] = True
                fresh = self.graph[ids[active, nxt]]
        ids[np.isinf(dist)] = -1
        return ids, np.maximum(dist, 0.0)


def _fit_centroids(x: np.ndarray, n_lists: int, rounds: int, degree: int, seed: int) -> CentroidIndex:
    """Balanced k-means on the sample: a list that outgrows its share is charged a rising price."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    n_lists = max(1, min(n_lists, len(x)))
    c = x[rng.choice(len(x), n_lists, replace=False)].copy()
    price = np.zeros(n_lists)
    block = max(1, 2_000_000 // n_lists)  # bounds the distances held at a time
    for _ in range(rounds):
        shift = (c * c).sum(1) + price
        near = np.concatenate([(shift - 2 * x[low:low + block] @ c.T).argmin(1) for low in range(0, len(x), block)])
        size = np.bincount(near, minlength=n_lists)
        price += 0.02 * (size / (len(x) / n_lists) - 1)
        price = np.maximum(price, 0)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    d = (c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1)
    np.fill_diagonal(d, -1)
    graph = np.argsort(d, axis=1, kind="stable")[:, :max(1, min(degree, n_lists))]
    # A few random links per centroid keep the graph in one piece.
    graph = np.hstack([graph, rng.integers(0, n_lists, (n_lists, 4))])
    return CentroidIndex(c, graph, np.unique(rng.integers(0, n_lists, 8)))


def _valid(vec: str, dim: int | None = None) -> F.Column:
    v = F.col(vec)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return ok if dim is None else ok & (F.size(v) == dim)


def _best_rows(scores: np.ndarray, ids: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (id, score) of scored vectors with their id lists: highest score, then smallest id."""
    n = np.array([len(i) for i in ids])
    flat, each = np.concatenate(ids).astype(np.int64), np.repeat(scores, n)
    order = np.lexsort((flat, -each))[:k]
    return flat[order], each[order]


def nearest_neighbours(vectors: DataFrame, is_query: F.Column, id_col: str = "vec_id", vec_col: str = "embedding",
                       k: int = 20, list_rows: int = 100, max_lists: int = 4096, replicas: int = 6, join_ratio: float = 1.2,
                       read_ratio: float = 1.5, probes: int = 128, sample_rows: int = 50_000,
                       block_rows: int = 2048, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by inner product.

    Queries are the rows that fulfil ``is_query``; candidates all rows but the
    query's own id.  Scores are inner products of the original vectors in
    double precision, ties go to the smaller id.

    There is a list for every ``list_rows`` distinct vectors, ``max_lists`` at
    most.  Centroids are fitted on at most about ``sample_rows`` vectors; every
    vector is indexed.  It joins the lists whose centroid is at most
    ``join_ratio`` times as far as its nearest, ``replicas`` at most.  A query
    reads the lists within ``read_ratio`` times the distance of the second
    nearest (the nearest may be its own vector's), 8 at least and ``probes`` at
    most, and goes on until the lists read are the nearest of more than ``k``
    vectors.  For inner products of vectors of unequal length one component is
    appended that makes all lengths equal.  Equal vectors are indexed once with
    their ``k + 1`` smallest ids, which is exact since ties go by id.  Lists and
    the queries that read one are cut into blocks of about ``block_rows`` by
    hash, so a crowded list has many tasks; a task returns ids and scores.

    Rows with a null id, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part; nor do vectors of another length than
    most.  Repeated rows count once.  With fewer than ``k`` candidates all
    lists are read and all candidates come back.  An empty table gives no rows;
    other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                          F.col(f"`{vec_col}`").cast("array<double>").alias("v"), is_query.alias("q")
                          ).where(F.col("id").isNotNull() & _valid("v"))
    top_dim = (rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first())
    schema = "query_id long, rank int, vec_id long, score double"
    if top_dim is None:
        return spark.createDataFrame([], schema)
    dim = top_dim["d"]
    rows = rows.where(F.size("v") == dim)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    by_vector = Window.partitionBy("h", "v").orderBy("id")
    # dedupe: the k + 1 smallest ids of a vector are all that a result can hold
    distinct = stored(
        rows.select("id", "v", F.xxhash64("v").alias("h")).dropDuplicates(["h", "id"])
        .withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
        .groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("key", F.monotonically_increasing_id()), "vectors")
    n, longest = distinct.agg(F.count("*"), F.max(square)).first()
    longest = float(longest) ** 0.5

    def lifted(v: np.ndarray) -> np.ndarray:
        """Vectors on the unit sphere with one more component, in which nearness is the inner product's."""
        u = v / longest
        return np.hstack([u, np.sqrt(np.maximum(0.0, 1.0 - (u * u).sum(1)))[:, None]])

    def asked_for(v: np.ndarray) -> np.ndarray:
        return np.hstack([v / np.sqrt((v * v).sum(1))[:, None], np.zeros((len(v), 1))])

    fit_on = distinct if n <= sample_rows else distinct.where(
        F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1_000_000)) < int(1e6 * sample_rows / n))
    sample = fit_on.orderBy("h", "v").select("v").toArrow().column(0).combine_chunks().flatten().to_numpy().reshape(-1, dim)
    fitted = _fit_centroids(lifted(sample), max(1, min(n // list_rows, max_lists)), 12, 24, seed)
    shared = spark.sparkContext.broadcast((fitted.centroids, fitted.graph, fitted.entries))

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CentroidIndex(*shared.value)
        for f in frames:
            for low in range(0, len(f), 1024):
                part = f.iloc[low:low + 1024]
                ids, d = index.search(lifted(np.stack(part["v"])), 32)
                ids, d = ids[:, :replicas], np.sqrt(d[:, :replicas])
                ok = (ids >= 0) & (d <= d[:, :1] * join_ratio + 1e-12)
                which, place = np.nonzero(ok)
                yield pd.DataFrame({"cell": ids[ok], "home": place == 0, "key": part["key"].to_numpy()[which],
                                    "ids": part["ids"].to_numpy()[which], "v": part["v"].to_numpy()[which]})

    posted = stored(distinct.select("key", "ids", "v").mapInPandas(
        post, "cell int, home boolean, key long, ids array<bigint>, v array<double>"), "postings")
    # One row per list, at most max_lists.
    sizes = np.zeros(len(fitted.centroids), np.int64)
    for r in posted.where("home").groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    homes = spark.sparkContext.broadcast(sizes)

    def choose(ids: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Which of the lists, nearest first, a query reads."""
        held = np.where(ids >= 0, homes.value[ids], 0)
        before = np.cumsum(held, axis=1) - held
        near = d <= d[:, min(1, d.shape[1] - 1)][:, None] * read_ratio + 1e-12
        return (ids >= 0) & (near | (np.arange(d.shape[1]) < 8) | (before <= k))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CentroidIndex(*shared.value)
        for f in frames:
            for low in range(0, len(f), 256):
                part = f.iloc[low:low + 256]
                x = asked_for(np.stack(part["v"]))
                ids, d = index.search(x, probes)
                few = np.where(ids >= 0, homes.value[ids], 0).sum(1) <= k
                ok = choose(ids, np.sqrt(d))
                ok[few] = False
                which, cell = np.nonzero(ok)[0], ids[ok]
                if few.any():  # the graph did not reach enough vectors: all centroids by distance
                    c = index.centroids
                    far = (c * c).sum(1) - 2 * x[few] @ c.T + (x[few] ** 2).sum(1)[:, None]
                    order = np.argsort(far, axis=1, kind="stable")
                    ok = choose(order, np.sqrt(np.maximum(np.take_along_axis(far, order, 1), 0)))
                    which = np.concatenate([which, np.flatnonzero(few)[np.nonzero(ok)[0]]])
                    cell = np.concatenate([cell, order[ok]])
                yield pd.DataFrame({"cell": cell, "key": part["key"].to_numpy()[which], "v": part["v"].to_numpy()[which]})

    queries = stored(rows.where("q").select("id", "v", F.xxhash64("v").alias("h")).dropDuplicates(["id", "h"])
                     .join(distinct.select("h", "v", "key"), ["h", "v"]).select("id", "key", "v"), "queries")
    asked = stored(queries.dropDuplicates(["key"]).select("key", "v").mapInPandas(ask, "cell int, key long, v array<double>"), "asked")
    # One row per list: how many blocks its vectors and its queries make.
    split = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    blocks = split(posted, "vector_blocks").join(split(asked, "query_blocks"), "cell")
    own = lambda name: F.pmod(F.xxhash64("key"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    vector_side = (posted.join(F.broadcast(blocks), "cell").withColumn("block", own("vector_blocks"))
                   .withColumn("part", every("query_blocks")).select("cell", "block", "part", "ids", "v"))
    query_side = (asked.join(F.broadcast(blocks), "cell").withColumn("part", own("query_blocks"))
                  .withColumn("block", every("vector_blocks")).select("cell", "block", "part", "key", "v"))

    def compare(group: tuple, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            a, b = np.stack(p["v"]), np.stack(q["v"])
            ids = p["ids"].to_numpy()
            for low in range(0, len(b), 256):
                rough = b[low:low + 256] @ a.T
                for i, s in enumerate(rough):
                    # Every vector that could be among the k + 1 best; ties at the edge stay in.
                    edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1] if len(s) > k + 1 else -np.inf
                    near = np.flatnonzero(s >= edge - 1e-9 * max(1.0, abs(edge)) if np.isfinite(edge) else s >= edge)
                    # Added up in the order of the components, so equal vectors score alike in every task.
                    exact = np.cumsum(a[near] * b[low + i], axis=1)[:, -1]
                    vec_id, score = _best_rows(exact, list(ids[near]), k + 1)
                    out.append(pd.DataFrame({"key": q["key"].iloc[low + i], "vec_id": vec_id, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "vec_id": [], "score": []})

    by = ["cell", "block", "part"]
    met = query_side.groupBy(*by).cogroup(vector_side.groupBy(*by)).applyInPandas(compare, "key long, vec_id long, score double")
    best = (met.dropDuplicates(["key", "vec_id"])
            .withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")))
            .where(F.col("n") <= k + 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (queries.select(F.col("id").alias("query_id"), "key").join(best, "key").where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
