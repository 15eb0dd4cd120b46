"""M3: exact DBSCAN on standard-scaled features, as Spark joins and aggregations.

Semantics (C15): Euclidean distance <= eps on scaled features; a point is core
when at least ``min_samples`` points (itself included) lie within eps; core
points within eps are connected; a cluster's id is the rank of its smallest
row id; a border point takes the smallest id among its core neighbours; all
other points are noise (-1).

Plan
----
1. Cells of side ``eps / sqrt(d)``: two points of one cell are always within
   eps, so intra-cell neighbours are *counted*, never paired.  A cell holding
   ``>= min_samples`` points is entirely core.
2. Neighbouring cells are found down a trie of their coordinates: pairs of
   three-dimensional prefixes by an equi-join on a coarse key (blocks of
   ceil(sqrt(d)) cells), then one more dimension at a time, children of a pair
   meeting by prefix and coarse coordinate.  Pairs whose boxes are farther
   apart than eps in the dimensions so far go no deeper.
3. Points of *sparse* cells (fewer than ``min_samples`` points) meet the points
   of neighbouring cells.  Against a dense cell only the number of neighbours
   per (point, cell) is kept, and the dense cell's points are dealt over salts;
   between two sparse cells, which hold few points each, the pairs are kept.
4. Two dense neighbour cells are linked when some pair of their points is
   within eps.  One point of each cell is tested against one of the other,
   which decides most pairs whatever the cells hold.  The cells so linked are
   components already; only pairs of cells in different components can still
   change a label.  These go through a dual-tree search: both cells are cut
   into sub-boxes level by level, box pairs farther apart than eps are dropped,
   a pair of boxes wholly within eps links its cells, and points are compared
   only where two boxes hold few of them.
5. Components of the cell graph by alternating stars (:mod:`graph`), a
   logarithmic number of rounds however long a cluster is: once over cells,
   once over the components that step 4 links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .cluster import Clustering, _z, scale_stats
from .frames import resolve_columns, with_row_index
from .graph import connected_components
from .schema import dropna_features

SALT_ROWS = 4096  # points of a dense cell in one salt
LEAF_PAIRS = 4096  # point pairs of two sub-boxes that are compared one by one
SPLIT_BITS = 4  # halvings of a sub-box per level, over all its dimensions
DEEPEST = 40  # halvings of one dimension; boxes as small as that are compared


def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, x: acc + x)


def _box_gap2(c1: Column, c2: Column, side: float) -> Column:
    """Squared minimum distance between two grid cells (integer coordinates)."""
    gaps = F.zip_with(c1, c2, lambda a, b: F.greatest(F.abs(a - b) - 1, F.lit(0)) * side)
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)


def _gap2(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Squared least distance of two boxes; for two points their distance, bit for bit."""
    gaps = F.zip_with(F.zip_with(lo1, hi2, lambda a, b: a - b), F.zip_with(lo2, hi1, lambda a, b: a - b),
                      lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)


def _reach2(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Squared greatest distance between points of two boxes."""
    ends = F.zip_with(F.zip_with(hi1, lo2, lambda a, b: a - b), F.zip_with(hi2, lo1, lambda a, b: a - b),
                      lambda a, b: F.greatest(a, b))
    return F.aggregate(ends, F.lit(0.0), lambda acc, g: acc + g * g)


def neighbour_cells(cells: DataFrame, dims: Sequence[int], side: float, eps: float) -> DataFrame:
    """Ordered pairs ``(c1, n1, c2, n2)`` of different cells whose boxes lie within ``eps``.

    ``cells`` has ``cell`` and ``cnt``; ``dims`` are the dimensions in which cells
    differ.  The pairs kept at a level are those of prefixes within eps of each
    other, so their number follows the true neighbours, not the cells that happen
    to agree in three dimensions.
    """
    d = len(dims)
    # Cells within eps differ by at most m in a dimension, so their blocks by at most 1.
    m = math.ceil(round(eps / side, 9))
    first = min(3, d)
    at = lambda c, i: F.col(c)[i]
    # A cell's path: its coordinates in the order of dims.
    paths = cells.select("cell", "cnt", F.array(*[at("cell", i) for i in dims]).alias("path"))
    heads = paths.select(F.slice("path", 1, first).alias("p")).distinct()
    key = lambda off: F.array(*[F.floor(at("p", j) / m) + off[j] for j in range(first)])
    offs = itertools.product((-1, 0, 1), repeat=first)
    pairs = (heads.select(F.col("p").alias("p1"), F.explode(F.array(*[key(o) for o in offs])).alias("k"))
             .join(heads.select(F.col("p").alias("p2"), key([0] * first).alias("k")), "k")
             .where(_box_gap2(F.col("p1"), F.col("p2"), side) <= eps * eps).select("p1", "p2"))
    for depth in range(first + 1, d + 1):
        kids = paths.select(F.slice("path", 1, depth - 1).alias("p"), at("path", depth - 1).alias("x")).distinct()
        block = F.floor(F.col("x") / m)
        one = kids.select(F.col("p").alias("p1"), F.col("x").alias("x1"),
                          F.explode(F.array(*[block + o for o in (-1, 0, 1)])).alias("k"))
        two = kids.select(F.col("p").alias("p2"), F.col("x").alias("x2"), block.alias("k"))
        pairs = (cut_lineage(pairs).join(one, "p1").join(two, ["p2", "k"])
                 .select(F.concat("p1", F.array("x1")).alias("p1"), F.concat("p2", F.array("x2")).alias("p2"))
                 .where(_box_gap2(F.col("p1"), F.col("p2"), side) <= eps * eps))
    ends = lambda n: paths.select(F.col("path").alias(f"p{n}"), F.col("cell").alias(f"c{n}"),
                                  F.col("cnt").alias(f"n{n}"))
    return (pairs.where(F.col("p1") != F.col("p2")).join(ends(1), "p1").join(ends(2), "p2")
            .select("c1", "n1", "c2", "n2"))


def linked_cells(pairs: DataFrame, pts: DataFrame, d: int, side: float, eps: float) -> DataFrame:
    """The pairs ``(c1, c2)`` of cells that hold two points within ``eps`` of each other.

    ``pts`` has ``z`` and ``cell``, which is ``floor(z / side)``.  Sub-boxes are tight around their points, so
    equal points are a box without extent and decided at once; comparing boxes
    rounds as comparing points does, so the answer equals that over all pairs.
    """
    asked = pairs.select(F.col("c1").alias("cell")).unionByName(pairs.select(F.col("c2").alias("cell"))).distinct()
    points = cut_lineage(pts.join(asked, "cell", "left_semi").select("cell", "z").distinct()
                         .select(F.col("cell").alias("up"), "z", F.col("cell").alias("node")))
    live = pairs.select("c1", "c2", F.col("c1").alias("a"), F.col("c2").alias("b"))
    levels, done, turn = [0] * d, None, 0
    while True:
        # One row per sub-box; its points are counted map-side.
        boxes = cut_lineage(points.groupBy("up", "node").agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.col("z")[i]) for i in range(d)]).alias("lo"),
            F.array(*[F.max(F.col("z")[i]) for i in range(d)]).alias("hi")))
        half = lambda parent, s: boxes.select(F.col("up").alias(parent), F.col("node").alias(f"to_{parent}"),
                                              F.col("n").alias(f"n{s}"), F.col("lo").alias(f"lo{s}"),
                                              F.col("hi").alias(f"hi{s}"))
        span = [F.col(c) for c in ("lo1", "hi1", "lo2", "hi2")]
        near = cut_lineage(live.join(half("a", 1), "a").join(half("b", 2), "b")
                           .where(_gap2(*span) <= eps * eps)
                           .select("c1", "c2", F.col("to_a").alias("a"), F.col("to_b").alias("b"),
                                   (F.col("n1") * F.col("n2")).alias("work"),
                                   (_reach2(*span) <= eps * eps).alias("all_near")))
        found = near.where("all_near").select("c1", "c2").distinct()
        todo = near.where(~F.col("all_near")).join(found, ["c1", "c2"], "left_anti")
        last = all(n >= DEEPEST for n in levels)
        few = todo if last else todo.where(F.col("work") <= LEAF_PAIRS)
        hits = (few.join(points.select(F.col("node").alias("a"), F.col("z").alias("z1")), "a")
                .join(points.select(F.col("node").alias("b"), F.col("z").alias("z2")), "b")
                .where(_sqdist(F.col("z1"), F.col("z2")) <= eps * eps).select("c1", "c2"))
        found = cut_lineage(found.unionByName(hits).distinct())
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        live = cut_lineage(todo.where(F.col("work") > LEAF_PAIRS).join(found, ["c1", "c2"], "left_anti")
                           .select("c1", "c2", "a", "b"))
        if live.isEmpty():
            return done
        # The next dimensions in turn are halved, the others keep their coordinate.
        for _ in range(SPLIT_BITS):
            levels[turn % d] += 1
            turn += 1
        kept = live.select(F.col("a").alias("node")).unionByName(live.select(F.col("b").alias("node"))).distinct()
        finer = F.array(*[F.floor(F.col("z")[i] / side * float(2 ** n)) for i, n in enumerate(levels)])
        points = cut_lineage(points.join(kept, "node", "left_semi")
                             .select(F.col("node").alias("up"), "z", finer.alias("node")))


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Cell pairs ``(c1, c2)`` with labels ``(x, y)`` that differ."""
    of = lambda cell, to: labels.select(F.col("cell").alias(cell), F.col("label").alias(to))
    return pairs.join(of("c1", "x"), "c1").join(of("c2", "y"), "c2").where("x != y")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``(cell, label)`` with the least label that the linked cell pairs reach."""
    merged = connected_components(_labelled(links, labels).select("x", "y").distinct(), "x", "y")
    return cut_lineage(labels.join(merged, labels["label"] == merged["node"], "left").select(
        "cell", F.coalesce("component", "label").alias("label")))


def dbscan(df: DataFrame, features: Sequence[str] | None = None, eps: float = 0.5,
           min_samples: int = 5, id_cols: Sequence[str] | None = None) -> Clustering:
    """Cluster rows of ``df``; ``id_cols`` give the row order that fixes labels.

    A single integer id column is the row id itself if one aggregate finds it
    unique; otherwise rows are numbered by the id columns and features.  The
    assignments also hold the scaled features ``_z0, _z1, ...``.
    """
    feats = resolve_columns(df, features)
    d = len(feats)
    clean = dropna_features(df, feats)
    order = list(dict.fromkeys([*(id_cols or []), *feats]))
    st = scale_stats(clean, feats)
    types = {f.name: f.dataType for f in df.schema.fields}
    keep = list(dict.fromkeys([*(id_cols or []), *feats]))
    base = clean.select(*[F.col(f"`{c}`") for c in keep],
                        F.array(*[_z(c, *st[c], types[c]) for c in feats]).alias("z"))
    unique = False
    if id_cols and len(id_cols) == 1 and isinstance(types[id_cols[0]], T.IntegralType):
        key = F.col(f"`{id_cols[0]}`")
        most = clean.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(key.isNull()).alias("null")).agg(
            F.max("n"), F.max("null")).first()
        unique = most[0] in (None, 1) and not most[1]
    if unique:
        pts = base.withColumn("_rid", F.col(f"`{id_cols[0]}`").cast("long"))
    else:
        pts = with_row_index(base, order, "_rid")
    side = eps / math.sqrt(d)
    # Dimensions in which rows differ; constant ones hold one cell coordinate.
    dims = [i for i, c in enumerate(feats) if st[c][1]] or [0]
    pts = cut_lineage(pts.withColumn("cell", F.transform("z", lambda x: F.floor(x / side))))

    cells = cut_lineage(pts.groupBy("cell").agg(F.count(F.lit(1)).alias("cnt"), F.min("_rid").alias("head")))
    cell_pairs = cut_lineage(neighbour_cells(cells, dims, side, eps))

    p1 = pts.select(F.col("_rid").alias("r1"), F.col("z").alias("z1"), F.col("cell").alias("c1"))
    p2 = pts.select(F.col("_rid").alias("r2"), F.col("z").alias("z2"), F.col("cell").alias("c2"))
    near = _sqdist(F.col("z1"), F.col("z2")) <= eps * eps
    from_sparse = cell_pairs.where(F.col("n1") < min_samples)
    # (3a) between sparse cells: fewer than min_samples partners per neighbouring cell.
    sparse_pairs = cut_lineage(
        from_sparse.where(F.col("n2") < min_samples).select("c1", "c2")
        .join(p1, "c1").join(p2, "c2").where(near).select("r1", "c1", "r2", "c2"))
    # (3b) against dense cells: counts only; a dense cell's points lie in several salts.
    salts = F.ceil(F.col("n2") / SALT_ROWS).cast("int")
    dense_points = (p2.join(cells.where(F.col("cnt") >= min_samples)
                            .select(F.col("cell").alias("c2"), F.col("cnt").alias("n2")), "c2")
                    .withColumn("salt", F.pmod(F.xxhash64("r2"), salts).cast("int"))
                    .select("c2", "salt", "z2"))
    asking = (from_sparse.where(F.col("n2") >= min_samples).select(
        "c1", "c2", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).join(p1, "c1"))
    to_dense = cut_lineage(asking.join(dense_points, ["c2", "salt"]).where(near)
                           .groupBy("r1", "c1", "c2").agg(F.count(F.lit(1)).alias("k")))
    counts = (sparse_pairs.groupBy("r1").agg(F.count(F.lit(1)).alias("k"))
              .unionByName(to_dense.select("r1", "k")).groupBy("r1").agg(F.sum("k").alias("k")))
    core = (pts.join(cells.select("cell", "cnt"), "cell")
            .join(counts.withColumnRenamed("r1", "_rid"), "_rid", "left")
            .withColumn("is_core", (F.col("cnt") + F.coalesce("k", F.lit(0))) >= min_samples)
            .select("_rid", "cell", "is_core"))
    core = cut_lineage(core)
    core_rids = core.where("is_core").select(F.col("_rid").alias("r"), F.col("cell"))

    # Edges of the cell graph between cells that hold core points.
    e_sparse = (sparse_pairs.join(core_rids.select(F.col("r").alias("r1")), "r1")
                .join(core_rids.select(F.col("r").alias("r2")), "r2").select("c1", "c2")
                .unionByName(to_dense.join(core_rids.select(F.col("r").alias("r1")), "r1").select("c1", "c2")))
    dense_pairs = cell_pairs.where((F.col("n1") >= min_samples) & (F.col("n2") >= min_samples)
                                   & (F.col("c1") < F.col("c2"))).select("c1", "c2")
    # (4a) One point of each cell, its smallest row id, against one of the other cell.
    heads = cut_lineage(pts.select("_rid", "z").join(
        cells.where(F.col("cnt") >= min_samples).select("cell", F.col("head").alias("_rid")), "_rid"))
    linked = (dense_pairs.join(heads.select(F.col("cell").alias("c1"), F.col("z").alias("z1")), "c1")
              .join(heads.select(F.col("cell").alias("c2"), F.col("z").alias("z2")), "c2").where(near))
    # A cell is named by its smallest core row id; a component by its smallest.
    labels = cut_lineage(core_rids.groupBy("cell").agg(F.min("r").alias("label")))
    labels = _merged(labels, e_sparse.unionByName(linked.select("c1", "c2")).distinct())
    # (4b) Pairs between different components, by sub-boxes.
    open_pairs = cut_lineage(_labelled(dense_pairs, labels).select("c1", "c2"))
    if not open_pairs.isEmpty():
        labels = _merged(labels, linked_cells(open_pairs, pts, d, side, eps))

    comp = with_row_index(labels.select("label").distinct(), ["label"], "cluster")
    cell_cluster = labels.join(comp, "label").select("cell", F.col("cluster").cast("int"))
    core_lab = core.where("is_core").join(cell_cluster, "cell").select("_rid", "cluster")
    # Border points: own cell's cluster if it holds a core point, or the
    # cluster of any core neighbour; the smallest id wins.
    nonc = core.where(~F.col("is_core")).select("_rid", "cell")
    via_cell = nonc.join(cell_cluster, "cell").select("_rid", "cluster")
    via_pair = (sparse_pairs.join(nonc.select(F.col("_rid").alias("r1")), "r1")
                .join(core_rids.select(F.col("r").alias("r2")), "r2")
                .select("r1", "c2")
                .unionByName(to_dense.join(nonc.select(F.col("_rid").alias("r1")), "r1")
                             .select("r1", "c2"))
                .join(cell_cluster.withColumnRenamed("cell", "c2"), "c2")
                .select(F.col("r1").alias("_rid"), "cluster"))
    border = via_cell.unionByName(via_pair).groupBy("_rid").agg(F.min("cluster").alias("cluster"))
    lab = core_lab.unionByName(border)
    out = (pts.join(lab, "_rid", "left")
           .select(*[F.col(f"`{c}`") for c in keep],
                   F.coalesce("cluster", F.lit(-1)).alias("cluster"),
                   *[F.col("z")[i].alias(f"_z{i}") for i in range(d)]))
    return Clustering(out, None, feats, "dbscan", "auto")
