"""Exact Jaccard join of shingle sets in a metric space.

1. Sets are cut into classes by shingle hash, more classes than two linked
   sets can have differences; so linked sets agree on a whole class.  The class
   contents are pivots under the Jaccard distance restricted to that class, and
   the sets at distance 0 from one form its region.  A set with c classes, at
   most d of which a linked set can lack, stays in the d + 1 of its regions that
   hold the fewest sets: any two linked sets still share one of those.
2. Within a region documents become pivots.  Distances to them assign every
   other set to its nearest pivot (Voronoi regions) and replicate it wherever
   its distance exceeds the nearest by at most twice the linking distance;
   rings around the pivot as wide as the linking distance split a region
   further.  Both follow from the triangle inequality and lose no linked pair.
   A region that this would not make smaller just loses its pivots.
   The distance is the sum of differences between counts of hashes per bin, a
   metric that never exceeds the number of elements in which the sets differ;
   pairs that it cannot reject are compared by their exact Jaccard distance.
3. Regions are joined again in the same way until no region holds two sets of
   different components.  Sets already connected need no further comparison.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.operators.graph import connected_components

from .common import stored, words

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
TAG = np.uint64(1023)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """xxh3 hash of each word, computed once per task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles.

    Fewer words are one shingle, none are the empty set.
    """
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n = max(1, len(h) - k + 1)
    code = np.full(n, len(h) if len(h) < k else 0, np.uint64)
    for i in range(min(k, len(h))):
        code = mixed(code * ODD + h[i:i + n])
    return np.unique(code)


class Classes:
    """Sizes of bands and numbers of classes for a threshold num/den.

    Bands grow by half.  Two linked sets are in one band or in neighbouring
    ones and meet under the larger one's band.
    """

    def __init__(self, num: int, den: int):
        if not 3 * den <= 4 * num <= 4 * den:  # below, a set may have as many differences as members
            raise ValueError("the threshold must lie between 3/4 and 1")
        self.num, self.den = num, den
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * 3 // 2))
        self.cuts = [self._first_cut(band) for band in range(len(self.edges) - 1)]

    def bands(self, n: int) -> list[int]:
        own = bisect.bisect_right(self.edges, n) - 1
        up = n * self.den // self.num >= self.edges[own + 1]
        return [own, own + 1] if up else [own]

    def _first_cut(self, band: int) -> tuple[int, int]:
        """Most differences of two linked sets of which the larger is in the band, and
        the spare classes that the smallest set there is likely to leave empty."""
        largest = self.edges[band + 1] - 1
        most = 2 * largest * (self.den - self.num) // (self.den + self.num)
        smallest, spare = self.edges[band] * self.num / self.den, 1
        for _ in range(4):
            cut = most + 1 + spare
            spare = 1 + max(most // 4, int(1.2 * cut * math.exp(-smallest / cut)))
        return most, spare

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """One hash per band, cut and non-empty class of the set, its low bits telling band and cut.

        Sets that agree on a class could both be empty there.  So a set goes on
        to finer cuts until it has no more empty classes than the cut has to
        spare; linked sets then share a non-empty class in the last cut that
        both make.  Also gives, for each band and cut in a row: their bits, the
        number of classes, and the number of regions to stay in.
        """
        n, out, cuts = len(s), [s[:0]], []
        if not n:
            return s, cuts
        content, place = mixed(s ^ ODD), s >> np.uint64(32)
        for band in self.bands(n):
            most, spare = self.cuts[band]
            differ = (n + self.edges[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)
            for level in range(4):
                cut = most + 1 + spare if most else 1
                cell = (place * np.uint64(cut)) >> np.uint64(32)
                # Hashes are sorted and cells are monotone in them, so cells are runs.
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                code = band * 4 + level
                total = mixed(np.add.reduceat(content, first) + mixed(cell[first] * ODD + np.uint64(code)))
                out.append((total & ~TAG) | np.uint64(code))
                cuts += [code, len(first), differ + 1]
                if not most or cut - len(first) <= spare:
                    break
                # As many classes as it takes; the last cut is so fine that hardly two hashes meet.
                spare = 4 * spare + 1 if level < 2 else 1 << 31
        return np.concatenate(out), cuts


def _firsts(num: int, den: int):
    """What is learnt of every text first: size, digest, cuts and signatures of its set."""
    classes = Classes(num, den)

    def columns(sets: list[np.ndarray]) -> dict[str, pa.Array]:
        signs, cuts = zip(*map(classes.signatures, sets))
        return {"n": pa.array([len(s) for s in sets], pa.int64()), **dict(zip(("d1", "d2"), _digests(sets))),
                "cuts": _lists([np.array(c, np.int64) for c in cuts]), "signs": _lists(signs)}
    return columns


BINS = 512


def sketch(s: np.ndarray) -> bytes:
    """Number of hashes per bin, 255 at most."""
    return np.minimum(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the differences of two sketches: at most the number of differences of the sets."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
                for c in ("x", "y"))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("id", "pivot", "m", "n")), pa.array(np.abs(x - y).sum(1).astype(np.int64))],
            names=["id", "pivot", "m", "n", "gap"])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int64)))


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)]


def _per_text(k: int, columns):
    """Runs ``columns(sets)`` on the shingle sets of each batch's texts, beside their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                found = columns([shingles(t, k, hashes) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *found.values()], names=["id", *found])
    return run


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (region, id) sorted by both, the distinct ones whose region has another id."""
    region, ids, known = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the row held back

    def out(mask: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(region[mask]), pa.array(ids[mask])], names=["region", "id"])

    for batch in batches:
        region = np.concatenate([region, batch.column(0).to_numpy()])
        ids = np.concatenate([ids, batch.column(1).to_numpy()])
        fresh = np.concatenate([[True], (region[1:] != region[:-1]) | (ids[1:] != ids[:-1])])[:len(ids)]
        region, ids = region[fresh], ids[fresh]
        if len(region) < 2:
            continue
        same = region[1:] == region[:-1]
        keep = np.concatenate([[known], same]) | np.concatenate([same, [False]])
        known = bool(keep[-1])
        keep[-1] = False  # its region may go on in the next batch
        yield out(keep)
        region, ids = region[-1:], ids[-1:]
    if known:
        yield out(np.ones(len(region), bool))


def _open(regions: DataFrame, components: DataFrame) -> DataFrame:
    """(region, id, home, label, members, outside) of the regions that still hold sets of several components;
    of regions with the same members one.  ``outside`` counts the sets that are not in its largest component."""
    placed = (regions.join(components.withColumnRenamed("node", "id"), "id", "left")
              .select("region", "id", "home", F.coalesce("component", "id").alias("label")))
    groups = placed.groupBy("region", "label").agg(
        F.count("*").alias("n"), F.max("home").alias("home"), F.bit_xor(F.xxhash64("id", "home")).alias("x"),
        F.sum(F.xxhash64("home", "id").cast("decimal(38,0)")).alias("s"))
    per = groups.groupBy("region").agg(
        F.count("*").alias("labels"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max("home").alias("home"), F.bit_xor("x").alias("x"),
        F.sum("s").alias("s")).where("labels > 1 and home")
    chosen = (per.groupBy(F.col("n").alias("members"), "x", "s").agg(F.min(F.struct("region", "most")).alias("of"))
              .select("of.region", "members", (F.col("members") - F.col("of.most")).alias("outside")))
    return stored(placed.join(chosen, "region"), "open", release=True)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                       text_col: str = "text", small_region: int = 32, centres: int = 2) -> DataFrame:
    """(id, n_shingles, component) for every row of ``docs``.

    Two documents link when ``den * intersection >= num * union`` of their sets
    of ``k``-word shingles (A-Z lower-cased), for thresholds from 3/4 on; a component is what links reach,
    named by its smallest id.  Every link between different sets is found;
    equal sets are one node of the join.

    Null and empty texts have the empty set and link with nothing.  Rows with
    a null id link with nothing and have a null component.  Rows that share an
    id are one document: what either of their texts links with is connected.
    An empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    profiles = stored(rows.mapInArrow(
        _per_text(k, _firsts(num, den)), "id long, n long, d1 long, d2 long, cuts array<bigint>, signs array<bigint>"),
        "profiles", batch=1000)
    nodes = profiles.where(F.col("id").isNotNull() & (F.col("n") > 0))
    firsts = nodes.groupBy("d1", "d2").agg(F.min("id").alias("node"))
    named = stored(nodes.select("id", "d1", "d2").join(firsts, ["d1", "d2"]).select("id", "node"), "nodes")
    twice = named.groupBy("id").agg(F.min("node").alias("m"), F.max("node").alias("o")).where("m != o").drop("o")
    links = named.join(twice, "id").select(F.col("node").alias("a"), F.col("m").alias("b")).where("a != b")

    # Regions of the first kind: a class content shared by sets that differ elsewhere.
    # Equal sets are one before their signatures are shuffled.
    single = nodes.select("id", "d1", "d2", "signs").join(
        firsts.select(F.col("node").alias("id"), "d1", "d2"), ["id", "d1", "d2"], "left_semi")
    crowded = stored(single.select(F.explode("signs").alias("region"), "id").repartition("region")
                     .sortWithinPartitions("region", "id").mapInArrow(_crowded, "region long, id long"),
                     "crowded", release=True)
    crowd = crowded.groupBy("region").agg(F.count("*").alias("size"))
    # Of a set's classes those without company come first, then the smallest regions.
    tag = F.col("region").bitwiseAND(F.lit(int(TAG)))
    cuts = nodes.select("id", F.explode(F.expr(
        "transform(sequence(0, size(cuts) - 1, 3), i -> struct(cuts[i] AS tag, cuts[i + 1] AS c, cuts[i + 2] AS stay))"
    )).alias("cut")).select("id", "cut.*").groupBy("id", "tag").agg(F.max("c").alias("c"), F.max("stay").alias("stay"))
    own = Window.partitionBy("id", "tag")
    placed = (crowded.join(crowd, "region").withColumn("tag", tag)
              .withColumn("at", F.row_number().over(own.orderBy("size", "region")))
              .withColumn("all", F.count("*").over(own)))
    regions = stored(placed.join(cuts, ["id", "tag"]).where(F.col("c") - F.col("all") + F.col("at") <= F.col("stay"))
                     .select("region", "id").withColumn("home", F.lit(True)), "regions", release=True)
    crowd = regions.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
    central = stored(regions.join(crowd, "region").groupBy("id").agg(F.sum("size").alias("rank")), "central")
    sets = stored(rows.join(central.select("id"), "id", "left_semi").mapInArrow(
        _per_text(k, lambda sets: {"n": pa.array([len(s) for s in sets], pa.int64()), "s": _lists(sets),
                                   "sketch": pa.array([sketch(s) for s in sets], pa.binary())}),
        "id long, n long, s array<bigint>, sketch binary").distinct(), "sets", release=True, batch=1000)

    links = stored(links, "links")
    components = (docs.sparkSession.createDataFrame([], "node long, component long") if links.isEmpty()
                  else connected_components(links, "a", "b"))
    known = None  # distances of the pairs compared so far
    pivots_per_region = 4
    while True:
        regions = _open(regions, components)
        if regions.isEmpty():
            break
        # Pivots from the smallest components of a region first: once all but its largest
        # component are pivots, the region is done.  Then the most central sets.
        alone = regions.groupBy("region", "label").agg(F.count("*").alias("n"))
        top = Window.partitionBy("region").orderBy("n", F.when(F.col("n") > 1, F.col("label")), F.desc("rank"), "id")
        wanted = F.when(F.col("members") <= small_region, small_region).otherwise(pivots_per_region)
        pivots = stored(regions.join(alone, ["region", "label"]).join(central, "id")
                        .withColumn("at", F.row_number().over(top)).where(F.col("at") <= max(small_region, pivots_per_region))
                        .where(F.col("at") <= F.least("outside", wanted))
                        .select("region", F.col("id").alias("pivot"), "at"), "pivots", release=True)
        regions = regions.select("region", "id", "home")
        pair = F.least("id", "pivot").alias("id"), F.greatest("id", "pivot").alias("pivot")
        pairs = regions.join(pivots, "region").where("id != pivot").select(*pair).distinct()
        if known is not None:
            pairs = pairs.join(known.select("id", "pivot"), ["id", "pivot"], "left_anti")
        near = stored(
            pairs.join(sets.select("id", F.col("n").alias("m"), F.col("sketch").alias("x")), "id")
            .join(sets.select(F.col("id").alias("pivot"), "n", F.col("sketch").alias("y")), "pivot")
            .select("id", "pivot", "m", "n", "x", "y").mapInArrow(
                _gaps, "id long, pivot long, m long, n long, gap long"), "gaps", release=True, batch=2000)
        known = near if known is None else known.unionAll(near)
        # Linked sets differ in no more elements than this.
        most = F.floor((F.col("m") + F.col("n")) * F.lit(den - num) / F.lit(den + num))
        label_of = components.select(F.col("node"), "component")
        open_pairs = (near.where(F.col("gap") <= most).select("id", "pivot")
                      .join(label_of.withColumnsRenamed({"node": "id", "component": "l"}), "id", "left")
                      .join(label_of.withColumnsRenamed({"node": "pivot", "component": "r"}), "pivot", "left")
                      .where(F.coalesce("l", "id") != F.coalesce("r", "pivot")).select("id", "pivot").distinct())
        both = F.size(F.array_intersect("x", "y"))
        linked = stored(open_pairs.join(sets.select("id", F.col("s").alias("x")), "id")
                  .join(sets.select(F.col("id").alias("pivot"), F.col("s").alias("y")), "pivot")
                  .select("id", "pivot", (F.size("x") + F.size("y")).alias("sum"), both.alias("both"))
                  .where(F.lit(den) * F.col("both") >= F.lit(num) * (F.col("sum") - F.col("both")))
                  .select(F.col("id").alias("node"), F.col("pivot").alias("component")), "linked", release=True)
        if not linked.isEmpty():
            # What is connected already is a star of its component's least node.
            components = stored(connected_components(components.unionAll(linked), "node", "component"), "components", release=True)

        # The rest of each region that is still open: Voronoi cells of its pivots with their windows, in rings
        # as wide as the most differences that linked sets of the region can have.
        regions = regions.join(pivots.select("region", F.col("pivot").alias("id")), ["region", "id"], "left_anti")
        regions = _open(regions, components)
        if regions.isEmpty():
            break
        pivots_per_region *= 8
        # Where few sets are left outside the largest component, these are the next pivots.
        few = regions.where(F.col("outside") <= pivots_per_region).select("region", "id", "home")
        regions = regions.where(F.col("outside") > pivots_per_region).select("region", "id", "home")
        if regions.isEmpty():
            regions = few
            continue
        gaps = known.groupBy("id", "pivot").agg(F.min("gap").alias("gap"), F.max(F.greatest("m", "n")).alias("size"))
        rest = (regions.join(pivots.where(F.col("at") <= centres), "region")
                .withColumns({"low": F.least("id", "pivot"), "high": F.greatest("id", "pivot")})
                .join(gaps.withColumnsRenamed({"id": "low", "pivot": "high"}), ["low", "high"]).drop("low", "high", "at"))
        nearest = rest.groupBy("region", "id").agg(F.min(F.struct("gap", "pivot")).alias("best"))
        width = rest.groupBy("region").agg(
            (F.floor(F.max("size") * F.lit(2 * (den - num)) / F.lit(den + num)) + 1).alias("width"))
        ring = F.floor(F.col("gap") / F.col("width"))
        cells = stored(
            rest.join(nearest, ["region", "id"]).join(width, "region")
            .where(F.col("gap") <= F.col("best.gap") + 2 * F.col("width"))
            .withColumn("ring", F.explode(F.array(ring, ring + 1)))
            .withColumn("cell", F.xxhash64("region", "pivot", "ring"))
            .groupBy("region", "cell", "id").agg(F.max(F.col("home") & (F.col("pivot") == F.col("best.pivot"))).alias("in"),
                                                 F.max("home").alias("home")), "cells", release=True)
        # A region whose windows would copy most of it into several cells stays whole.
        parted = (cells.groupBy("region").agg(F.count("*").alias("copies"), F.count_distinct("id").alias("n"))
                  .select("region", (F.col("copies") <= 1.5 * F.col("n")).alias("parts")))
        marked = cells.join(parted, "region")
        regions = (marked.where("parts").select(F.col("cell").alias("region"), "id", F.col("in").alias("home"))
                   .unionAll(marked.where("not parts").select("region", "id", "home").distinct()).unionAll(few))

    found = (named.join(components, named["node"] == components["node"], "left")
             .select("id", F.coalesce(components["component"], named["node"]).alias("component")).distinct())
    return (profiles.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left")
            .select("id", "n_shingles", F.coalesce("component", "id").alias("component")))
