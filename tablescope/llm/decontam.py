"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters with at most k edits shares m - q + 1 - kq of its
q-grams with the document, all on diagonals (document position minus passage
position) at most k apart.  Shared q-grams are counted in overlapping bands of
2(k+1) diagonals, bands that meet the bound are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BITS = 22


def code_points(text: str) -> np.ndarray:
    """Code points with A-Z lower-cased and ASCII white space as blanks, one for one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    c[(c - np.uint32(65)) < 26] += np.uint32(32)
    c[(c - np.uint32(9)) < 5] = 32
    return c


def gram_codes(c: np.ndarray) -> np.ndarray:
    """Hash of the Q code points from each position on."""
    h = c.astype(np.uint64)
    step = 1
    while step < Q:
        h = h[:-step] * FACTOR + (h[step:] ^ (h[step:] >> np.uint64(29)))
        step *= 2
    return h ^ (h >> np.uint64(31))


class Passages:
    """q-gram index of the benchmark passages of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        self.ids, self.points, self.edits, self.need = [], [], [], []
        codes, owner, place = [], [], []
        for item, text in items:
            c = code_points(text.strip(" \t\n\x0b\x0c\r"))
            m = len(c)
            if m < min_chars:
                continue
            k = min(int(rate * m), (m - Q) // Q)
            n = len(self.ids)
            self.ids.append(item), self.points.append(c), self.edits.append(k)
            self.need.append(m - Q + 1 - k * Q)
            g = gram_codes(c)
            codes.append(g), owner.append(np.full(len(g), n)), place.append(np.arange(len(g)))
        codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        self.codes, self.first, self.times = np.unique(codes, return_index=True, return_counts=True)
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, int))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, int))[order]
        self.edits, self.need = np.array(self.edits, int), np.array(self.need, int)
        self.slots = np.zeros(1 << BITS, bool)
        self.slots[self.codes >> np.uint64(64 - BITS)] = True

    def hits(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, passage, place in passage) of every shared q-gram."""
        g = gram_codes(c)
        at = np.flatnonzero(self.slots[g >> np.uint64(64 - BITS)])
        if not len(at) or not len(self.codes):
            return at[:0], at[:0], at[:0]
        g = g[at]
        entry = np.minimum(np.searchsorted(self.codes, g), len(self.codes) - 1)
        known = self.codes[entry] == g
        at, low, n = at[known], self.first[entry[known]], self.times[entry[known]]
        ends = np.cumsum(n)
        which = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - n), n)
        return np.repeat(at, n), self.owner[which], self.place[which]

    def bands(self, c: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, first diagonal, fullest diagonal) of the bands that meet the bound, fullest bands first."""
        pos, owner, place = self.hits(c)
        if not len(pos):
            return []
        shift = 1 << 20  # keeps diagonals before the text's start positive
        diagonal = pos - place + shift
        band = diagonal // (self.edits[owner] + 1)
        key = np.concatenate([owner * (1 << 40) + band, owner * (1 << 40) + band - 1])
        found, count = np.unique(key, return_counts=True)
        out = []
        for k in found[count >= self.need[found >> 40]]:
            inside = np.flatnonzero(key == k) % len(pos)
            # A q-gram of the passage counts once, however often the text repeats it.
            shared = len(np.unique(place[inside]))
            if shared >= self.need[k >> 40]:
                d, times = np.unique(diagonal[inside], return_counts=True)
                p = int(k >> 40)
                out.append((shared, p, int((k & ((1 << 40) - 1)) * (self.edits[p] + 1) - shift), int(d[times.argmax()] - shift)))
        return [x[1:] for x in sorted(out, key=lambda x: (-x[0], x[1:]))]


def align(passage: np.ndarray, text: np.ndarray, diagonal: int, width: int) -> tuple[int, int, int]:
    """Fewest edits, start and end of ``passage`` in ``text`` within a band of diagonals."""
    m, n = len(passage), len(text)
    low = diagonal
    pad = np.full(m + width + 1, np.uint32(0x110000))  # no code point
    first, last = max(0, low), min(n, low + m + width)
    if last > first:
        pad[first - low:last - low] = text[first:last]
    unit = 1 << 32
    rows = np.arange(width, dtype=np.int64)
    best = rows + np.where((rows + low >= 0) & (rows + low <= n), 0, unit * (m + 1))
    step = rows * unit
    for i in range(m):
        cost = best + np.where(pad[i:i + width] == passage[i], 0, unit)
        cost[:-1] = np.minimum(cost[:-1], best[1:] + unit)
        best = np.minimum.accumulate(cost - step) + step
    best = np.where((rows + low + m >= 0) & (rows + low + m <= n), best, unit * (m + 1))
    j = int(np.argmin(best))
    return int(best[j] >> 32), int(best[j] & (unit - 1)) + low, low + m + j


def find_passages(text: str, passages: Passages) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of every passage found, best first where they overlap."""
    c = code_points(text)
    if len(c) < Q:
        return []
    return _verified(c, passages, passages.bands(c))


def _verified(c: np.ndarray, passages: Passages, bands: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    found: list[tuple[int, int, int, int]] = []
    exact: dict[int, list[int]] = {}
    for p, first, fullest in bands:
        passage, k = passages.points[p], int(passages.edits[p])
        m = len(passage)
        if any(first + 2 * (k + 1) - (m - k) < d < first + (m - k) for d in exact.get(p, ())):
            continue  # surely overlaps a span without edits, which nothing betters
        if fullest >= 0 and np.array_equal(c[fullest:fullest + m], passage):
            exact.setdefault(p, []).append(fullest)
            found.append((0, passages.ids[p], fullest, fullest + m))
            continue
        edits, start, end = align(passage, c, first, 2 * (k + 1))
        if edits <= k:
            found.append((edits, passages.ids[p], start, end))
    kept: list[tuple[int, int, int, int]] = []
    for edits, item, start, end in sorted(found, key=lambda f: (f[0], f[1] is not None, f[1] or 0, *f[2:])):
        if not any(item == i and start < e and s < end for i, s, e, _ in kept):
            kept.append((item, start, end, edits))
    return kept


def leaked_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text: str = "text", rate: float = 0.1,
                    min_chars: int = 32, block_chars: int = 4_000_000) -> DataFrame:
    """(id, item_id, start, end, edits): benchmark passages found in the documents.

    An item is found where a span of the document differs from it by at most
    ``rate`` times its length in character edits (A-Z lower-cased, white space
    as blanks); of overlapping spans the one with fewest edits stays.  Spans
    are code points, end exclusive.

    The benchmark is searched in blocks of at most ``block_chars`` characters,
    one broadcast index and one pass each, so its size is not bounded.  Items
    that are null or shorter than ``min_chars`` would match by chance and are
    not searched; equal items are found each under its own id, which may be
    null.  Null and empty texts hold nothing; repeated rows report each its own spans; an empty table
    or benchmark gives no rows.
    """
    spark = docs.sparkSession
    items = (benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("t"))
             .where(F.length("t") >= min_chars))
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_chars))
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where(
        F.length("text") >= min_chars - int(rate * min_chars))
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(
            sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            passages = Passages(shared.value, rate, min_chars)
            for frame in frames:
                got = []
                for doc_id, text in zip(frame["id"].tolist(), frame["text"].tolist()):
                    got += [(doc_id, None if item is None else str(item), *x) for item, *x in find_passages(text, passages)]
                yield pd.DataFrame(got, columns=["id", "item_id", "start", "end", "edits"])

        # Ids pass as text: pandas would turn a column of long with nulls into doubles.
        found = rows.mapInPandas(search, "id string, item_id string, start long, end long, edits long")
        found = found.withColumns({c: F.col(c).cast("long") for c in ("id", "item_id")})
        out = found if out is None else out.unionAll(found)
    return out
