"""Quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over the statistics;
partition-summed normal equations give ridge scores, which isotonic regression
turns into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
ENDS = frozenset(b".,;:!?)\"'")


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def statistics(text: str | None) -> list[float]:
    """Bounded statistics of a whole text; an empty text has all zero but the first."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    w = words(text)
    count = Counter(w)
    lines = raw.split(b"\n")
    line_count = Counter(lines)
    upper, lower, digits = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum())
    space = int(c[9:14].sum() + c[32])
    letters = int(c[LETTERS].sum())
    symbols = n - letters - digits - space
    stops = int(c[[33, 46, 63]].sum())
    p = c[c > 0] / n if n else np.zeros(0)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    pairs = Counter(zip(w, w[1:]))
    top = count.most_common(3)
    repeats = sum(a == b for a, b in zip(w, w[1:]))
    alphabetic = sum(x.isalpha() or x[-1] in ENDS and x[:-1].isalpha() or x[0] > 127 for x in w)
    return [
        1.0 if not w else 0.0,
        math.log1p(n), math.log1p(len(w)), math.log1p(len(lines)),
        _ratio(lengths.sum(), len(w)) / 10, min(5.0, _ratio(lengths.max(), 40) if len(w) else 0.0),
        _ratio(upper, letters), _ratio(digits, n), _ratio(symbols, n), _ratio(space, n),
        _ratio(stops, len(w)), _ratio(int(c[44]), len(w)), _ratio(int(c[33]), len(w)),
        _ratio(int(c[[35, 36, 37, 38, 42, 64, 94, 126]].sum()), n), _ratio(int(c[[124, 60, 62, 91, 93, 123, 125, 92, 95]].sum()), n),
        _ratio(int(c[[47, 58, 61]].sum()), n), _ratio(int(c[128:].sum()), n),
        _ratio(len(count), len(w)), _ratio(len(count), math.sqrt(len(w)) if w else 0) / 20,
        _ratio(top[0][1] if top else 0, len(w)), _ratio(sum(x[1] for x in top), len(w)),
        _ratio(repeats, len(w)), _ratio(max(pairs.values(), default=0), len(w)),
        _ratio(len(pairs), max(len(w) - 1, 0)), _ratio(alphabetic, len(w)),
        _ratio(sum(v for k, v in line_count.items() if v > 1), len(lines)),
        float(-(p * np.log2(p)).sum()) / 8 if n else 0.0, _ratio(lower, letters),
    ]


N_STATS = len(statistics(""))


@dataclass
class QualityModel:
    """Standardised statistics, random Fourier features, ridge weights, isotonic steps."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([math.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase), z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Isotonic level, with a trace of the ridge score so that its order survives inside a step."""
        s = self.raw(x)
        level = np.interp(s, self.steps, self.levels)
        return np.clip(0.998 * level + 0.002 / (1 + np.exp(-4 * (s - 0.5))), 0.0, 1.0)


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` with an array column of the statistics of every whole text, however long.

    One row comes back per row, repeated ones too; none for an empty table.  A
    column of that ``name`` in the input is replaced.
    """
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([statistics(t) for t in texts], index=texts.index, dtype=object)

    return docs.withColumn(name, F.pandas_udf(measure, "array<double>")(F.col(f"`{text_col}`")))


def fit_quality(measured: DataFrame, label: str, id_col: str = "doc_id", stats: str = "stats",
                n_features: int = 256, width: float = 6.0, ridge: float = 1e-3,
                max_rows: int = 200_000, seed: int = 7) -> QualityModel:
    """Model of a 0/1 ``label`` column, fitted on at most about ``max_rows`` rows with statistics.

    Larger training sets are sampled by a hash of the id.  One third of the
    rows, again by hash, fits the isotonic steps; the rest fits ridge weights
    through normal equations summed within each partition, then over them.
    Rows without label do not take part; null texts count as empty.  With
    fewer than 20 rows, or one class only, every score is that class's rate
    (0.5 without rows).
    """
    rows = measured.select(F.col(f"`{stats}`").alias("x"), F.col(f"`{label}`").cast("double").alias("y"),
                           F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)).alias("h")).where(F.col("y").isin(0.0, 1.0))
    n, rate = rows.agg(F.count("*"), F.coalesce(F.avg("y"), F.lit(0.5))).first()
    if n > max_rows:
        rows = rows.where(F.pmod("h", F.lit(1_000_000)) < int(1e6 * max_rows / n))
    blank = QualityModel(np.zeros(N_STATS), np.ones(N_STATS), np.zeros((N_STATS, 1)), np.zeros(1),
                         np.zeros(N_STATS + 2), np.array([0.0]), np.array([float(rate)]))
    if rate in (0.0, 1.0) or n < 20:
        return blank
    measured = stored(rows, "quality")
    moments = measured.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v"), F.stddev_pop("v")).collect()
    mean, scale = np.zeros(N_STATS), np.ones(N_STATS)
    for i, m, s in moments:
        mean[i], scale[i] = m, s if s > 1e-9 else 1.0
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, scale, rng.normal(0, 1 / width, (N_STATS, n_features)),
                         rng.uniform(0, 2 * math.pi, n_features), np.zeros(n_features + N_STATS + 1),
                         np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    for_steps = F.pmod(F.xxhash64("h"), F.lit(3)) == 0

    def normal_equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            z = model.features(np.stack(f["x"])) if len(f) else None
            if z is not None:
                part = np.hstack([z.T @ z, (z.T @ f["y"].to_numpy())[:, None]])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"row": np.arange(len(total)), "v": list(total)})

    # Partial sums are added by matrix row, so no task holds more than a few of them.
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for f in frames:
            for row, v in zip(f["row"], f["v"]):
                total[row] = total[row] + v if row in total else np.array(v)
        if total:
            yield pd.DataFrame({"row": list(total), "v": list(total.values())})

    sums = (measured.where(~for_steps).mapInPandas(normal_equations, "row int, v array<double>")
            .repartition("row").mapInPandas(add, "row int, v array<double>").collect())
    gram = np.zeros((len(model.weights), len(model.weights) + 1))
    for row, v in sums:
        gram[row] += v
    count = gram[-1, -2]
    model.weights = np.linalg.solve(gram[:, :-1] + ridge * max(count, 1.0) * np.diag(
        [1.0] * n_features + [0.01] * N_STATS + [1e-9]), gram[:, -1])

    raw = F.pandas_udf(lambda x: pd.Series(model.raw(np.stack(x))), "double")
    steps = IsotonicRegression(featuresCol="s", labelCol="y").fit(
        measured.where(for_steps).select(raw("x").alias("s"), "y"))
    bounds, levels = np.array(steps.boundaries), np.array(steps.predictions)
    if len(bounds):
        model.steps, model.levels = bounds, levels
    return model


def score_statistics(measured: DataFrame, model: QualityModel, stats: str = "stats", score: str = "score") -> DataFrame:
    """``measured`` with a ``score`` column in 0..1 from the statistics."""
    shared = measured.sparkSession.sparkContext.broadcast(vars(model))

    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = QualityModel(**shared.value)
        for x in parts:
            yield pd.Series(model.score(np.array(x.tolist(), float).reshape(-1, N_STATS)), index=x.index, dtype=float)

    return measured.withColumn(score, F.pandas_udf(scored, "double")(F.col(f"`{stats}`")))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a ``score`` column in 0..1; null, empty and very long texts get a score too.

    Equal texts score equally; every row, repeated ones too, comes back once, and
    none of an empty table.  An input column named as ``score`` is replaced; all
    others are kept as they are.
    """
    stats = "_stats"
    while stats in docs.columns or stats == score:
        stats += "_"
    return score_statistics(with_statistics(docs, text_col, stats), model, stats, score).drop(stats)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))
