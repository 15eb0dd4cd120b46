"""Frame-level building blocks: long form, global row index, exact quantiles.

Scale notes
-----------
* Per-column statistics are computed on the *long form* ``(column, v)`` so
  that one ``groupBy`` handles every column instead of one job per column.
* Nothing here gathers a whole column into one task.  Exact order statistics
  come from radix selection: counts of leading bits, refined only where a
  wanted rank lies, so nothing is sorted and only counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import as_double, is_numeric_type
from ..session import cut_lineage

KEY = "column_name"
VALUE = "v"


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns in schema order (booleans excluded)."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def resolve_columns(df: DataFrame, columns: Sequence[str] | str | None,
                    numeric: bool = True) -> list[str]:
    """Validate requested columns (P8) or default to all numeric ones."""
    if columns is None:
        return numeric_columns(df) if numeric else list(df.columns)
    if isinstance(columns, str):
        columns = [columns]
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in columns:
        if c not in types:
            raise ValueError(f"Column {c} not found in dataset")
        if numeric and not is_numeric_type(types[c]):
            raise ValueError(f"Column {c} is not numeric")
    return list(columns)


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def long_form(df: DataFrame, columns: Sequence[str] | None = None,
              ids: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric ``columns`` to ``(*ids, column, v double)``; NaN -> NULL."""
    cols = resolve_columns(df, columns)
    if not cols:
        raise ValueError("No numeric column available for analysis")
    types = {f.name: f.dataType for f in df.schema.fields}
    wide = df.select(*[F.col(f"`{i}`") for i in ids],
                     *[as_double(c, types[c]).alias(c) for c in cols])
    return wide.unpivot([F.col(f"`{i}`") for i in ids], [F.col(f"`{c}`") for c in cols],
                        KEY, VALUE)


def distinct_counts(long_df: DataFrame, key: str = KEY, value: str = VALUE) -> DataFrame:
    """``(key, value, cnt)`` for non-null values.  Map-side combine absorbs hot values."""
    return (long_df.where(F.col(value).isNotNull())
            .groupBy(key, value).agg(F.count(F.lit(1)).alias("cnt")))


def with_row_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "idx",
                   partitions: int | None = None) -> DataFrame:
    """Append a global 0-based position in ``order_by`` order.

    The caller must give a total order (a unique key last).  Range partitioning
    spreads the sort; the sorted frame is checkpointed so partition ids and the
    order inside each partition are stable; ``monotonically_increasing_id``
    then yields (partition id, position in partition) and the per-partition
    counts (one row per partition) give the offsets.
    """
    order = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order_by]
    p = _partitions(df, partitions)
    ordered = cut_lineage(df.repartitionByRange(p, *order).sortWithinPartitions(*order))
    mid = F.monotonically_increasing_id()
    tagged = ordered.withColumns({"_pid": F.shiftright(mid, 33),
                                  "_pos": mid.bitwiseAND(F.lit((1 << 33) - 1))})
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: bounded by the partition count we chose.
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (tagged.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .withColumn(name, F.col("_off") + F.col("_pos"))
            .drop("_pid", "_pos", "_off"))


#: FAN * FAN buckets between sampled splitters; keys sampled per round; rows sorted at once.
FAN = 32
SAMPLED_KEYS = 16 * FAN * FAN
SORTED_ROWS = 1_000_000


def _bucketed(df: DataFrame, key: Column, splitters: str, most: int) -> DataFrame:
    """Add ``_b``, how many of at most ``most`` splitters are not above ``key``, by binary search.

    One column per halving: plain compiled comparisons, no function over the
    whole array of splitters for every row.
    """
    df = df.withColumn("_b", F.lit(0))
    for step in (1 << i for i in reversed(range(most.bit_length()))):
        # Beyond the last splitter there is none (null), so the step is not taken.
        up = F.get(F.col(splitters), F.col("_b") + (step - 1)) <= key
        df = df.withColumn("_b", F.col("_b") + F.when(up, step).otherwise(0))
    return df


def rows_at_steps(df: DataFrame, order_by: Sequence[str], step: int, m: int, n: int,
                  name: str = "idx") -> DataFrame:
    """Rows at positions 0, step, 2 * step, ... (first ``m``) of ``n`` rows in ``order_by`` order.

    Multi-rank selection: splitters from a bounded sample of keys cut the order
    into buckets, one pass counts them, and only buckets that hold a wanted
    position stay; again until few rows are left, which alone are sorted.  The
    sample decides only where buckets end, never which rows come back.  As for
    :func:`with_row_index` the order must be total; rows of equal keys share a
    bucket and take its positions in any order.
    """
    key = F.struct(*[F.col(f"`{c}`") for c in order_by])
    # A bucket is named by the position of its first row.
    kept, left = df.withColumn("_at", F.lit(0).cast("long")), n
    while left > SORTED_ROWS:
        sample = kept.sample(min(1.0, SAMPLED_KEYS / left), seed=7).agg(F.sort_array(F.collect_list(key)).alias("_s"))
        cut = F.transform(F.sequence(F.lit(1), F.lit(FAN * FAN - 1)), lambda i: F.element_at(
            "_s", F.floor(i * F.size("_s") / (FAN * FAN)).cast("int") + 1))
        # One row: the splitters, the same for the counting and the choosing pass.
        splitters = cut_lineage(sample.where(F.size("_s") > 0).select(cut.alias("_c")))
        marked = _bucketed(kept.join(F.broadcast(splitters), how="left"), key, "_c", FAN * FAN - 1).drop("_c")
        # At most FAN * FAN buckets in each of the at most m kept ones.
        counts = cut_lineage(marked.groupBy("_at", "_b").agg(F.count(F.lit(1)).alias("_n")))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("_at").orderBy("_b").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("_to", F.col("_at") + before)
        wanted = F.ceil(F.col("_to") / step) * step
        chosen = cut_lineage(placed.where((wanted < F.col("_to") + F.col("_n")) & (wanted < step * m))
                             .select("_at", "_b", "_n", "_to"))
        now = chosen.agg(F.sum("_n")).first()[0]
        # Written once, so later rounds and the sort read the kept rows only.
        kept = cut_lineage(marked.join(F.broadcast(chosen.drop("_n")), ["_at", "_b"])
                           .drop("_at", "_b").withColumnRenamed("_to", "_at"))
        stuck, left = now > left // 2, now
        if stuck:
            break
    # Kept buckets follow each other in key order, so a bucket's rows are one run of positions.
    sorted_rows = with_row_index(kept, order_by, "_pos_kept")
    firsts = sorted_rows.groupBy("_at").agg(F.min("_pos_kept").alias("_first"))
    position = F.col("_at") + F.col("_pos_kept") - F.col("_first")
    return (sorted_rows.join(F.broadcast(firsts), "_at").withColumn(name, position)
            .where((F.col(name) % step == 0) & (F.col(name) < step * m))
            .drop("_at", "_pos_kept", "_first"))


#: Sub-buckets into which a pass cuts the range of a bucket that holds a wanted rank.
SPLIT = 4096


def _leading(v: Column) -> Column:
    """Bucket of a double by its leading bits: sign, exponent, and half of it.

    Never falls as the value rises; zero has its own bucket, and values of one
    bucket differ by less than a factor of 1.5, so equal steps part them well.
    """
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * 2.0 + 2200.0).cast("int")
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size)


def values_at_ranks(long_df: DataFrame, ranks: DataFrame, key: str = KEY,
                    value: str = VALUE) -> DataFrame:
    """Value at 0-based rank ``_r`` (ascending, nulls excluded) per key.

    Radix selection: one pass counts the buckets of leading bits, each further
    pass only rows in buckets that hold a wanted rank, cut by equal steps
    between their least and greatest value, until such a bucket holds one
    value.  Nothing is sorted, and only bucket counts are shuffled (combined
    map-side, at most a few thousand per key, task and wanted bucket).

    ``ranks`` has columns ``(key, _r)`` and must be small (a few ranks per key);
    so is what the driver holds: one bucket per wanted rank.  Returns
    ``(key, _r, value)``.
    """
    spark = long_df.sparkSession
    kind = long_df.schema[key].dataType.simpleString()
    wanted = [(r[0], r[1]) for r in ranks.select(key, "_r").distinct().collect()]
    v = F.col(value) + 0.0                                   # one zero
    rows = long_df.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), v.alias("_v"))
    found: list[tuple] = []
    counts = rows.withColumn("_n", F.lit(0)).groupBy("_k", "_n", _leading(F.col("_v")).alias("_b"))
    # Buckets of the last pass that hold wanted ranks: (key, number) -> [(rank, rank within)].
    open_ranks = {}
    for k, r in wanted:
        open_ranks.setdefault((k, 0), []).append((r, r))
    while open_ranks:
        held = spark.createDataFrame([(k, n, r, at) for (k, n), rs in open_ranks.items() for r, at in rs],
                                     f"_k {kind}, _n int, _r long, _at long")
        upto = Window.partitionBy("_k", "_n").orderBy("_b")
        per = (counts.agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
               .withColumn("_end", F.sum("_c").over(upto)))
        hits = per.join(F.broadcast(held), ["_k", "_n"]).where(
            (F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_c"))).select(
            "_k", "_r", (F.col("_at") - F.col("_end") + F.col("_c")).alias("_at"), "_lo", "_hi").collect()
        spans: dict[tuple, list] = {}
        for h in hits:
            if h["_lo"] == h["_hi"]:
                found.append((h["_k"], h["_r"], h["_lo"]))
            else:
                spans.setdefault((h["_k"], h["_lo"], h["_hi"]), []).append((h["_r"], h["_at"]))
        open_ranks = {(k, n): rs for n, ((k, _, _), rs) in enumerate(spans.items())}
        if spans:
            cuts = spark.createDataFrame([(k, n, lo, hi) for n, (k, lo, hi) in enumerate(spans)],
                                         f"_k {kind}, _n int, _lo double, _hi double")
            step = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SPLIT), F.lit(SPLIT - 1))
            counts = (rows.join(F.broadcast(cuts), "_k").where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
                      .select("_k", "_n", "_v", step.cast("int").alias("_b")).groupBy("_k", "_n", "_b"))
    return spark.createDataFrame(found, f"`{key}` {kind}, _r long, `{value}` double")


def exact_quantiles(long_df: DataFrame, probs: Sequence[float], key: str = KEY,
                    value: str = VALUE, counts: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per key -> ``(key, p, q)``.

    Same definition as Spark ``percentile``, DuckDB ``quantile_cont`` and
    pandas ``quantile``.  ``counts`` may pass precomputed ``(key, n)``.
    """
    if counts is None:
        counts = long_df.where(F.col(value).isNotNull()).groupBy(key).agg(
            F.count(F.lit(1)).alias("n"))
    plist = F.array(*[F.lit(float(p)) for p in probs])
    targets = (counts.where(F.col("n") > 0).withColumn("p", F.explode(plist))
               .withColumn("_pos", F.col("p") * (F.col("n") - 1))
               .withColumn("_lo", F.floor("_pos").cast("long"))
               .withColumn("_hi", F.ceil("_pos").cast("long")))
    ranks = targets.select(key, F.explode(F.array("_lo", "_hi")).alias("_r")).distinct()
    found = values_at_ranks(long_df, ranks, key, value)
    lo = found.select(key, F.col("_r").alias("_lo"), F.col(value).alias("_vlo"))
    hi = found.select(key, F.col("_r").alias("_hi"), F.col(value).alias("_vhi"))
    return (targets.join(lo, [key, "_lo"]).join(hi, [key, "_hi"])
            .select(key, "p", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo"))
                               * (F.col("_pos") - F.col("_lo"))).alias("q")))


def approx_quantiles(long_df: DataFrame, probs: Sequence[float], key: str = KEY,
                     value: str = VALUE, accuracy: int = 10000) -> DataFrame:
    """Sketch-based quantiles (bounded memory, one pass) -> ``(key, p, q)``."""
    arr = F.percentile_approx(value, list(map(float, probs)), accuracy)
    plist = F.array(*[F.lit(float(p)) for p in probs])
    res = long_df.groupBy(key).agg(arr.alias("_qs"))
    return res.select(key, F.inline(F.arrays_zip(plist.alias("p"), F.col("_qs").alias("q"))))\
        .select(key, "p", F.col("q").cast("double").alias("q"))


def quantile_table(long_df: DataFrame, named_probs: dict[str, float], key: str = KEY,
                   value: str = VALUE, approx: bool = False,
                   counts: DataFrame | None = None) -> DataFrame:
    """Wide ``(key, <name>...)`` quantiles, e.g. ``{'q1': .25, 'median': .5}``."""
    probs = sorted(set(named_probs.values()))
    q = (approx_quantiles(long_df, probs, key, value) if approx
         else exact_quantiles(long_df, probs, key, value, counts=counts))
    return q.groupBy(key).agg(*[
        F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(name)
        for name, p in named_probs.items()])


def value_family(dt: T.DataType) -> str:
    """The type in which values of a column are compared exactly."""
    if isinstance(dt, T.IntegralType):
        return "long"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dt, T.DecimalType):
        return dt.simpleString()
    return "text"


def native_value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, v double, text, cnt)`` of non-missing numeric values.

    Values are grouped in their own type family, so integers and decimals that
    are one double stay apart; ``text`` is the exact value.
    """
    cols = resolve_columns(df, columns)
    if not cols:
        raise ValueError("No numeric column available for analysis")
    types = {f.name: f.dataType for f in df.schema.fields}
    families: dict[str, list[str]] = {}
    for c in cols:
        families.setdefault(value_family(types[c]), []).append(c)
    out = None
    for kind, names in families.items():
        value = {c: as_double(c, types[c]) if kind == "double" else F.col(f"`{c}`").cast(kind)
                 for c in names}
        part = distinct_counts(df.select(*[v.alias(c) for c, v in value.items()]).unpivot(
            [], [F.col(f"`{c}`") for c in names], KEY, VALUE))
        part = part.select(KEY, F.col(VALUE).cast("double").alias(VALUE),
                           F.col(VALUE).cast("string").alias("text"), "cnt",
                           (F.col(VALUE).cast("decimal(38,10)") if kind != "double"
                            else F.lit(None).cast("decimal(38,10)")).alias("exact"))
        out = part if out is None else out.unionByName(part)
    return out


def mode_table(counts: DataFrame) -> DataFrame:
    """Most frequent value per column, smallest on ties -> ``(column_name, mode, mode_text)``."""
    best = F.max(F.struct(F.col("cnt"), (-F.col(VALUE)).alias("_neg"), (-F.col("exact")).alias("_fine"),
                          F.col("text")))
    return counts.groupBy(KEY).agg(best.alias("_b")).select(
        KEY, (-F.col("_b._neg")).alias("mode"), F.col("_b.text").alias("mode_text"))
