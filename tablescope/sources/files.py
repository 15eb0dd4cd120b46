"""File scans with format detection (S1-S6) and result sinks.

CSV follows pandas' reading rules: header row, a fixed set of NULL markers,
type inference (long -> double -> boolean -> string) decided by ONE
aggregate over the string-typed scan.  Which files are Latin-1, and which hold
quoted line breaks, is decided per file by an aggregate over the raw lines.
Files with quoted line breaks and JSON documents are cut into records by byte
ranges (``ranges``), so one large file is read by many tasks.
"""

from __future__ import annotations

import csv
import io
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import normalize_missing, numeric_text
from ..session import cut_lineage, scratch_folder
from . import ranges

# Extension -> format (the reference's detection table).
EXTENSIONS = {
    ".csv": "csv", ".xls": "excel", ".xlsx": "excel", ".json": "json", ".parquet": "parquet",
    ".feather": "feather", ".pickle": "pickle", ".pkl": "pickle", ".h5": "hdf",
    ".hdf5": "hdf", ".orc": "orc",
}
# Formats that only have single-machine decoders; not read by this library.
UNSUPPORTED = {"excel", "pickle", "hdf"}

# Strings pandas.read_csv treats as missing by default.
CSV_NULLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]
TRUE_WORDS = ["True", "TRUE", "true"]
FALSE_WORDS = ["False", "FALSE", "false"]
LONG_PATTERN = r"^\s*[+-]?\d+\s*$"


def detect_format(path: str) -> str:
    """Format name from the file extension; ``ValueError`` when unknown."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in EXTENSIONS:
        raise ValueError("Unable to detect file type")
    return EXTENSIONS[ext]


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               normalize: bool = False, spread: bool = False) -> DataFrame:
    """Read one table from ``path`` (S1-S5), picking the reader by extension.

    The scan is left bare, so filters and columns reach the files; operators
    treat NaN as missing themselves.  ``normalize`` replaces NaN by NULL in the
    table itself.

    ``spread``: when the scan yields fewer partitions than the cluster's
    default parallelism (e.g. one large row group), rows are dealt round-robin
    so the heavy per-row work downstream uses every core.  On big inputs with
    many splits this is a no-op.
    """
    fmt = fmt or detect_format(path)
    if fmt in UNSUPPORTED:
        raise ValueError(f"Unsupported file type: {fmt} (no distributed decoder)")
    if fmt == "csv":
        df = scan_csv(spark, path)
    elif fmt == "json":
        df = scan_json(spark, path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "orc":
        df = spark.read.orc(path)
    elif fmt == "feather":
        from .feather import scan_feather
        df = scan_feather(spark, path)
    else:
        raise ValueError(f"Unsupported file type: {fmt}")
    df = normalize_missing(df) if normalize else df
    return spread_partitions(df) if spread else df


def spread_partitions(df: DataFrame) -> DataFrame:
    """Round-robin repartition only when the input has fewer partitions than cores."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def _csv_groups(spark: SparkSession, path: str) -> dict[tuple[str, bool], list[str]]:
    """Files by (encoding, holds quoted line breaks), from one pass over their lines.

    A file is Latin-1 when some line is no valid UTF-8.  A line with an odd
    number of quotes opens or closes a field that goes on over the line's end;
    one with a quote amid a field may, whatever the number.  One small row per
    file comes back.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        (~F.is_valid_utf8("value")).alias("latin"),
        ((F.regexp_count(F.make_valid_utf8("value"), F.lit('"')) % 2 == 1)
         | F.make_valid_utf8("value").rlike('[^,"]"[^,"]')).alias("open"))
    groups: dict[tuple[str, bool], list[str]] = {}
    for r in lines.groupBy("file").agg(F.max("latin").alias("latin"), F.max("open").alias("open")
                                       ).orderBy("file").collect():
        groups.setdefault(("ISO-8859-1" if r["latin"] else "UTF-8", r["open"]), []).append(r["file"])
    return groups


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CSV_OPTIONS = {"escape": '"', "emptyValue": ""}


def _quoted_csv(spark: SparkSession, files: list[str], encoding: str) -> list[DataFrame]:
    """Files with quoted line breaks, cut into records by range; one frame per header."""
    lines = ranges.text_ranges(spark, files, "\n")
    states = cut_lineage(ranges.csv_entry_states(lines))
    records = ranges.joined_pieces(_written(ranges.csv_pieces(lines, states, encoding), "csv-records"))
    headers: dict[tuple[str, ...], list[int]] = {}
    for r in records.where("first").select("file", "text").orderBy("file").collect():  # one row per file
        names = next(csv.reader(io.StringIO(r["text"].removeprefix("\ufeff"), newline="")))
        headers.setdefault(tuple(names), []).append(r["file"])
    out = []
    for names, numbers in headers.items():
        schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
        row = F.from_csv("text", schema.simpleString()[len("struct<"):-1].replace(":", " "), {**CSV_OPTIONS, "multiLine": "true"})
        out.append(records.where(F.col("file").isin(numbers) & ~F.col("first")).select(row.alias("r"))
                   .select(*[F.col(f"r._{i}").alias(n) for i, n in enumerate(names)]))
    return out


def _csv_strings(spark: SparkSession, path: str) -> DataFrame:
    parts = []
    for (encoding, quoted), files in _csv_groups(spark, path).items():
        if quoted:
            parts += _quoted_csv(spark, files, encoding)
        else:
            parts.append(spark.read.option("header", True).option("encoding", encoding)
                         .option("inferSchema", False).options(**CSV_OPTIONS).option("nullValue", None).csv(files))
    if not parts:
        return spark.read.option("header", True).csv(path)
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p, allowMissingColumns=True)
    nulls = F.array(*[F.lit(x) for x in CSV_NULLS])
    return raw.select(*[F.when(F.array_contains(nulls, F.col(f"`{c}`")), F.lit(None))
                        .otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1 + C2: CSV with pandas-style NULL markers and type inference.

    Files are split among tasks, those with quoted line breaks too; each file
    is read in its own encoding.
    """
    df = _csv_strings(spark, path)
    return _apply_inference(df, df.columns, _infer(df))


def _infer(df: DataFrame):
    checks = []
    for i, c in enumerate(df.columns):
        s = F.col(f"`{c}`")
        nn = s.isNotNull()
        long = F.when(s.rlike(LONG_PATTERN), F.trim(s).try_cast("long"))  # 20 digits are no long
        checks += [F.count(s).alias(f"n{i}"),
                   F.count(F.when(nn & long.isNull(), 1)).alias(f"nl{i}"),
                   F.count(F.when(nn & numeric_text(s).isNull(), 1)).alias(f"nd{i}"),
                   F.count(F.when(nn & ~s.isin(TRUE_WORDS + FALSE_WORDS), 1)).alias(f"nb{i}")]
    return df.agg(F.count(F.lit(1)).alias("_rows"), *checks).collect()[0]


def _apply_inference(df: DataFrame, cols: list[str], stats) -> DataFrame:
    rows = stats["_rows"]
    out: list[Column] = []
    for i, c in enumerate(cols):
        s = F.col(f"`{c}`")
        n = stats[f"n{i}"]
        if n == 0:
            out.append(F.lit(None).cast("double").alias(c))       # all missing -> float
        elif stats[f"nl{i}"] == 0 and n == rows:
            out.append(F.trim(s).cast("long").alias(c))
        elif stats[f"nd{i}"] == 0:
            out.append(numeric_text(s).alias(c))
        elif stats[f"nb{i}"] == 0 and n == rows:
            out.append(s.isin(TRUE_WORDS).alias(c))
        else:
            out.append(s.alias(c))
    return df.select(*out)


def _object_lines(spark: SparkSession, path: str, longest: int = 1 << 20) -> tuple[list[str], list[str]]:
    """Files that hold one JSON object per line, and the other files that hold anything.

    When all lines start with ``{`` and end with ``}`` and there are several, an
    object ends with every line, since no comma parts them.  The reader passes
    over lines of more than ``longest`` bytes without holding them; a file's
    size tells that it did, and such a file is not judged by its lines.
    """
    text = F.trim(F.translate("value", "\t\r", "  "))
    lines = spark.read.option("lineSep", "\n").option("mapreduce.input.linerecordreader.line.maxlength", longest).text(path)
    found = lines.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).agg(
        F.sum(F.octet_length("value") + 1).alias("read"), F.count_if(text != "").alias("n"),
        F.count_if(text.startswith("{") & text.endswith("}")).alias("objects")).collect()
    # A file whose only line was passed over has no row.
    every = {r["file"]: None for r in ranges.file_numbers(spark, path).select(F.col("path").alias("file")).collect()}
    every |= {r["file"]: r for r in found}
    plain = {f for f, r in every.items() if r and r["n"] == r["objects"] > 1 and r["read"] - r["size"] in (0, 1)}
    return sorted(plain), sorted(f for f, r in every.items() if f not in plain and (r is None or r["n"] or r["read"] < r["size"]))


def _json_groups(spark: SparkSession, path: str) -> tuple[dict[str, list[str]], DataFrame, DataFrame | None]:
    """Files by layout, the entry states of their byte ranges, and the counts of ranges of objects.

    ``lines``: one object per line; ``array``: one array of records; ``objects``:
    objects over several lines; ``columns``: one object whose values are all
    objects; ``other``: none of these.  One small row per file comes back.
    """
    plain, files = _object_lines(spark, path)
    if not files:
        return ({"lines": plain} if plain else {}), None, None
    cut = ranges.text_ranges(spark, files, ",")
    states = cut_lineage(ranges.json_entry_states(cut))
    paths = {r["file"]: r["path"] for r in ranges.file_numbers(spark, files).collect()}
    heads = {r["file"]: r["head"] for r in states.where("head IS NOT NULL").groupBy("file").agg(
        F.min_by("head", "start").alias("head")).collect()}
    groups: dict[str, list[str]] = {"lines": plain} if plain else {}
    objects = []
    for number, head in sorted(heads.items(), key=lambda x: paths[x[0]]):
        if head == "{":
            objects.append(paths[number])
        else:
            groups.setdefault("array" if head == "[" else "other", []).append(paths[number])
    counts = None
    if objects:
        counts = cut_lineage(ranges.json_layouts(ranges.text_ranges(spark, objects, ","), states))
        per = {paths[r["file"]]: r for r in counts.groupBy("file").agg(
            *[F.sum(c).alias(c) for c in ("tops", "keys", "opens", "breaks")]).collect()}
        for file in objects:
            r = per[file]
            layout = ("columns" if r["tops"] == 1 and r["keys"] == r["opens"] > 0 else "lines" if not r["breaks"] else "objects")
            groups.setdefault(layout, []).append(file)
    return groups, states, counts


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON as pandas reads it; the layout is found per file.

    * newline-delimited records -> line reader (splits across tasks);
    * an array of records, or records over several lines -> cut into one
      record per line by all ranges of the file, then the line reader;
    * a column-oriented object ``{column: {index: value}}`` -> cut into cells
      ``(file, column, index, value)``, pivoted back to one row per file and
      index, then typed by the same inference pass as CSV.
    """
    groups, states, counts = _json_groups(spark, path)
    parts = []
    if "lines" in groups:
        parts.append(spark.read.json(groups["lines"]))
    for layout in ("array", "objects"):
        if layout in groups:
            parts.append(_record_json(spark, groups[layout], states, layout))
    if "other" in groups:
        parts.append(spark.read.json(groups["other"], multiLine=True))
    if "columns" in groups:
        parts.append(_columns_json(spark, groups["columns"], states, counts))
    if not parts:
        return spark.read.json(path)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _record_json(spark: SparkSession, files: list[str], states: DataFrame, layout: str) -> DataFrame:
    pieces = ranges.json_pieces(ranges.text_ranges(spark, files, ","), states.withColumn("opens", F.lit(0).cast("long")), layout)
    records = ranges.joined_pieces(_written(pieces, "json-pieces")).where(~F.col("text").rlike(r"^[\s,]*$"))
    # A line break between tokens is a blank; inside a JSON text none may stand.
    folder = scratch_folder(spark, "json-records")
    records.select(F.translate("text", "\r\n", "  ").alias("value")).write.text(folder)
    return spark.read.json(folder)


def _columns_json(spark: SparkSession, files: list[str], states: DataFrame, counts: DataFrame) -> DataFrame:
    """``{column: {index: value}}`` -> rows ordered by file and index, typed by inference."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opens = counts.select("file", "start", F.coalesce(F.sum("opens").over(before), F.lit(0)).alias("opens"))
    pieces = ranges.json_pieces(ranges.text_ranges(spark, files, ","), states.join(opens, ["file", "start"]), "columns")
    pieces = ranges.joined_pieces(_written(pieces, "json-cells"))
    object_of = lambda *parts: F.from_json(F.concat(F.lit("{"), *parts, F.lit("}")), "map<string, string>")
    # One row per column and file.
    keys = cut_lineage(pieces.where("level = 1").select("file", F.col("column").alias("pos"), F.element_at(
        F.map_keys(object_of("text", F.lit("0"))), 1).alias("column")).where("column IS NOT NULL")
        .join(ranges.file_numbers(spark, files), "file"))
    names = [r["column"] for r in keys.groupBy("column").agg(F.min(F.struct("path", "pos")).alias("at"))
             .orderBy("at").collect()]
    # A cell counts the columns opened before it, its own too.
    cells = (pieces.where("level = 2").select("file", (F.col("column") - 1).alias("pos"), F.explode(object_of("text")).alias("idx", "val"))
             .join(F.broadcast(keys), ["file", "pos"]))
    # Written once: the inference, the order's range sample and the result all read it.
    wide = cut_lineage(cells.groupBy("path", "idx").pivot("column", names).agg(F.first("val")))
    # Row order follows the index (numeric when it is numeric, as pandas does).
    ordered = wide.orderBy("path", F.col("idx").try_cast("long"), "idx").drop("path", "idx")
    return _apply_inference(ordered, names, _infer(wide.drop("path", "idx")))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return read_table(spark, path, "parquet")


def scan_orc(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return read_table(spark, path, "orc")


# -- sinks --------------------------------------------------------------------

def result_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; timestamps/intervals as strings, NaN as null."""
    fixed = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType,
                                   T.DayTimeIntervalType, T.YearMonthIntervalType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        fixed.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*fixed), {"ignoreNullFields": "false"}).alias("json"))


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Persist a result table (parquet/json/csv/orc) and return the path."""
    writer = df.write.mode(mode)
    if fmt == "json":
        result_json(df).write.mode(mode).text(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("parquet", "orc"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"Unsupported sink format: {fmt}")
    return path
