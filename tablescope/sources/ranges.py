"""Records of large text files cut by many tasks.

A JSON document or a CSV file with quoted line breaks has no byte at which a
reader may safely start.  Here every byte range of a file is first summarised
for each state it may be entered in (inside a string or not); the summaries of
the ranges before it give each range its true entry state, and then all ranges
cut their records at once.  Only the two pieces of a record that crosses a
range border meet again, by the number of that border.

Ranges are the splits of Spark's text reader, so they follow
``spark.sql.files.maxPartitionBytes`` and read from any store.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The functions below travel to the Python workers by value, which need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Classes of the bytes that make up a JSON document's structure.
OPEN, CLOSE, OPEN_LIST, CLOSE_LIST, COMMA, COLON, BREAK = range(1, 8)
_CLASS = np.zeros(256, np.int8)
for _byte, _class in zip(b"{}[],:\n", (OPEN, CLOSE, OPEN_LIST, CLOSE_LIST, COMMA, COLON, BREAK)):
    _CLASS[_byte] = _class
_STEP = np.array([0, 1, -1, 1, -1, 0, 0, 0], np.int64)

PIECE = "file long, start long, place int, level int, column long, cut boolean, text string"
# Places of a piece: whole inside its range, before the range's first cut, after its last cut.
WHOLE, HEAD, TAIL = range(3)


def text_ranges(spark: SparkSession, files: list[str], sep: str) -> DataFrame:
    """(file, start, value): the text between separators, in order within each range of a file."""
    return spark.read.option("lineSep", sep).text(files).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"))


def file_numbers(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """(file, path) of the numbers that stand for files in ``text_ranges``; the files are listed, not read."""
    return spark.read.format("binaryFile").load(files).select(F.col("_metadata.file_path").alias("path")).select(
        F.xxhash64("path").alias("file"), "path")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes]]]:
    """((file, start, ...), values) for each stretch of a batch that belongs to one range."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), n]
        values = batch.column(2).to_pylist()
        for a, b in zip(edges, edges[1:]):
            yield tuple(batch.column(i)[a].as_py() for i in range(batch.num_columns) if i != 2), values[a:b]


def _structure(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Position, class and quotes before (modulo 2) of the structural bytes, and the number of quotes.

    ``data`` starts after a comma, so no escape reaches into it.
    """
    a = np.frombuffer(data, np.uint8)
    quote = a == 34
    if b"\\" in data:
        at = np.flatnonzero(quote)
        plain = np.maximum.accumulate(np.where(a != 92, np.arange(len(a)), -1))
        run = np.where(at > 0, at - 1 - plain[np.maximum(at - 1, 0)], 0)
        quote[at[run % 2 == 1]] = False
    kinds = _CLASS[a]
    at = np.flatnonzero(kinds)
    before = np.cumsum(quote, dtype=np.int64)
    return at, kinds[at], before[at] & 1, int(before[-1]) if len(a) else 0


def json_entry_states(ranges: DataFrame) -> DataFrame:
    """(file, start, inside, depth, head): how each range is entered, and its first byte that is not blank."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row = None, None
        for (file, start), values in _runs(batches):
            if (file, start) != now:
                if row:
                    yield pa.RecordBatch.from_pylist([row])
                now, row = (file, start), {"file": file, "start": start, "quotes": 0, "outside": 0, "inside": 0, "head": None}
            data = b",".join(values) + b","
            _, kinds, odd, quotes = _structure(data)
            step, odd = _STEP[kinds], odd ^ (row["quotes"] & 1)
            row["outside"] += int(step[odd == 0].sum())  # entered outside a string
            row["inside"] += int(step[odd == 1].sum())
            row["quotes"] += quotes
            if row["head"] is None:
                row["head"] = data.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1") or None
        if row:
            yield pa.RecordBatch.from_pylist([row])

    found = ranges.mapInArrow(summarise, "file long, start long, quotes long, outside long, inside long, head string")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    found = found.withColumn("odd", earlier("quotes") % 2)
    return (found.withColumn("change", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
            .select("file", "start", (F.col("odd") == 1).alias("inside"), earlier("change").alias("depth"), "head"))


def _entered(ranges: DataFrame, states: DataFrame) -> DataFrame:
    """Ranges with their entry states, one row per range of a file: small enough for every task."""
    return ranges.join(F.broadcast(states), ["file", "start"]).select("file", "start", "value", *[
        c for c in states.columns if c not in ("file", "start")])


def json_layouts(ranges: DataFrame, states: DataFrame) -> DataFrame:
    """(file, start, tops, keys, opens, breaks) of each range.

    Objects at the top, keys and objects one level below, and line ends within
    the top objects.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, inside, depth = None, None, 0, 0
        for (file, start, entered, level), values in _runs(batches):
            if (file, start) != now:
                if row:
                    yield pa.RecordBatch.from_pylist([row])
                now, inside, depth = (file, start), int(entered), level
                row = {"file": file, "start": start, "tops": 0, "keys": 0, "opens": 0, "breaks": 0}
            _, kinds, odd, quotes = _structure(b",".join(values) + b",")
            kinds = kinds[odd == inside]
            step = _STEP[kinds]
            before = depth + np.cumsum(step) - step
            row["tops"] += int(((kinds == OPEN) & (before == 0)).sum())
            row["keys"] += int(((kinds == COLON) & (before == 1)).sum())
            row["opens"] += int(((kinds == OPEN) & (before == 1)).sum())
            row["breaks"] += int(((kinds == BREAK) & (before > 0)).sum())
            inside, depth = inside ^ (quotes & 1), depth + int(step.sum())
        if row:
            yield pa.RecordBatch.from_pylist([row])

    return _entered(ranges, states.select("file", "start", "inside", "depth")).mapInArrow(
        count, "file long, start long, tops long, keys long, opens long, breaks long")


def _array_cuts(kinds: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return ((kinds == OPEN_LIST) & (before == 0)) | ((kinds == COMMA) & (before == 1)) | ((kinds == CLOSE_LIST) & (after == 0))


def _object_cuts(kinds: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (kinds == CLOSE) & (after == 0)


def _column_cuts(kinds: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (((kinds == OPEN) & (before <= 1)) | ((kinds == COMMA) & (before >= 1) & (before <= 2))
            | ((kinds == CLOSE) & (after <= 1)))


JSON_CUTS: dict[str, Callable] = {"array": _array_cuts, "objects": _object_cuts, "columns": _column_cuts}


class _Pieces:
    """Collects the pieces of ranges into record batches."""

    def __init__(self, file: int, start: int):
        self.file, self.start, self.held, self.cut = file, start, [], False
        self.rows: list[tuple] = []

    def end(self, text: bytes, level: int, column: int) -> None:
        """A piece ends in a cut."""
        if self.held:
            text = b"".join([*self.held, text])
            self.held = []
        if self.cut:
            if text.strip():
                self.rows.append((self.file, self.start, WHOLE, level, column, True, text))
        else:  # goes on from the range before
            self.rows.append((self.file, self.start, HEAD, level, column, True, text))
            self.cut = True

    def close(self) -> None:
        self.rows.append((self.file, self.start, TAIL if self.cut else HEAD, -1, -1, False, b"".join(self.held)))
        self.held = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows))
        self.rows = []
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
        text = pa.array([t.decode("utf-8", "replace") for t in columns[6]], pa.string())
        return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types)], text],
                                          names=[c.split()[0] for c in PIECE.split(", ")])


def json_pieces(ranges: DataFrame, states: DataFrame, layout: str) -> DataFrame:
    """Pieces of documents of one ``layout`` (array, objects, columns); ``states`` also has ``opens`` before each range."""
    cuts, keep = JSON_CUTS[layout], int(layout == "objects")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, inside, depth, column = None, None, 0, 0, 0
        for (file, start, entered, level, opens), values in _runs(batches):
            if (file, start) != now:
                if pieces:
                    pieces.close()
                    yield pieces.batch()
                now, pieces, inside, depth, column = (file, start), _Pieces(file, start), int(entered), level, opens
            data = b",".join(values) + b","
            if not start and not pieces.rows and not pieces.held:
                data = data.removeprefix(b"\xef\xbb\xbf")
            at, kinds, odd, quotes = _structure(data)
            at, kinds = at[odd == inside], kinds[odd == inside]
            step = _STEP[kinds]
            after = depth + np.cumsum(step)
            chosen = np.flatnonzero(cuts(kinds, after - step, after))
            inner = (kinds == OPEN) & (after == 2)
            columns = column + np.cumsum(inner) - inner
            low = 0
            for p, b, c in zip(at[chosen].tolist(), (after - step)[chosen].tolist(), columns[chosen].tolist()):
                pieces.end(data[low:p + keep], b, c)
                low = p + 1
            pieces.held.append(data[low:])
            inside, depth, column = inside ^ (quotes & 1), depth + int(step.sum()), column + int(inner.sum())
            if len(pieces.rows) >= 10_000:
                yield pieces.batch()
        if pieces:
            pieces.close()
            yield pieces.batch()

    return _entered(ranges, states.select("file", "start", "inside", "depth", "opens")).mapInArrow(cut, PIECE)


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """(file, level, column, text, first): whole pieces, and those that cross borders put together.

    ``first`` marks what comes before a file's first cut.

    ``pieces`` is read twice and should be a written table.  Per range one or
    two border pieces are grouped; a group is one record.
    """
    border = pieces.where(F.col("place") != WHOLE)
    before = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, -1)
    # A head with a cut ends a record, so it counts for all that follow it.
    number = F.coalesce(F.sum(F.col("cut").cast("int")).over(before), F.lit(0))
    met = (border.withColumn("number", number).groupBy("file", "number").agg(
        F.max("level").alias("level"), F.max("column").alias("column"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "text"))), lambda x: x["text"]), "").alias("text"))
        .where(F.col("text").rlike(r"\S")).withColumn("first", F.col("number") == 0))
    names = ["file", "level", "column", "text", "first"]
    return pieces.where(F.col("place") == WHOLE).withColumn("first", F.lit(False)).select(names).unionByName(met.select(names))


# -- CSV

def _quoted_after(line: bytes, quoted: bool) -> bool:
    """Whether a line ends inside a quoted field; a quote opens a field only at its start."""
    at = 0
    if not quoted and not line.startswith(b'"'):
        at = line.find(b',"') + 1
        if not at:
            return False
    at += not quoted
    while True:
        at = line.find(b'"', at)
        if at < 0:
            return True
        if line[at + 1:at + 2] == b'"':
            at += 2
            continue
        at = line.find(b',"', at + 1) + 2
        if at < 2:
            return False


def csv_entry_states(ranges: DataFrame) -> DataFrame:
    """(file, start, quoted): whether each range starts inside a quoted field."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row = None, None
        for (file, start), values in _runs(batches):
            if (file, start) != now:
                if row:
                    yield pa.RecordBatch.from_pylist([row])
                now, row = (file, start), {"file": file, "start": start, "fresh": False, "quoted": True}
            for line in values:
                if b'"' in line:
                    same = row["fresh"] == row["quoted"]
                    row["fresh"] = _quoted_after(line, row["fresh"])
                    row["quoted"] = row["fresh"] if same else _quoted_after(line, row["quoted"])
        if row:
            yield pa.RecordBatch.from_pylist([row])

    found = ranges.mapInArrow(summarise, "file long, start long, fresh boolean, quoted boolean")
    # A range whose two ends agree fixes the state after it; one whose ends swap turns it.
    order = Window.partitionBy("file").orderBy("start")
    swap = (F.col("fresh") & ~F.col("quoted")).cast("int")
    found = found.withColumn("turns", F.sum(swap).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("fresh") == F.col("quoted"), F.struct(F.col("fresh").cast("int").alias("state"), "turns"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("fixed", F.last(fixed, ignorenulls=True).over(before)).withColumn(
        "earlier", F.coalesce(F.max("turns").over(before), F.lit(0)))
    state = F.coalesce(F.col("fixed.state"), F.lit(0)) + F.col("earlier") - F.coalesce(F.col("fixed.turns"), F.lit(0))
    return found.select("file", "start", (state % 2 == 1).alias("inside"))


def csv_pieces(ranges: DataFrame, states: DataFrame, encoding: str) -> DataFrame:
    """Records of CSV files (``text``), whole or as border pieces."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, quoted = None, None, False
        for (file, start, entered), values in _runs(batches):
            if (file, start) != now:
                if pieces:
                    pieces.close()
                    yield pieces.batch()
                now, pieces, quoted = (file, start), _Pieces(file, start), entered
            for line in values:
                if encoding != "UTF-8":
                    line = line.decode(encoding).encode()
                if b'"' in line:
                    quoted = _quoted_after(line, quoted)
                if quoted:
                    pieces.held.append(line + b"\n")
                else:
                    pieces.end(line.removesuffix(b"\r"), 0, 0)
            if len(pieces.rows) >= 10_000:
                yield pieces.batch()
        if pieces:
            pieces.close()
            yield pieces.batch()

    return _entered(ranges, states).mapInArrow(cut, PIECE)
