"""Feather (Arrow IPC file) scan as a Python Data Source.

Each input partition is a share of the record batches of one file, so a large
file is read by many tasks in parallel; ``read`` yields Arrow record batches
(no per-row Python).  Files are opened through pyarrow's filesystems, so a
folder may be any URI they know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = (".feather", ".arrow", ".ipc")


def _filesystem(path: str):
    """The pyarrow filesystem of a path or URI, and the path within it."""
    import pyarrow.fs as pafs
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    """(path within its filesystem, bytes) of the files of a folder, or of the file itself."""
    import pyarrow.fs as pafs
    fs, root = _filesystem(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.Directory:
        return sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root))
                      if f.is_file and f.path.endswith(SUFFIXES))
    return [(root, info.size)]


class _Share(InputPartition):
    def __init__(self, file: str, share: int, shares: int):
        super().__init__((file, share, shares))
        self.file, self.share, self.shares = file, share, shares


class FeatherDataSource(DataSource):
    """``spark.read.format("feather").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema
        path = self.options["path"]
        fs, _ = _filesystem(path)
        with fs.open_input_file(_files(path)[0][0]) as src:
            return from_arrow_schema(pa.ipc.open_file(src).schema)

    def reader(self, schema):
        return _FeatherReader(self.options["path"])


class _FeatherReader(DataSourceReader):
    """Files are cut into shares by their size; which batches a share holds is
    read from the file's footer in the task."""

    SHARE_BYTES = 64 << 20

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Share(f, i, n) for f, size in _files(self.path)
                for n in [max(1, -(-(size or 0) // self.SHARE_BYTES))] for i in range(n)]

    def read(self, partition):
        import pyarrow as pa
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(partition.file) as src:
            r = pa.ipc.open_file(src)
            n = r.num_record_batches
            for i in range(n * partition.share // partition.shares,
                           n * (partition.share + 1) // partition.shares):
                yield r.get_batch(i)


def scan_feather(spark: SparkSession, path: str) -> DataFrame:
    # Ship this module's classes by value so Python workers need not be able
    # to import the library (executors get only the pickled reader).
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FeatherDataSource)
    return spark.read.format("feather").option("path", path).load()


def write_feather(df: DataFrame, folder: str) -> str:
    """Write one Arrow IPC (Feather v2) file per partition into ``folder``.

    Each task streams its own record batches to its own file; nothing passes
    through the driver.  ``folder`` must be a shared path (file: or a
    filesystem URI pyarrow understands).
    """
    import uuid

    tag = uuid.uuid4().hex

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/part-{TaskContext.get().partitionId():05d}-{tag}.feather"
        writer = None
        n = 0
        with fs.open_output_stream(path) as sink:
            for b in batches:
                if writer is None:
                    writer = pa.ipc.new_file(sink, b.schema)
                writer.write_batch(b)
                n += b.num_rows
            if writer is not None:
                writer.close()
        if writer is None:
            fs.delete_file(path)
        yield pa.RecordBatch.from_pydict({"path": [path], "rows": [n]})

    # One small row per written file comes back (paths, not data).
    df.mapInArrow(write, "path string, rows long").collect()
    return folder
