"""Helpers shared by the operators: tables, scratch folders, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.session import scratch_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, release: bool = False, batch: int | None = None) -> DataFrame:
    """``df`` written to the shared scratch folder and read back.

    The written table cuts the lineage: a lost executor costs a re-read, and
    every later step sees the same rows and partition numbers.  With ``release``
    the shuffle files of the write go as soon as the table is written; with
    ``batch`` Python gets that many rows at a time, for rows that are long.
    """
    path = scratch_folder(df.sparkSession, name)
    conf = df.sparkSession.conf
    settings = ({CLEANUP: "true"} if release else {}) | ({BATCH: str(batch)} if batch else {})
    before = {key: conf.get(key, None) for key in settings}
    for key, value in settings.items():
        conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` gave and that nothing will read any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is exactly the
    rule ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Numbering(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n
