"""Session helpers: building a session for tests/bench and cutting lineage.

The library never invents storage locations on a cluster.  Lineage is cut with
``DataFrame.checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``; only when that setting is missing *and* the master is
local (tests, laptops) do we fall back to a private temporary folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tablescope", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the library is tuned for (AQE on, UI off)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        # Wide per-column aggregates carry many buffer fields; keep them in
        # whole-stage codegen instead of falling back to interpreted mode.
        .config("spark.sql.codegen.maxFields", "2000")
        # Checkpoint files of intermediate results are removed once unreferenced.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABLESCOPE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, registering it with the context.

    Reads ``spark.checkpoint.dir`` from the session.  If it is unset we only
    create a temporary folder for local masters; a cluster must configure a
    shared folder, otherwise checkpoints would land on one machine's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) so checkpoints survive executor loss")
        configured = tempfile.mkdtemp(prefix="tablescope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder.

    The checkpointed plan keeps the output partitioning and ordering of ``df``,
    so partition ids seen afterwards are stable across task retries.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables inside the shared checkpoint folder."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tablescope-scratch/{name}-{uuid.uuid4().hex}"
