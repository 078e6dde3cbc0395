"""Session construction and reliable-storage helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every report relies on. Shuffle partitions are a starting point:
# AQE coalesces small ones and splits skewed ones at runtime.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of frames no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # one BLAS thread per Python worker: tasks already fill every core
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def get_spark(master: str | None = None, app: str = "bizlens",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, creating one with the defaults above.

    On a cluster the session normally exists already (spark-submit); then only
    unset keys are filled in, never overriding what the cluster configured.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        spark = active
    else:
        builder = SparkSession.builder.appName(app)
        if master:
            builder = builder.master(master)
        for k, v in _DEFAULTS.items():
            builder = builder.config(k, v)
        if shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        for k, v in (extra or {}).items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    for k, v in _DEFAULTS.items():
        if k.startswith(("spark.ui.", "spark.executorEnv.", "spark.cleaner.")):
            continue
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a home and return it.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it as
    is. Only when nothing is configured (local tests) do we create a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="bizlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def reliable(df, eager: bool = True, spread: bool = False):
    """Cut lineage by writing ``df`` to the reliable checkpoint folder.

    Used where a prepared frame feeds several jobs (model fits), so a lost
    executor recomputes from the checkpoint, not from the whole upstream plan.
    ``spread=True`` first redistributes the rows over the cluster's default
    parallelism: AQE may have coalesced a small upstream shuffle into very few
    partitions, and iterative fits would then run on as few tasks.
    """
    checkpoint_dir(df.sparkSession)
    if spread:
        df = df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism))
    return df.checkpoint(eager=eager)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage in storage that every executor reaches, and gives later joins the
    true file size, by which Spark decides on a broadcast.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def configure_for_scale(spark: SparkSession, input_bytes: int, total_cores: int,
                        target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Size shuffles and scans for an input of ``input_bytes`` on ``total_cores``.

    * scan splits of ``target_partition_bytes`` (parquet row groups are read in
      parallel within a file);
    * initial shuffle partitions = input / target (at least 2 per core, at most
      100k); AQE then coalesces them towards the advisory size and splits
      skewed ones (a partition over 4x the median and over 1 GB);
    * broadcast joins stay at Spark's 10 MB default: only measured-small sides.
    Returns the settings applied.
    """
    parts = int(max(2 * total_cores, min(100_000, input_bytes // target_partition_bytes)))
    settings = {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    return settings


def env_cpus(default: int = 8) -> int:
    try:
        return int(os.environ.get("BENCH_CPUS", default))
    except ValueError:
        return default
