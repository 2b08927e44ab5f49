"""Session construction for tests, benchmarks and local runs.

On a cluster the session comes from the platform; library code never changes
its configuration.  ``build_session`` is only for local use.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "tradelens",
                  extra: dict | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    """A local session.  ``checkpoint_dir`` becomes ``spark.checkpoint.dir``; without it, see :func:`shared_folder`."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cores)
    if checkpoint_dir:
        conf["spark.checkpoint.dir"] = checkpoint_dir
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the driver and all executors see.

    It is ``spark.checkpoint.dir``.  Only where that is unset, it is a folder in the SQL warehouse, which
    every session has and which tables need to be shared as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def cut_lineage(df, eager: bool = True):
    """Materialise ``df`` in the shared folder and continue from the files.

    Used where one intermediate feeds many branches of a plan, or must be the same for all of them: later
    stages rescan the checkpoint instead of recomputing the upstream joins, and a lost executor does
    not force a recompute from the sources.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Suggested SQL settings for a cluster run over ``input_bytes`` of Parquet.

    Shuffle partitions are sized so each holds about ``target_partition_bytes`` of
    the largest shuffle (taken as the input size) and there are at least three
    waves of tasks; AQE then coalesces small partitions and splits skewed ones.
    Apply with ``spark.conf.set`` before running reports (all are runtime SQL
    settings).
    """
    partitions = max(3 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }
