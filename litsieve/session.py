"""Session helpers: one place for the knobs every job relies on.

Nothing here hides Spark: it is the builder a user would write, plus the rule for the
checkpoint folder (read it from the session; only a local test session may pick its own).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    # AQE sizes shuffle partitions from the data: start wide, coalesce toward ~128 MB partitions
    # (keeping parallelism first, so CPU-heavy verification stages stay spread over all cores)
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # split a partition that is 5x the median and above 256 MB (a hot join key) into pieces
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # checkpoint files of round state are removed once the driver drops the DataFrame
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Starting shuffle width on a cluster: AQE coalesces it down for small stages, so it only has to
# be large enough that a 100 TB stage still yields partitions of a few hundred MB.
CLUSTER_SHUFFLE_PARTITIONS = 20_000


def build_session(master: str | None = None, app: str = "litsieve", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE and skew-join splitting on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    local = (master or "").startswith("local")
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or (8 if local else CLUSTER_SHUFFLE_PARTITIONS))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, registering it with the context.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it as is. Only a
    local-mode session without that setting (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder; lineage cuts need it")
        configured = tempfile.mkdtemp(prefix="litsieve-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def landed(df: DataFrame, path: str) -> DataFrame:
    """Written as Parquet and read again: cuts lineage like a checkpoint, and the plan's size estimates with it (a
    checkpoint keeps those of the joins before it, which grow without end over many rounds)."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
