"""Session construction and cluster settings that the jobs read back."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Bytecode from which Spark gives up one method for a whole stage; its own default lets any size pass.
METHOD_CONF, METHOD_DEFAULT, METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", "65535", "8000"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tidewater") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # let HotSpot compile the large generated methods of wide parsing stages
        # (on a cluster: spark.executor.extraJavaOptions)
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is. Only when it is unset (local tests) a scratch folder is created.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        current = tempfile.mkdtemp(prefix="tidewater-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def keep_methods_small(spark: SparkSession) -> None:
    """Parsing stages are wide: as one method they are beyond the 8000 bytes
    that HotSpot compiles, and every row is interpreted. With this limit Spark
    runs such a stage as projections of small methods. A limit that the
    session sets itself stays."""
    if spark.conf.get(METHOD_CONF, METHOD_DEFAULT) == METHOD_DEFAULT:
        spark.conf.set(METHOD_CONF, METHOD_LIMIT)
