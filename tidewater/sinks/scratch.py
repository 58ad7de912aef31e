"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts lineage: what comes after it reads Parquet, and a lost
executor costs the running stage only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import CHECKPOINT_CONF, ensure_checkpoint_dir

PREFIX = "tidewater-"


def is_scratch(path: str) -> bool:
    """Whether a file belongs to an intermediate table."""
    return f"/{PREFIX}" in path


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path below ``spark.checkpoint.dir``. Only a session of one
    process (``local[...]``, as in tests) may go without that setting."""
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{PREFIX}{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
