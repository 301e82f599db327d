"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables: a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set (tests, notebooks)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            named = os.path.join(tempfile.gettempdir(), "matrella-checkpoints")
        else:  # a cluster that names none: beside its tables, which all executors reach
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.sparkContext.setCheckpointDir(named)
    if named.startswith(tempfile.gettempdir()):  # one of our own: nobody else clears it
        _clear_at_exit(spark, jsc.getCheckpointDir().get())
    return named


def _clear_at_exit(spark: SparkSession, uri: str) -> None:
    def remove() -> None:
        with suppress(Exception):  # the session may be gone already
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(remove)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: later stages survive lost executors without re-running its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, deleted when the driver ends."""
    uri = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    _clear_at_exit(spark, uri)
    return uri


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, columns compressed: for what is read more than once and by few columns at a time."""
    uri = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)
