"""Session helpers: sensible settings, and where lineage may be cut."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Partial top-k before the shuffle is what keeps a hot group out of one task.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # A generated method above this size is never compiled by the JVM; the stage is then cut up instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int | None = None,
                  app: str = "postmill", checkpoint: str | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    builder = builder.config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions or 8))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="postmill-checkpoint-")


def cut_lineage(df: DataFrame, folder: str | None = None, by: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    A written table survives the loss of executors, and unlike a checkpointed RDD
    it keeps column pruning and size statistics for the joins that follow. The rows
    stay until the folder is emptied; ``scratch`` does so at its end. Rows of one value
    of ``by`` lie together, so one who asks for some values reads no others.
    """
    spark = df.sparkSession
    path = f"{folder or checkpoint_folder(spark).rstrip('/')}/postmill-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Cut lineage inside the block with what this gives; at its end those tables are deleted.

    Results that outlive the block must be written outside of it.
    """
    folder = f"{checkpoint_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    try:
        yield functools.partial(cut_lineage, folder=folder)
    finally:
        delete_folder(spark, folder)
