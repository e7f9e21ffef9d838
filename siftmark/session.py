"""Session defaults and the shared folder for written intermediate results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

WRITTEN = "written"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Written intermediates are small here: splits of this size keep all cores busy with them.
    "spark.sql.files.maxPartitionBytes": "2m",
    "spark.sql.files.openCostInBytes": "512k",
    # Call sites of single column operations are not needed and slow plan building down.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "16g", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("siftmark")
    settings = {
        **DEFAULTS,
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cpus),
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediates: ``spark.checkpoint.dir``.

    Only a local session without one, as in tests, gets a temporary folder of its own; a cluster
    has to name a folder that all its machines see.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="siftmark-")
        spark.sparkContext.setCheckpointDir(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def written(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    For results that several later steps read: it ends their lineage, survives the loss of
    executors, and is computed once. ``file_rows``: a task begins a new file after so many rows
    (0: never), so that readers divide what one task wrote.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{WRITTEN}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_written(spark: SparkSession) -> None:
    """Delete all tables that ``written`` has made in this application; their readers end."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    prefix = f"{WRITTEN}-{spark.sparkContext.applicationId}-"
    for status in files.listStatus(base):
        if status.getPath().getName().startswith(prefix):
            files.delete(status.getPath(), True)
