"""Sets of tables that readers see whole or not at all.

A set is written into a folder of its own below the target, table by table, and becomes the
current one by a single rename of a small file that names it. A writer that dies before that
leaves the old set in place, and running it again starts over; what it left behind goes with the
next set that is finished. One writer at a time; readers may read meanwhile.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CURRENT = "_current.json"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, folder, folder.getFileSystem(conf), conf


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the current set holds: its folder, and for each table its rows and schema."""
    jvm, folder, files, _ = _files(spark, path)
    current = jvm.org.apache.hadoop.fs.Path(folder, CURRENT)
    if not files.exists(current):
        return None
    stream = files.open(current)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_set(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict:
    """Write all tables and make them the current set; the sets before it are deleted.

    Rows are counted while they are written. Returns the manifest.
    """
    jvm, folder, files, conf = _files(spark, path)
    name = f"set-{uuid.uuid4().hex}"
    listed = {}
    for table, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{name}/{table}")
        listed[table] = {"rows": seen.get["n"], "schema": df.schema.jsonValue()}
    made = {"folder": name, "tables": listed}
    Path = jvm.org.apache.hadoop.fs.Path
    ready = Path(folder, f"_{name}.json")
    stream = files.create(ready, True)
    stream.write(bytearray(json.dumps(made).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(ready), files.makeQualified(Path(folder, CURRENT)), options)
    for status in files.listStatus(folder):
        left = status.getPath().getName()
        if left not in (name, CURRENT) and left.removeprefix("_").startswith("set-"):
            files.delete(status.getPath(), True)
    return made


def read_set(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current set; raises if there is none."""
    from pyspark.sql.types import StructType

    held = manifest(spark, path)
    if held is None:
        raise ValueError(f"no finished set under {path}")
    return {
        table: spark.read.schema(StructType.fromJson(x["schema"])).parquet(f"{path}/{held['folder']}/{table}")
        for table, x in held["tables"].items()
    }
