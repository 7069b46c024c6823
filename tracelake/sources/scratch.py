"""Tables in the shared folder that cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session that runs in one process gets a temporary folder; where executors are processes of their own, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "tracelake-shared")


def written(df: DataFrame, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: lineage ends, and sizes are known.

    `freed` removes it; what is not freed goes when the folder's owner empties it after the job.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows as a table like `written`, in as many buckets of the columns as shuffles have partitions: joins on these columns read it where it lies, however often, and only deal the other side."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    path, n = f"{shared_dir(spark).rstrip('/')}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).options(path=path, compression="zstd").saveAsTable(name)
    out = spark.table(name)
    out._written_to, out._named = path, name
    return out


def freed(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more, neither a plan to come nor one that a lost executor may repeat."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path:
            spark = table.sparkSession
            if hasattr(table, "_named"):
                spark.sql(f"drop table if exists {table._named}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
