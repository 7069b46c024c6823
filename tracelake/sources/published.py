"""Packages that are published whole: parts first, then a manifest of what was written; without its manifest a version is not there.

The manifest is made from the parts as they lie in the store, read back by the executors. Its own commit is the last thing that happens, so a job that is lost on the way leaves the
version before it in place, and a repeated one starts a version of its own.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a part, so that one can be read back by a task.
PART_ROWS = 1_000_000
MANIFEST = "table string, part string, bytes long, sha256 string, rows long, columns string"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[str]:
    """The versions that are whole, the oldest first."""
    at, fs = _files(spark, root)
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()]
    return sorted(n for n in names if fs.exists(_files(spark, f"{root}/{n}/manifest/_SUCCESS")[0]))


def parts(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """table, part, bytes, sha256 of the files of a written table."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{table}")
    return read.select(F.lit(table).alias("table"), F.substring_index("path", "/", -1).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Writes the tables as a new version and returns its name. A table without rows has one part, so that it has a schema."""
    spark = next(iter(tables.values())).sparkSession
    known = versions(spark, root)
    name = f"{int(known[-1].split('-')[0]) + 1 if known else 1:012}-{uuid.uuid4().hex[:12]}"
    folder, rows = f"{root}/{name}", None
    for table, df in tables.items():
        df.write.option("maxRecordsPerFile", PART_ROWS).parquet(f"{folder}/{table}")
        written = spark.read.schema(df.schema).parquet(f"{folder}/{table}")
        counts = written.groupBy(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("part")).agg(F.count(F.lit(1)).alias("rows"))
        told = parts(spark, folder, table).join(counts, "part", "left").select("table", "part", "bytes", "sha256", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(df.schema.json()).alias("columns"))
        rows = told if rows is None else rows.unionByName(told)
    rows.write.parquet(f"{folder}/manifest")
    return name


def manifest(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The manifest of a version, else of the newest one that is whole."""
    known = versions(spark, root)
    if not known or (version and version not in known):
        raise FileNotFoundError(f"no whole version {version or ''} under {root}")
    return spark.read.schema(MANIFEST).parquet(f"{root}/{version or known[-1]}/manifest")


def opened(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """A table of a version, else of the newest one that is whole: the parts that its manifest names, and no others."""
    version = version or (versions(spark, root) or [None])[-1]
    named = manifest(spark, root, version).where(F.col("table") == table).select("part", "columns")
    first = named.first()  # all parts of a table have its columns
    if first is None:
        raise FileNotFoundError(f"no table {table} in {root}/{version}")
    read = spark.read.schema(StructType.fromJson(json.loads(first["columns"]))).parquet(f"{root}/{version}/{table}")
    part = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return read.withColumn("_part", part).join(named.select(F.col("part").alias("_part")), "_part", "left_semi").drop("_part")


def damaged(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """table, part, fault (missing, changed, unknown) of the parts that are not as the manifest has them."""
    version = version or (versions(spark, root) or [None])[-1]
    want = manifest(spark, root, version).select("table", "part", F.struct("bytes", "sha256").alias("want"))
    found = None
    for row in want.select("table").distinct().collect():  # the tables of a package
        some = parts(spark, f"{root}/{version}", row["table"])
        found = some if found is None else found.unionByName(some)
    both = want.join(found.select("table", "part", F.struct("bytes", "sha256").alias("have")), ["table", "part"], "full")
    fault = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("have") != F.col("want"), "changed")
    return both.withColumn("fault", fault).where("fault is not null").select("table", "part", "fault")
