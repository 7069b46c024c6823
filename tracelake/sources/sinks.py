"""Writers of graph packages, serving tables, cards and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_package(df: DataFrame, root: str, name: str, key: str) -> DataFrame:
    """A table of a package as CSV parts, sorted by key over all parts; returns rows and a digest that doesn't depend on their order."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").options(header="true", escape='"', emptyValue='""').csv(f"{root}/{name}")
    line = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(line).cast("string").alias("checksum")).select(F.lit(name).alias("table"), "rows", "checksum")


def write_serving(df: DataFrame, path: str, partition: str) -> None:
    """A serving table, a folder for each partition; written aside by the committer and swapped in whole partitions."""
    df.repartition(F.col(partition), F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.mode("overwrite").partitionBy(partition).parquet(path)


def write_cards(df: DataFrame, path: str) -> None:
    """Cards as line-wise JSON."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def snapshot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a golden snapshot: each node and edge as text without numeric ids, in order."""
    lines = nodes.select(F.concat_ws(" ", F.lit("node"), "node_type", "stable_id").alias("line")).unionByName(edges.select(F.concat_ws(" ", F.lit("edge"), "edge_type", "source", "target").alias("line")))
    return lines.distinct().orderBy("line")


def integrity(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence of edges that are not there; a writer fails where any is left."""
    return evidence.join(edges.select("edge_id"), "edge_id", "left_anti")
