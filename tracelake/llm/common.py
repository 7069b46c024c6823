"""Reading the corpus tables, and gapless ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.sources.scratch import freed, shared_dir, written

__all__ = ["documents", "freed", "ranked", "shared_dir", "short_batches", "texts", "written"]

#: Rows that one ranking cell holds on average.
CELL_ROWS = 20_000
BATCH_ROWS = 1000
#: What the word and text contracts call white space.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of every row; a null text is empty, other columns are not read."""
    short_batches(spark)
    return texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text of any table of documents; a null text is empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def short_batches(spark: SparkSession) -> None:
    """Rows of a batch that goes to Python, for this session: texts are long, and two workers share an executor's memory with its JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ranked(df: DataFrame, keys: list[str], order: list[Column], by: Column, name: str, rows: int) -> DataFrame:
    """Adds `name`: a gapless rank from 0 in each group of `keys`, ordered by cell and then by `order`.

    A cell is a hash range of `by`; the number of cells follows `rows`, so that no task ever ranks
    a whole group. Cells are counted, the counts are summed into offsets, and each cell ranks its own rows.
    """
    cells = max(16, -(-rows // CELL_ROWS))
    df = df.withColumn("_cell", F.pmod(F.xxhash64(by), F.lit(cells)))
    counts = df.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(offsets, [*keys, "_cell"])
        .withColumn(name, (F.col("_before") + F.col("_inside") - 1).cast("long"))
        .drop("_cell", "_inside", "_before")
    )
