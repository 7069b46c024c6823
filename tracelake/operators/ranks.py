"""The first rows of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 64


def first_of(rows: DataFrame, keys: list[str], by: str, order: list[str | Column], keep: int, name: str | None = None, distinct: bool = False) -> DataFrame:
    """The first `keep` rows of each group of `keys` in an order; `name` adds their ranks from 1. With `distinct`, equal rows count once.

    Groups are cut in two steps: in cells, by a hash of `by`, and then as what is left of them, so that no task ever sorts a whole group. Equal rows
    lie in one cell, so they are made distinct where cells are cut, by the same shuffle.
    """
    cell = F.pmod(F.xxhash64(by), F.lit(CELLS))
    inside = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order))
    rows = rows.withColumn("_cell", cell)
    rows = rows.repartition(*keys, "_cell").distinct() if distinct else rows
    few = rows.withColumn("_k", inside).where(F.col("_k") <= keep).drop("_cell", "_k")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = few.withColumn("_k", rank).where(F.col("_k") <= keep)
    return out.withColumnRenamed("_k", name) if name else out.drop("_k")
