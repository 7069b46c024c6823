"""Vectors in cells: each block of queries meets each stripe of candidates once, in Arrow tables of bounded size.

Rows are dealt to blocks and stripes by a hash of their number, so no label, no group of copies and no share of the table makes a cell
larger than its bound. What a cell finds is a heap for each query; heaps of cells are merged by a window that keeps the first rows
already before its shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Components of a stripe's vectors, and queries of a block.
STRIPE_COMPONENTS = 4_000_000
BLOCK_ROWS = 4_096
#: Below this product of norms sums of products are whole numbers in doubles, and far inside 64 bits; vectors beyond are multiplied as Python's integers.
EXACT = 2.0**51


def whole(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def numbered(vectors: DataFrame) -> DataFrame:
    """A written table of the rows with `row`, a number of their own: rows that repeat an identifier stay apart."""
    return written(vectors.withColumn("row", F.monotonically_increasing_id()))


def dealt(rows: int, width: int, partitions: int) -> int:
    """Stripes for so many candidates: as many as their size asks for, and enough to keep the partitions busy while stripes have 1,000 rows or more."""
    return max(1, -(-rows * max(width, 1) // STRIPE_COMPONENTS), min(partitions, rows // 1000))


def in_cells(queries: DataFrame, candidates: DataFrame, blocks: int, stripes: int, *also: str):
    """Both tables grouped by cell (and by the columns `also`), for cogroup."""
    dealt_to = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    named = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  both come from one table, whose columns must not be taken for each other
    q = named(queries).withColumn("block", dealt_to(blocks)).withColumn("stripe", each(stripes))
    c = named(candidates).withColumn("stripe", dealt_to(stripes)).withColumn("block", each(blocks))
    return q.groupBy(*also, "block", "stripe"), c.groupBy(*also, "block", "stripe")


def first_of(heaps: DataFrame, keys: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first k rows of each key with their rank from 1; Spark cuts every task's rows to k a key before it shuffles them."""
    return heaps.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def matrix(column: pa.ChunkedArray, factor: int, width: int) -> np.ndarray:
    """floor(factor * x) of each component, as doubles that hold whole numbers; shorter vectors end in zeros."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * factor)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any sum of products of rows of a and b is exact in doubles."""
    longest = lambda m: np.sqrt((m**2).sum(axis=1).max(initial=0))
    with np.errstate(over="ignore"):
        return longest(a) * longest(b) < EXACT


def as_objects(m: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python's integers."""
    return np.array([int(x) for x in m.ravel()], dtype=object).reshape(m.shape)


def as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; what lies beyond them is set to the last one."""
    if scores.dtype == object:
        return np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in scores.ravel()], dtype=np.int64).reshape(scores.shape)
    return scores.astype(np.int64)


def by_id(candidates: pa.Table) -> pa.Table:
    """In the order that ties are settled by: smaller vec_id, null last, then row."""
    return candidates.take(pc.sort_indices(candidates, sort_keys=[("vec_id", "ascending"), ("row", "ascending")], null_placement="at_end"))


def places(rows: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The place of each row number in `among`, -1 where it isn't there."""
    if not len(among):
        return np.full(len(rows), -1)
    order = np.argsort(among, kind="stable")
    at = np.searchsorted(among, rows, sorter=order).clip(max=len(among) - 1)
    found = order[at]
    return np.where(among[found] == rows, found, -1)


def heads(group: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k first entries of each group, by falling score and then by place; ordered by group."""
    order = np.lexsort((place, ~score if score.dtype.kind == "i" else -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < k]
