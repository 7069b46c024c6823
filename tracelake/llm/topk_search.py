"""Exact search of the largest inner products by branch and bound over columns.

In a cell the candidates lie in vertical layout, a row for each dimension, dimensions in order of their mass. Scores grow by a block of
dimensions at a time. What the dimensions still to come can add or take is bounded by the product of both remaining
masses (the norms of the rest); a candidate whose upper bound is below the k-th score, or below the k-th best lower bound, is out.
Candidates that no query of the batch needs leave the columns; when few pairs are left, these go on as a compact list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles

FACTOR, TOP, EVERY = 1024, 10, 100
#: Dimensions of a block; queries and candidates whose scores are in memory at once.
DIMENSIONS = 16
BATCH, CHUNK = 256, 4_096
#: Share of pairs below which they go on as a list.
SPARSE = 1 / 8
#: Bounds are doubles of whole numbers below 2^51: rounding stays far below this.
SLACK = 2.0

HEAP = "q_row long, query_id long, vec_id long, c_row long, score long"


class Columns:
    """Candidates in vertical layout, with the masses that remain behind each block."""

    def __init__(self, x: np.ndarray) -> None:
        self.order = np.argsort(-(x**2).sum(axis=0), kind="stable")
        self.v = np.ascontiguousarray(x[:, self.order].T)
        self.cuts = [slice(a, a + DIMENSIONS) for a in range(0, len(self.v), DIMENSIONS)]
        self.rest = np.array([self.mass(self.v[c.stop :]) for c in self.cuts])

    @staticmethod
    def mass(v: np.ndarray) -> np.ndarray:
        return np.sqrt((v**2).sum(axis=0))


def searched(q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, candidate and score of the k best candidates of each query; own: the candidate that is the query itself, or -1.

    Candidates stand in the order that settles ties.
    """
    if not len(q) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not q.shape[1] or not tiles.exact(q, x):
        scores = tiles.as_long(tiles.as_objects(q) @ tiles.as_objects(x).T) if q.shape[1] else np.zeros((len(q), len(x)), np.int64)
        at = np.nonzero(np.arange(len(x)) != own[:, None])
        pick = tiles.heads(at[0], scores[at], at[1], k)
        return at[0][pick], at[1][pick], scores[at][pick]
    columns, parts = Columns(x), []
    q = q[:, columns.order]
    for a in range(0, len(q), BATCH):
        found = _batch(q[a : a + BATCH], own[a : a + BATCH], columns, k)
        parts.append((found[0] + a, *found[1:]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _batch(q: np.ndarray, own: np.ndarray, columns: Columns, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest_q = np.array([columns.mass(q[:, c.stop :].T) for c in columns.cuts])
    heap = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.full(len(q), -np.inf)  # the k-th score of each query, once it has k
    for lo in range(0, columns.v.shape[1], CHUNK):
        at = np.arange(lo, min(lo + CHUNK, columns.v.shape[1]))
        scores, pairs = np.zeros((len(q), len(at))), None
        alive = at != own[:, None]
        for b, cut in enumerate(columns.cuts):
            if pairs is None:
                scores += q[:, cut] @ columns.v[cut, at]
                spare = rest_q[b][:, None] * columns.rest[b][at]
                if len(at) > k and np.isinf(least).any():  # k candidates reach their lower bounds whatever comes
                    low = np.where(alive, scores - spare, -np.inf)
                    np.maximum(least, np.partition(low, -k, axis=1)[:, -k] - SLACK, out=least)
                alive &= scores + spare > least[:, None] - SLACK
                some = alive.any(axis=0)
                at, scores, alive = at[some], scores[:, some], alive[:, some]
                if alive.sum() <= SPARSE * alive.size:
                    pairs = np.nonzero(alive)
                    score = scores[pairs]
                    pairs = pairs[0], at[pairs[1]]
            else:
                score += (q[pairs[0], cut] * columns.v[cut][:, pairs[1]].T).sum(axis=1)
                stays = score + rest_q[b][pairs[0]] * columns.rest[b][pairs[1]] > least[pairs[0]] - SLACK
                pairs, score = (pairs[0][stays], pairs[1][stays]), score[stays]
        if pairs is None:
            pairs = np.nonzero(alive)
            score = scores[pairs]
            pairs = pairs[0], at[pairs[1]]
        both = [np.concatenate(x) for x in zip(heap, (*pairs, score), strict=True)]
        pick = tiles.heads(both[0], both[2], both[1], k)
        heap = tuple(x[pick] for x in both)
        last = np.flatnonzero(np.bincount(heap[0], minlength=len(q)) >= k)
        ends = np.searchsorted(heap[0], last, "right") - 1
        least[last] = heap[2][ends]
    return heap


def _cell(k: int, factor: int, width: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        candidates = tiles.by_id(candidates)
        q_row, c_row = queries["row"].to_numpy(), candidates["row"].to_numpy()
        i, j, score = searched(tiles.matrix(queries["vector"], factor, width), tiles.places(q_row, c_row), tiles.matrix(candidates["vector"], factor, width), k)
        columns = [pa.array(q_row[i]), queries["vec_id"].take(pa.array(i)), candidates["vec_id"].take(pa.array(j)), pa.array(c_row[j]), pa.array(tiles.as_long(score))]
        return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["q_row", "query_id", "vec_id", "c_row", "score"])

    return run


def top_k(embeddings: DataFrame, k: int = TOP, every: int = EVERY, factor: int = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product with each query, of vectors floor(factor * x).

    Queries are the rows whose vec_id is divisible by `every`; every row but the query's own is a candidate. Ties go to the smaller
    vec_id; null ones come last and are no queries. Rows that repeat a vec_id are rows of their own, as queries and as candidates. Vectors that
    are null or hold a null or a component that isn't finite take no part; shorter vectors count as ending in zeros, and an empty one has a
    score of 0 with all. Scores beyond 64 bits are set to the last one. An empty table gives an empty result; other columns are ignored.
    """
    vector = embeddings["embedding"]
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), vector.alias("vector")).where(tiles.whole(F.col("vector")))
    rows = tiles.numbered(rows)
    asked = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    n, m, width = rows.agg(F.count(F.lit(1)), F.count_if(asked), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, stripes = max(1, -(-m // tiles.BLOCK_ROWS)), tiles.dealt(n, width, partitions)
    queries, candidates = tiles.in_cells(rows.where(asked), rows, blocks, stripes)
    heaps = queries.cogroup(candidates).applyInArrow(_cell(k, factor, width), HEAP)
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("c_row")]
    return tiles.first_of(heaps, ["q_row"], order, k, "rank").select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
