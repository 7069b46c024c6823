"""Hard negatives of anchors: rows of other labels that score a stated part of what a positive scores.

The scores of a cell are the product of two int64 tiles, by Strassen's recursion with zero padding. Additions in 64 bits are exact as long as the scores fit,
whatever the sums in between do. Two passes: cells of one label fill the positive heaps; cells of all labels then fill a window heap for each
anchor and positive. Heaps of cells are merged by their order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles

FACTOR, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: The window, in hundredths of the positive's score.
LOWEST, HIGHEST = 30, 90
#: Tiles with a side of at most this many rows or columns are multiplied at once.
LEAF = 32
#: Anchors and candidates of a tile.
ANCHORS, CANDIDATES = 256, 4_096

POSITIVE = "a_row long, vec_id long, c_row long, score long"
NEGATIVE = "a_row long, anchor_id long, slot int, positive_id long, positive_score long, negative_id long, c_row long, negative_score long"


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b with seven products of halves instead of eight; odd sides get a zero row or column."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.asfortranarray(np.pad(b, ((0, k % 2), (0, n % 2))))
    i, j, h = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * j), p1.dtype)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def tiled(a: np.ndarray, x: np.ndarray):
    """(anchors' start, candidates' start, scores) of each tile of the inner products of rows of a and x, all int64."""
    to = (lambda m: m.astype(np.int64)) if tiles.exact(a, x) else tiles.as_objects
    a, x = to(a), to(x)
    for i in range(0, len(a), ANCHORS):
        for j in range(0, len(x), CANDIDATES):
            yield i, j, tiles.as_long(strassen(a[i : i + ANCHORS], x[j : j + CANDIDATES].T))


def merged(heap: tuple, more: tuple, k: int) -> tuple:
    """Heaps (key, candidate, score) of both: the k first of each key."""
    both = [np.concatenate(x) for x in zip(heap, more, strict=True)]
    pick = tiles.heads(both[0], both[2], both[1], k)
    return tuple(x[pick] for x in both)


def lowest_kept(heap: tuple, keys: int, k: int, low: np.ndarray) -> np.ndarray:
    """The k-th score of each key that has k, else its `low`."""
    out = low.copy()
    full = np.flatnonzero(np.bincount(heap[0], minlength=keys) >= k)
    ends = np.searchsorted(heap[0], full, "right") - 1
    out[full] = np.maximum(out[full], heap[2][ends])
    return out


EMPTY = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _table(schema: str, *columns) -> pa.Table:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)


def _positives(k: int, factor: int, width: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        candidates = tiles.by_id(candidates)
        a_row, c_row = anchors["row"].to_numpy(), candidates["row"].to_numpy()
        own, heap = tiles.places(a_row, c_row), EMPTY
        bottom = np.full(len(a_row), np.iinfo(np.int64).min)
        for i, j, scores in tiled(tiles.matrix(anchors["vector"], factor, width), tiles.matrix(candidates["vector"], factor, width)) if len(a_row) and len(c_row) else ():
            here = slice(i, i + len(scores))
            least = lowest_kept(heap, len(a_row), k, bottom)[here]
            at = np.nonzero((scores >= least[:, None]) & (np.arange(j, j + scores.shape[1]) != own[here, None]))
            heap = merged(heap, (at[0] + i, at[1] + j, scores[at]), k)
        a, c, score = heap
        return _table(POSITIVE, pa.array(a_row[a]), candidates["vec_id"].take(pa.array(c)), pa.array(c_row[c]), pa.array(score))

    return run


def windows(score: np.ndarray, lowest: int, highest: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest whole n with lowest * score <= 100 * n <= highest * score; for negative scores there is none."""
    exact = [int(s) for s in score]
    return np.array([-((-lowest * s) // 100) for s in exact], np.int64), np.array([highest * s // 100 for s in exact], np.int64)


def _negatives(k: int, factor: int, width: int, window: tuple[int, int]):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        candidates = tiles.by_id(candidates)
        label, c_row = candidates["label"].to_numpy(), candidates["row"].to_numpy()
        lists = anchors["positives"].combine_chunks()
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        slots = lists.flatten()
        score = slots.field("score").to_numpy(zero_copy_only=False).astype(np.int64)
        low, high = windows(score, *window)
        own_label, heap = anchors["label"].to_numpy(), EMPTY
        for i, j, scores in tiled(tiles.matrix(anchors["vector"], factor, width), tiles.matrix(candidates["vector"], factor, width)) if len(owner) and len(c_row) else ():
            other = own_label[i : i + len(scores), None] != label[None, j : j + scores.shape[1]]
            here = np.flatnonzero((owner >= i) & (owner < i + len(scores)))
            least = lowest_kept(heap, len(owner), k, low)
            more = []
            for s in here:  # a window for each positive of the tile's anchors
                line = scores[owner[s] - i]
                at = np.flatnonzero((line >= least[s]) & (line <= high[s]) & other[owner[s] - i])
                more.append((np.full(len(at), s), at + j, line[at]))
            heap = merged(heap, tuple(np.concatenate(x) for x in zip(EMPTY, *more, strict=True)), k)
        s, c, found = heap
        taken = lambda column, at: column.take(pa.array(at))
        of = owner[s]
        return _table(
            NEGATIVE, taken(anchors["row"], of), taken(anchors["vec_id"], of), taken(slots.field("slot"), s), taken(slots.field("vec_id"), s), pa.array(score[s]), taken(candidates["vec_id"], c), pa.array(c_row[c]), pa.array(found)
        )

    return run


def mined(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, factor: int = FACTOR, window: tuple[int, int] = (LOWEST, HIGHEST)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; embeddings: vec_id, embedding, label.

    Anchors are the rows whose vec_id is divisible by `every`; a score is the inner product of vectors floor(factor * x). An anchor's positives are its
    first other rows of its label, a positive's negatives the first rows of other labels with
    window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score: by falling score, ties by the smaller vec_id, null ones last. Rows that
    repeat a vec_id are rows of their own. Rows with a null label or vector, or with a component that is null or not finite, take no part; a null vec_id is no
    anchor. Shorter vectors count as ending in zeros. Scores beyond 64 bits are set to the last one. Positives without negatives, anchors without positives
    and an empty table give no rows; other columns are ignored.
    """
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].alias("vector"), embeddings["label"].cast("long").alias("label"))
    rows = tiles.numbered(rows.where(F.col("label").isNotNull() & tiles.whole(F.col("vector"))))
    asked = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("m"), F.max(F.size("vector")).alias("width"))
    n, m, width, most, most_asked = counts.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.sum("m"), F.max("width"), F.max("n"), F.max("m")))).first()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors, blocks = rows.where(asked), lambda of: max(1, -(-of // tiles.BLOCK_ROWS))

    # A label of any share of the rows has as many stripes as its size asks for.
    a, c = tiles.in_cells(anchors, rows, blocks(most_asked), tiles.dealt(most, width, 1), "label")
    heaps = a.cogroup(c).applyInArrow(_positives(positives, factor, width), POSITIVE)
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("c_row")]
    best = tiles.first_of(heaps, ["a_row"], order, positives, "slot")
    best = best.groupBy(F.col("a_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("slot", "vec_id", "score"))).alias("positives"))

    a, c = tiles.in_cells(anchors.join(best, "row"), rows, blocks(m), tiles.dealt(n, width, partitions))
    heaps = a.cogroup(c).applyInArrow(_negatives(negatives, factor, width, window), NEGATIVE)
    order = [F.desc("negative_score"), F.asc_nulls_last("negative_id"), F.asc("c_row")]
    return tiles.first_of(heaps, ["a_row", "slot"], order, negatives, "rank").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted(embeddings: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Where vec_id is divisible by `every`, the label is the next one of so many."""
    return embeddings.withColumn("label", F.when(embeddings["vec_id"] % every == 0, (embeddings["label"] + 1) % labels).otherwise(embeddings["label"]))


def query(spark, sf_dir: str) -> DataFrame:
    return mined(shifted(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


SQL = """
with v as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as k
  from s where same),
r as (
  select p.anchor_id, positive_id, s.vec_id as negative_id, positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
  where p.k <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from r where rank <= 10
"""
