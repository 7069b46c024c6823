"""How five filters of documents interact, in every order of applying them.

Which of the filters A to D a document fails is told from its text where it is read. For E, copies, a counting Bloom filter comes first: each
task counts the hashes of its texts in a sketch, sketches are merged slice by slice and saturate at two, and a text with a counter
at one is guaranteed to be unique. Only the other texts, the possible repeats, are shuffled whole, for the smallest doc_id of each text.
The flags of a document then are a mask of five bits, and every figure of the report is a sum over the counts of masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
#: What words end at, and the marks of filter D.
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
#: Counters for each document, and those that a text sets. A slice of counters is merged in one group.
COUNTERS, HASHES, SLICE_BITS = 16, 2, 18
#: Counters altogether are 2^30 at most, and the bits that go to every task 128 MB. With more than some 10^8 documents fewer texts are cleared and more are shuffled; the result is the same.
MOST_BITS = 30

SKETCH = "slice int, once array<int>, again array<int>"


def failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D."""
    words = F.filter(F.split(text, BETWEEN_WORDS), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), 100 * capitals > 10 * F.char_length(text), text.rlike(MARKS)]


def hashes(text: Column) -> tuple[Column, Column]:
    """128 bits of a text; the first 64 are what the counters are chosen by."""
    return F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit("check"), text).alias("check_hash")


def flagged(docs: DataFrame) -> DataFrame:
    """A written table: part, doc_id, text_hash, check_hash and mask, with bits 0 to 3 for A to D."""
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    bits = [fails.cast("int") * (1 << k) for k, fails in enumerate(failures(F.col("text")))]
    return written(rows.select("part", "doc_id", *hashes(F.col("text")), sum(bits[1:], bits[0]).alias("mask")))


def places(text_hash: np.ndarray, bits: int) -> np.ndarray:
    """A row of HASHES counters of the 2^bits for each text."""
    h = text_hash.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64((1 << bits) - 1)).astype(np.int64)


def sketches(flags: DataFrame, bits: int) -> DataFrame:
    """The counting sketches of each task, by slice: counters that one text sets, and those that more do."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = [batch["text_hash"].to_numpy() for batch in batches]  # 8 bytes a row
        if not hashed:
            return
        at, n = np.unique(places(np.concatenate(hashed), bits), return_counts=True)
        cuts = np.flatnonzero(np.diff(at >> SLICE_BITS)) + 1
        for counters, counts in zip(np.split(at, cuts), np.split(n, cuts), strict=True):
            inside = (counters & ((1 << SLICE_BITS) - 1)).astype(np.int32)
            yield pd.DataFrame({"slice": [int(counters[0] >> SLICE_BITS)], "once": [inside[counts == 1]], "again": [inside[counts > 1]]})

    return flags.select("text_hash").mapInPandas(count, SKETCH)


def merged(sketched: DataFrame) -> DataFrame:
    """slice, bits: a bit for each counter, set where the sketches together are at two or more."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << SLICE_BITS, np.uint8)
        for once, again in zip(group["once"], group["again"], strict=True):
            counts[once] = np.minimum(counts[once] + 1, 2)
            counts[again] = 2
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "bits": [np.packbits(counts > 1, bitorder="little").tobytes()]})

    return sketched.groupBy("slice").applyInPandas(add, "slice int, bits binary")


def sized(rows: int) -> int:
    """Bits of the number of counters for so many documents."""
    return min(MOST_BITS, max(SLICE_BITS, (COUNTERS * rows).bit_length()))


def with_copies(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """part, doc_id, mask; bit 4 of the mask is set where a smaller doc_id has the same text."""
    bits = sized(flags.count())
    repeats = np.zeros((1 << bits) // 8, np.uint8)
    for r in merged(sketches(flags, bits)).toLocalIterator():  # 128 MB at most
        repeats[r.slice << (SLICE_BITS - 3) : (r.slice + 1) << (SLICE_BITS - 3)] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(repeats)

    @F.pandas_udf("boolean")
    def may_repeat(text_hash: pd.Series) -> pd.Series:
        at = places(text_hash.to_numpy(), bits)
        return pd.Series(((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).withColumn("text_hash", hashes(F.col("text"))[0])
    least = texts.where(may_repeat("text_hash")).groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    first = least.where("doc_id is not null").select("doc_id", *hashes(F.col("text")), F.lit(True).alias("first"))
    judged = flags.withColumn("open", may_repeat("text_hash") & F.col("doc_id").isNotNull())
    met = judged.where("open").join(first, ["doc_id", "text_hash", "check_hash"], "left")
    copies = met.select("part", "doc_id", F.when(F.col("first").isNull(), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    return copies.unionByName(judged.where("not open").select("part", "doc_id", "mask"))


def steps() -> list[tuple[str, int, int, int]]:
    """order, step, mask of the filters before it and its own bit, for every order of the five filters."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            out.append(("".join(order), step, before, own))
            before |= own
    return out


def report(masks: DataFrame) -> DataFrame:
    """masks: part, mask (0 to 31, bits of the filters that a document fails), n, good, toxic; the rows of `audited`."""
    counts = [F.sum(F.when(F.col("mask") == m, F.struct(F.col("n"), F.col("good"), F.col("toxic"))[name]).otherwise(0)).alias(f"{name}{m}") for m in range(32) for name in ("n", "good", "toxic")]
    parts = masks.groupBy("part").agg(*counts).select("part", *(F.array(*(f"{name}{m}" for m in range(32))).alias(name) for name in ("n", "good", "toxic")))
    listed = ", ".join(f"struct('{o}' as filter_order, {s} as step, {b} as before, {own} as own)" for o, s, b, own in steps())  # 600 rows, whatever the input
    rows = parts.withColumn("at", F.explode(F.expr(f"array({listed})"))).select("part", "n", "good", "toxic", "at.*")
    of = lambda name, test: F.aggregate(F.filter(F.transform(F.col(name), lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda x: test(x["m"])), F.lit(0).cast("long"), lambda a, x: a + x["v"])
    before, own = F.col("before"), F.col("own")
    here = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(own) != 0)
    # A document goes by each of the f filters it fails in 120 / f of the orders.
    falls = F.aggregate(
        F.transform("n", lambda v, m: F.when(m.bitwiseAND(own) != 0, v * F.floor(120 / F.bit_count(m))).otherwise(0)), F.lit(0).cast("long"), lambda a, v: a + v
    )
    return rows.select(
        "part", "filter_order", "step",
        of("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        of("n", here).alias("removed"),
        of("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        of("n", lambda m: m == own).alias("unique_fails"),
        of("good", here).alias("good_lost"),
        of("toxic", here).alias("toxic_lost"),
        falls.alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (lang; null is the empty string), order of the filters and step, zeros included.

    filter_order, step, kept (after the step), removed (by it), redundant (failing its filter, removed before), unique_fails (failing its filter
    only), good_lost and toxic_lost (removed by it, with label quality = 1 or toxic = 1), shapley (removed by its filter, summed over all orders).
    Filters: A under 100 words; B fewer than 80 different words in 100; C more than 10 of `[A-Z]` in 100 code points; D a mark of `[#$%&*|]`; E a text
    identical to that of a smaller doc_id anywhere in the table, removed or not. Null text is the empty text. Repeated rows each count; they are no
    copies of each other, as their doc_id isn't smaller. A null doc_id is neither smaller nor larger than others, and has no labels; of
    labels that repeat a doc_id one is enough. An empty table has no parts and so no rows; other columns are ignored.
    """
    masks = with_copies(docs, flagged(docs))
    marked = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(
        F.max((F.coalesce(labels["quality"], F.lit(0)) == 1).cast("long")).alias("good"), F.max((F.coalesce(labels["toxic"], F.lit(0)) == 1).cast("long")).alias("toxic")
    )
    # The masks of documents that share a doc_id, repeated in any share of the rows, are counted before they meet their label.
    counted = masks.groupBy("part", "doc_id", "mask").agg(F.count(F.lit(1)).alias("n")).join(marked, "doc_id", "left")
    lost = lambda name: F.sum(F.col("n") * F.coalesce(name, F.lit(0))).alias(name)
    return report(counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("good"), lost("toxic")))


def query(spark, sf_dir: str) -> DataFrame:
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from documents),
f as materialized (
  select part, coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic,
    len(words) < 100 as a, 100 * len(list_distinct(words)) < 80 * len(words) as b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) as c,
    regexp_matches(text, '[#$%&*|]') as d, w.doc_id > min(w.doc_id) over (partition by text) as e
  from w left join labels l on l.doc_id = w.doc_id),
m as materialized (
  select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from f group by all),
l as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as t(name, bit)),
p as (
  select v.name || w.name || x.name || y.name || z.name as filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] as bits
  from l v, l w, l x, l y, l z where v.bit | w.bit | x.bit | y.bit | z.bit = 31),
s as (select filter_order, step::int as step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from p, range(1, 6) as r(step)),
o as materialized (
  select parts.part, s.filter_order, s.step, s.own, coalesce(sum(n) filter (mask & (own | before) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (mask & own > 0 and mask & before = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (mask & own > 0 and mask & before > 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = own), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mask & own > 0 and mask & before = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (mask & own > 0 and mask & before = 0), 0)::bigint as toxic_lost
  from (select distinct part from m) parts cross join s join m on m.part = parts.part group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, own)::bigint as shapley from o
"""
