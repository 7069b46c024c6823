"""Exact deduplication on a log-structured merge index of text digests.

Memtables: each task of the first pass merges its rows by digest. A generation's memtables flush into a run of level 0, entries sorted by digest
in parts of its range, and each part gets a Bloom filter. An entry has the row that stays (of the longest texts the
smallest identifier) and the number of its rows. Where a newer run has grown to half of the older one it is compacted into it: its entries are probed
against the older run's filters; those that a filter excludes are new and move as they are, and only the others are merged by digest. Spark has
no merge of sorted files, so a compaction groups the older run by digest again; the order of a run serves its readers.
The last compaction leaves one run, the index. Digests with more than one row are hits: their texts are compared byte by byte,
and where texts differ despite an equal digest, they form groups by the text itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, freed, shared_dir, texts, written

#: Runs of level 0 that the memtables are dealt to.
GENERATIONS = 4
#: Entries of a part of a run, on average; a part has one filter.
PART_ROWS = 50_000
#: Bits of a filter for an entry, and those that an entry sets.
FILTER_BITS, FILTER_HASHES = 10, 4
#: Bits of the filter of hits that goes to every task, and so 16 MB at most. With more hits it lets more other texts through to the comparison.
HIT_BITS = 27

ENTRY = "part long, digest binary, shorter long, doc_id long, n long"


def normalised(text: Column) -> Column:
    """The text without its ASCII white space."""
    return F.translate(text, SPACES, "")


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def logged(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, digest and memtable (the task that read it) of each row; a written table."""
    rows = texts(docs).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), digest_of(normalised(F.col("text"))).alias("digest"))
    return written(rows.withColumn("memtable", F.spark_partition_id()))


def part_of(parts: int) -> Column:
    """Parts are equal stretches of the digests' range."""
    first = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    return F.floor(first * parts / 2**32).cast("long")


def merged(entries: DataFrame) -> DataFrame:
    best = F.min(F.struct("shorter", "doc_id")).alias("best")
    return entries.groupBy("part", "digest").agg(best, F.sum("n").alias("n")).select("part", "digest", F.col("best.shorter").alias("shorter"), F.col("best.doc_id").alias("doc_id"), "n")


def flushed(memtables: DataFrame) -> DataFrame:
    """A run of sorted entries."""
    return written(merged(memtables).sortWithinPartitions("part", "digest"))


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    """A row for each of the filter's hashes: words of the digest itself, which is a hash already."""
    words = np.frombuffer(b"".join(d[4 : 4 + 4 * FILTER_HASHES].ljust(4 * FILTER_HASHES, b"\0") for d in digests), ">u4").reshape(-1, FILTER_HASHES)
    return (words % np.uint32(bits)).T


def filters(run: DataFrame) -> DataFrame:
    """part, bits: the Bloom filter of each part."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        size = 8 * max(8, len(group) * FILTER_BITS // 8)
        bits = np.zeros(size, bool)
        for at in _positions(group["digest"].tolist(), size):
            bits[at] = True
        return pd.DataFrame({"part": group["part"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    return written(run.select("part", "digest").groupBy("part").applyInPandas(build, "part long, bits binary"))


def probed(entries: DataFrame, by: DataFrame) -> DataFrame:
    """entries with `maybe`: whether the filters let them through. False is certain."""

    def test(group: pa.Table, of: pa.Table) -> pa.Table:  # in Arrow, as a null doc_id would make doubles of the others in pandas
        maybe = np.zeros(len(group), bool)
        if len(group) and len(of):
            bits = np.unpackbits(np.frombuffer(of["bits"][0].as_py(), np.uint8)).astype(bool)
            maybe = bits[_positions(group["digest"].to_pylist(), len(bits))].all(axis=0)
        return group.append_column("maybe", pa.array(maybe))

    return entries.groupBy("part").cogroup(by.groupBy("part")).applyInArrow(test, ENTRY + ", maybe boolean")


def compacted(older: DataFrame, newer: DataFrame) -> DataFrame:
    """One run of both."""
    sieve = filters(older)
    sorted_out = written(probed(newer, sieve))
    fresh, again = sorted_out.where("not maybe").drop("maybe"), sorted_out.where("maybe").drop("maybe")
    out = written(merged(older.unionByName(again)).unionByName(fresh).sortWithinPartitions("part", "digest"))
    freed(sieve, sorted_out, older, newer)
    return out


def indexed(log: DataFrame) -> DataFrame:
    """The index of a log: part, digest, shorter (minus the characters of the row that stays), doc_id (that row's), n (rows)."""
    rows = log.count()
    entry = log.select("memtable", part_of(max(1, rows // PART_ROWS)).alias("part"), "digest", (-F.col("n_chars")).alias("shorter"), "doc_id", F.lit(1).cast("long").alias("n"))
    runs: list[tuple[DataFrame, int]] = []
    for g in range(GENERATIONS):
        run = flushed(entry.where(F.pmod("memtable", F.lit(GENERATIONS)) == g).drop("memtable"))
        runs.append((run, run.count()))
        while len(runs) > 1 and (2 * runs[-1][1] >= runs[-2][1] or g == GENERATIONS - 1):
            (newer, _), (older, _) = runs.pop(), runs.pop()
            run = compacted(older, newer)
            runs.append((run, run.count()))
    return runs[0][0]


def found(index: DataFrame, entries: DataFrame) -> DataFrame:
    """The index's entries for the digests of `entries` (part, digest and others as in a run); filters keep what is new from the join."""
    sieve = filters(index)
    maybe = probed(entries, sieve).where("maybe")
    return index.join(maybe.select("part", "digest").distinct(), ["part", "digest"], "left_semi")


def hit_filter(hits: DataFrame) -> np.ndarray:
    """A bit for each first HIT_BITS bits of a digest."""
    at = F.shiftright(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), 32 - HIT_BITS) + 1
    rows = hits.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << HIT_BITS) // 8, np.uint8)
    for r in rows.toLocalIterator():  # at most 2^HIT_BITS / 32768 rows of 4 KB
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def suspects(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, n_chars, digest, norm of the rows whose digest may be a hit."""
    shared = docs.sparkSession.sparkContext.broadcast(hit_filter(hits))

    @F.pandas_udf("boolean")
    def may_be_hit(digest: pd.Series) -> pd.Series:
        at = np.frombuffer(b"".join(d[:4].ljust(4, b"\0") for d in digest), ">u4").astype(np.int64) >> (32 - HIT_BITS)
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    norm = texts(docs).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    return norm.withColumn("digest", digest_of(F.col("norm"))).where(may_be_hit("digest"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space. The row with the most code
    points in its original text stays, then the one with the smallest doc_id. Null text is the empty text,
    and all empty texts are one group. Repeated rows each count and return; of rows that
    repeat the doc_id that stays, each is marked as kept. A null doc_id sorts first and is kept only as such.
    An empty table gives an empty result; other columns are ignored.
    """
    log = logged(docs)
    index = indexed(log)
    # A digest of any share of the rows is looked up once for each memtable, and its rows find it there.
    told = log.select("memtable", "digest").distinct().join(index.select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size")), "digest")
    plain = log.join(told, ["memtable", "digest"])
    maybe = suspects(docs, index.where("n > 1"))
    # The least and the greatest text of a digest are equal if all are; each task hands on two texts of a digest at most.
    compared = maybe.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    mixed = written(compared.where("low <> high").select("digest"))
    if mixed.isEmpty():
        return _with_kept(plain.select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256")))
    # Groups of a mixed digest are those of its texts.
    odd = written(maybe.join(mixed, "digest"))
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), "doc_id")).alias("best")
    groups = odd.groupBy("norm").agg(best, F.count(F.lit(1)).alias("group_size"))
    apart = odd.join(groups, "norm").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", F.lower(F.hex("digest")).alias("text_sha256"))
    rest = plain.join(mixed, "digest", "left_anti").select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256"))
    return _with_kept(rest.unionByName(apart))


def _with_kept(groups: DataFrame) -> DataFrame:
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return groups.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; one row of those that repeat it."""
    kept = exact_groups(docs).where("kept").groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")).agg(F.count(F.lit(1)).alias("_n"))
    kept = written(kept)
    sha = F.lower(F.hex(digest_of(normalised(F.coalesce(docs["text"], F.lit(""))))))
    stays = lambda of: docs.join(of, docs["doc_id"].eqNullSafe(of["_kept_id"]) & (sha == of["_kept_sha"]), "left_semi")
    repeated = kept.where("_n > 1")
    if repeated.isEmpty():
        return stays(kept)
    once = stays(repeated).withColumn("_text", normalised(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return stays(kept.where("_n = 1")).unionByName(once)


def query(spark, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents),
g as (
  select doc_id, norm,
    first_value(doc_id) over (partition by norm order by length(text) desc, doc_id) as keep_id,
    count(*) over (partition by norm) as group_size
  from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
"""
