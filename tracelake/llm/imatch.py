"""I-Match fingerprints over randomised subsets of a lexicon.

The lexicon holds the terms whose inverse document frequency lies in a band: terms of at least MIN_DOCS documents, and of at most
MAX_SHARE of all. A document's terms in the lexicon are sorted and hashed; so are those in each of SERIES * LEVELS random subsets of the
lexicon. A subset of level k keeps a share of 4^-k of the lexicon, by a hash of the term; a series is a sequence of such subsets, each
within the one before. Every document is hashed on the whole lexicon and on all subsets, whatever its length: coarse subsets tell
short documents apart, and fine ones still hold a term or two of a long one.

Two fingerprints are alike in the share of subsets that hash alike, on the finest levels that together have EVIDENCE subsets with terms of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, texts, written

SERIES = 16
LEVELS = 7
EVIDENCE = 16
#: The band: a term of one document only is out, and so is one of more than this share of all.
MIN_DOCS = 2
MAX_SHARE = 0.2
#: Ids in a block; one task sorts a block at a time.
BLOCK = 1024


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms: runs of letters and digits, each in lower case."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, term_hash))


def term_hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def first_word(text: Column) -> Column:
    """The run of letters and digits that a text begins with, empty where there is none."""
    return F.regexp_extract(text, r"^[\p{L}\p{N}]+", 0)


def last_word(text: Column) -> Column:
    return F.reverse(first_word(F.reverse(text)))


def pieces(text: str, following: str) -> tuple[Column, Column]:
    """What stays of a text when it is edited, and the start of the next one that follows on it; nothing where there is no next one."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    own = F.when(F.col(following).isNull(), F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), F.char_length(text) - half))
    return own, F.coalesce(F.substring(F.col(following), F.lit(1), half), F.lit(""))


def cut_terms(rows: DataFrame, df: DataFrame, most: int) -> DataFrame:
    """block, part, cuts: the terms of the lexicon among the words that the cuts of a block's edited texts make, at its seam and at its end.

    These are the only words of an edited text that neither of its documents need have. A block has at most two for each row.
    """
    rows = rows.withColumn("next_text", before("text")).where("own = 1")
    own, more = pieces("text", "next_text")
    seam, end = F.concat(last_word(own), first_word(more)), last_word(F.concat(own, more))
    made = F.array_except(F.transform(F.filter(F.array(seam, end), lambda w: w != ""), term_hash), "out")
    made = rows.select("block", "part", F.explode(made).alias("term")).distinct()
    band = df.where(F.col("df").between(MIN_DOCS, most)).select("term")
    return made.join(band, "term").groupBy("block", "part").agg(F.collect_list("term").alias("cuts"))


def lower_neighbour(ids: DataFrame, low: int, high: int) -> DataFrame:
    """ids: distinct long `id`. Each with the next smaller one as `below` (null for the smallest).

    Ids are grouped by 4096 adjacent values; only the largest id of each group goes on to the next, coarser level.
    """
    width = 4096
    if high - low < width:
        return ids.select("id", F.lag("id").over(Window.orderBy("id")).alias("below"))  # at most `width` rows
    grouped = ids.withColumn("part", F.floor(F.col("id") / width))
    inside = grouped.withColumn("below", F.lag("id").over(Window.partitionBy("part").orderBy("id")))
    tops = grouped.groupBy("part").agg(F.max("id").alias("top"))
    coarse = lower_neighbour(tops.select(F.col("part").alias("id")), low // width, high // width)
    lower = coarse.join(tops.withColumnRenamed("part", "below"), "below").select(F.col("id").alias("part"), "top")
    return inside.join(lower, "part", "left").select("id", F.coalesce("below", "top").alias("below"))


def block_of(doc_id: Column) -> Column:
    return F.floor(doc_id / BLOCK)


def ends(docs: DataFrame) -> DataFrame:
    """block, doc_id: for each block, the largest document of the next lower one, or for the lowest block the largest of all."""
    tops = written(docs.where("doc_id is not null").groupBy(block_of(F.col("doc_id")).alias("id")).agg(F.max("doc_id").alias("top")))
    edge = tops.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    below = lower_neighbour(tops.select("id"), edge["low"] or 0, edge["high"] or 0)
    copies = below.select(F.col("id").alias("block"), F.coalesce("below", F.lit(edge["high"])).alias("from"))
    return written(copies.join(tops.select(F.col("id").alias("from"), "top"), "from").select("block", F.col("top").alias("doc_id")))


def in_blocks(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """rows: doc_id, h and others. Each in its block, with own = 1, and the last document of the next lower block before them, with own = 0.

    Rows without a doc_id are dealt by h. block and part are never null, so that no join on them adds a filter below the shuffle, which then serves several readers.
    """
    kept = lambda value: F.coalesce(value, F.lit(0).cast("long"))
    own = rows.withColumn("block", kept(block_of(F.col("doc_id")))).withColumn("part", kept(F.when(F.col("doc_id").isNull(), 1 + F.pmod("h", F.lit(BLOCK))))).withColumn("own", F.lit(1))
    copied = rows.join(copies, "doc_id").withColumn("block", kept(F.col("block"))).withColumn("part", F.lit(0).cast("long")).withColumn("own", F.lit(0))
    return own.unionByName(copied)


def before(column: str) -> Column:
    """The column of the row before, going up from the lowest document of a block: that of the next one in descending doc_id."""
    up = Window.partitionBy("block", "part").orderBy("own", "doc_id", "h")
    return F.when(F.col("doc_id").isNotNull(), F.lag(column).over(up))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_id, next_text: the next document in descending doc_id, after the last one the first.

    Texts move once, to the block of their ids. What crosses a block's end is the largest document of the next lower block,
    which is copied to the block above; the largest of all goes to the lowest. Blocks hold at most BLOCK different ids.
    """
    rows = in_blocks(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), ends(docs))
    out = rows.withColumn("next_id", before("doc_id")).withColumn("next_text", before("text")).where("own = 1")
    return out.select("doc_id", "text", "next_id", "next_text")


def document_frequency(docs: DataFrame) -> DataFrame:
    """docs: doc_id, h, text. term, df (rows that have it), and the ids of one of them: for a term of one document, that document."""
    every = docs.select("doc_id", "h", F.explode(term_hashes(F.col("text"))).alias("term"))
    return written(every.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("doc_id").alias("doc_id"), F.max("h").alias("h")))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once; inside a lambda, an outer expression would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed(terms: str) -> Column:
    """The print of the sorted terms in a column: one hash of all, and a 32-bit one for each subset, null where it is empty, the finest level first."""
    series = []
    for r in range(SERIES):
        keep = f"filter(acc.rest, t -> shiftright(xxhash64(t, {r}), 2 * (k - 1)) & 3 = 0)"
        digest = "case when size(x) > 0 then cast((xxhash64(x) & 4294967295) - 2147483648 as int) end"
        step = f"element_at(transform(array({keep}), x -> named_struct('rest', x, 'out', array_append(acc.out, {digest}))), 1)"
        series.append(f"aggregate(sequence(1, {LEVELS}), named_struct('rest', ts, 'out', cast(array() as array<int>)), (acc, k) -> {step}).out")
    by_series = f"flatten(array({', '.join(series)}))"
    finest = f"transform(sequence(0, {SERIES * LEVELS - 1}), i -> element_at(s, cast((i % {SERIES}) * {LEVELS} + {LEVELS} - i div {SERIES} as int)))"
    body = f"element_at(transform(array({by_series}), s -> {finest}), 1)"
    return F.expr(f"element_at(transform(array({terms}), ts -> named_struct('whole', xxhash64(ts), 'subsets', {body})), 1)")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes, with the whole list's, on the finest levels that have EVIDENCE subsets with terms of either; 1 where all terms agree."""
    pairs = F.zip_with(a["subsets"], b["subsets"], lambda x, y: F.when(x.isNull() & y.isNull(), None).otherwise(x.eqNullSafe(y).cast("int")))

    def step(acc: Column, part: Column) -> Column:
        more = F.struct((acc["n"] + F.size(F.array_compact(part))).alias("n"), (acc["same"] + F.size(F.filter(part, lambda p: p == 1))).alias("same"))
        return F.when(acc["n"] >= EVIDENCE, acc).otherwise(more)

    levels = let(pairs, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.slice(ps, k * SERIES + 1, SERIES)))
    share = F.aggregate(levels, F.struct(F.lit(0).alias("n"), F.lit(0).alias("same")), step, lambda acc: acc["same"] / (acc["n"] + 1.0))
    return F.when(a["whole"] == b["whole"], 1.0).otherwise(share)


def in_words(print_: Column) -> Column:
    """The print in hexadecimal digits; a minus stands for an empty subset."""
    digits = lambda x, n: F.substring(F.lpad(F.hex(x), 16, "0"), 17 - n, n)
    subsets = F.transform(print_["subsets"], lambda x: F.when(x.isNull(), "-").otherwise(digits(x.cast("long"), 8)))
    return F.concat_ws(" ", digits(print_["whole"], 16), F.array_join(subsets, " "))


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the contract's: the last half of the code points gives way to the start of the next document in descending doc_id. It is
    fingerprinted as any text: words that the cut makes are looked up in the lexicon too, so an edited text that equals a document has its fingerprint.
    A text none of whose terms is in the band is fingerprinted on all its terms. Null text is empty; texts without terms have fingerprints of nothing, which are alike.
    Of rows that repeat a doc_id each comes before the next in the order of a hash of their texts; a single document has itself as the next one, and a null doc_id
    has none (it keeps its text, near_next is 0). Other columns are ignored; an empty table gives no rows.
    """
    docs = texts(docs).withColumn("h", F.xxhash64("text"))
    df = document_frequency(docs)
    most = max(MIN_DOCS, int(MAX_SHARE * docs.count()))
    # Such terms are at most the average number of a document's terms, divided by MAX_SHARE, however many documents there are.
    common = F.lit([r.term for r in df.where(F.col("df") > most).select("term").collect()]).cast("array<bigint>")
    rare = df.where(F.col("df") < MIN_DOCS).groupBy("doc_id", "h").agg(F.collect_list("term").alias("rare"))  # at most a text's terms
    rows = docs.withColumn("rare", F.lit(None).cast("array<bigint>")).unionByName(rare.withColumn("text", F.lit(None).cast("string")))
    # Dealt by block once: that serves all windows, and the words that cuts make come back to their block.
    rows = in_blocks(rows, ends(docs)).repartition("block", "part")
    same = Window.partitionBy("block", "part", "own", "doc_id", "h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.expr("cast(array() as array<bigint>)")
    rows = rows.withColumn("out", F.coalesce(F.first("rare", ignorenulls=True).over(same), none)).where("text is not null")
    cuts = cut_terms(rows, df, most)

    band = lambda terms, out: let(F.array_except(F.array_except(terms, common), out), lambda ts: F.array_sort(F.when(F.size(ts) > 0, ts).otherwise(terms)))
    rows = rows.select("block", "part", "own", "doc_id", "h", "text", "out", term_hashes(F.col("text")).alias("terms"))
    rows = rows.withColumn("lexicon", band(F.col("terms"), F.col("out"))).withColumn("print", hashed("lexicon"))
    rows = rows.select("*", *(before(c).alias(f"next_{c}") for c in ("text", "terms", "out", "print"))).where("own = 1")

    known = F.array_union("terms", F.coalesce("next_terms", none))
    rows = rows.select("block", "part", "doc_id", "text", "print", "next_print", F.concat(*pieces("text", "next_text")).alias("edited"), known.alias("known"), F.array_union("out", F.coalesce("next_out", none)).alias("out"))
    rows = rows.join(cuts, ["block", "part"], "left").withColumn("terms", term_hashes(F.col("edited")))
    # A word that neither document has is in the lexicon if the corpus says so.
    strange = let(F.array_except("terms", "known"), lambda ts: F.array_except(ts, F.coalesce("cuts", none)))
    rows = rows.withColumn("lexicon", band(F.col("terms"), F.concat("out", strange))).withColumn("edited_print", hashed("lexicon"))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        in_words(F.col("print")).alias("fingerprint"), in_words(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        F.when(F.col("next_print").isNull(), 0.0).otherwise(likeness(F.col("print"), F.col("next_print"))).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
