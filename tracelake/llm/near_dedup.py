"""Near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct word shingles, hashed to 64 bits. Documents of equal sets are one class. A class keeps the SKETCH
smallest hashes of its set. Two sets of similarity t share at least `floor_of` of these but for a chance of MISS; so if sketch values are
ordered rarest first, the heads of two sketches, as long as the rest allows, share a value. The inverted lists of the heads
give candidates. A union sketch estimates each candidate's similarity, and those not clearly below are compared on their full sets.

A list is not expanded into pairs. First every class of a list is compared with the list's hub, its most typical class. The links found
join classes into components; only classes of different components are compared further, and only where the hub leaves it open:

- One is linked with the hub and the other far from it (a distance of more than twice the allowed one): by the triangle inequality, no link.
- Both are near the hub: two sets can be linked only if what they do differently from the hub agrees in part. These differences are
  small sets; they are indexed rarest first, again by heads, and only classes that share an entry are compared.
- One is far and neither is linked with the hub: compared, if the heads and sizes allow it. Where a list has more than LIST such
  classes, their full sets are indexed, rarest first: heads of full sets are much shorter than those of sketches, which allow for chance.

Both indexes also keep the place of each value in its set's order. Where two sets first meet, at places i and j, they can share only what
comes after; a pair whose sets are too short behind their meeting is left out. So copies with edits of their own, which have
many values that no other class has, meet no one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, freed, texts, written
from .ragged import row_by_row

WORDS = 5
SKETCH = 128
MISS = 1e-7
#: Open classes of a list that are compared with one another at once; longer lists go through full sets. Both ways find every link.
LIST = 32
#: Rows of one value that a task joins; longer lists are dealt to several.
SALT_ROWS = 1024

_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose outputs look random."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    encoded = words.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in encoded.dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(encoded.dictionary))
    return hashes[encoded.indices.to_numpy()]


def shingle_sets(text: pd.Series, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one hash of the whole sequence where it is shorter, none without words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(text, pa.large_string())))
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    there = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(there)))
    ends = before[ends - ends[0]]
    hashes = _word_hashes(flat.filter(pa.array(there))) if there.any() else np.zeros(0, np.uint64)
    out = []
    rolled = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            rolled = _mixed(rolled + hashes[k : k + len(rolled)] * _PRIMES[k % len(_PRIMES)] + np.uint64(k)) if len(rolled) else rolled
        for a, b in zip(ends, ends[1:], strict=False):
            if b - a >= n:
                out.append(np.unique(rolled[a : b - n + 1]))
            elif b > a:
                value = np.zeros(1, np.uint64)
                for k, h in enumerate(hashes[a:b]):
                    value = _mixed(value + h * _PRIMES[k % len(_PRIMES)] + np.uint64(k))
                out.append(_mixed(value + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def floor_of(share: float, size: int = SKETCH, miss: float = MISS) -> int:
    """The largest m for which two sketches of similarity `share` have fewer than m values in common with a chance of at most `miss`."""
    tail, m = 0.0, 0
    while True:
        tail += math.comb(size, m) * share**m * (1 - share) ** (size - m)
        if tail > miss:
            return m
        m += 1


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n, set_key and sketch (the smallest hashes, sorted) of each document.

    The top bit of a sketch value is flipped, so that signed order, by which Spark sorts, is that of the hashes.
    """

    def sketch(rows: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        sets = shingle_sets(rows["text"], words)
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        least = [(s[:SKETCH] ^ np.uint64(1 << 63)).view(np.int64) for s in sets]
        return pd.DataFrame({"n": [len(s) for s in sets], "set_key": keys, "sketch": least})

    return row_by_row(docs.select("doc_id", "text"), ["doc_id"], lambda: sketch, "n long, set_key binary, sketch array<long>")


def shared_of_sets(percent: int) -> Column:
    """Values that a set of n shares with any set that is linked with it, at least."""
    return F.ceil(F.col("n") * percent / 100)


def shared_of_sketches(percent: int) -> Column:
    """Values that its sketch shares. A set of up to SKETCH * percent / 100 values and any partner of it are their own sketches."""
    least = shared_of_sets(percent)
    return F.when(F.col("n") <= int(SKETCH * percent / 100), least).otherwise(F.least(F.lit(floor_of(percent / 100)), least))


def heads(classes: DataFrame, need: Column) -> DataFrame:
    """classes: rep, n, sketch; need: values shared at least. Entries value, often, at, rep, n, typical: the values of each head that other classes have too.

    A value of one class only is the rarest and needs no entry. often: classes that have the value; at: values before it in the order,
    which is that of (often, value) for every class. typical: how common the values of the whole sketch are.
    """
    sizes = classes.select("rep", "n", (F.size("sketch") - need + 1).alias("head"), F.size("sketch").alias("of"))
    rows = classes.select("rep", F.explode("sketch").alias("value"))
    often = rows.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = rows.join(often, "value").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("values"))
    shared = shared.join(sizes, "rep")
    typical = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + F.log2(v["often"])) / F.col("of")
    alone = F.col("of") - F.size("values")
    left = F.greatest(F.lit(0), F.col("head") - alone)
    shared = shared.select("rep", "n", typical.alias("typical"), alone.alias("alone"), F.posexplode(F.slice("values", F.lit(1), left)).alias("place", "v"))
    return shared.select(F.col("v.value").alias("value"), F.col("v.often").alias("often"), (F.col("alone") + F.col("place")).alias("at"), "rep", "n", "typical")


def reach(percent: int, n: str, at: str, m: str, at_m: str) -> Column:
    """Whether sets of n and m values whose first common value has at and at_m values before it can be linked."""
    needed = F.ceil((F.col(n) + F.col(m)) * percent / (100.0 + percent) - 1e-9)
    return F.least(F.col(n) - F.col(at), F.col(m) - F.col(at_m)) >= needed


def close_in_size(percent: int, a: str = "n", b: str = "n2"):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose union sketch doesn't put them clearly below the threshold."""
    m = floor_of(percent / 100)
    side = lambda k: classes.select(F.col("rep").alias(k), F.col("sketch").alias(f"sketch_{k}"), F.col("n").alias(f"n_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect(union, "sketch_a"), "sketch_b"))
    whole = (F.col("n_a") <= SKETCH) & (F.col("n_b") <= SKETCH)
    exact = F.size(F.array_intersect("sketch_a", "sketch_b")) * 100 >= percent * F.size(F.array_union("sketch_a", "sketch_b"))
    return both.where(close_in_size(percent, "n_a", "n_b") & F.when(whole, exact).otherwise((common >= m) | (F.size(union) < SKETCH))).select("a", "b")


def full_sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """doc_id, values, of (their hash) for the documents in ids only.

    Rows that repeat a doc_id with other texts are one document with several sets, each of which can confirm a pair.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"values": [s.view(np.int64) for s in shingle_sets(rows["text"], words)]})

    sets = row_by_row(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), ["doc_id"], lambda: build, "values array<long>")
    return written(sets.withColumn("of", F.xxhash64("values")).dropDuplicates(["doc_id", "of"]))


def compared(pairs: DataFrame, docs: DataFrame, words: int, near: int) -> DataFrame:
    """pairs: a, b. A written table: sizes of both full sets, of their intersection, and for pairs of at least `near` percent what b has or lacks against a.

    A value that b lacks stands as its complement.
    """
    pairs = written(pairs)
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, words)
    left = sets.select(F.col("doc_id").alias("a"), F.col("values").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("values").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", F.size(F.array_intersect("x", "y")).alias("common"))
    union = F.size("x") + F.size("y") - F.col("common")
    apart = F.concat(F.array_except("y", "x"), F.transform(F.array_except("x", "y"), lambda v: F.bitwise_not(v)))
    close = F.col("common") * 100 >= near * union
    out = written(both.select("a", "b", F.size("x").alias("n_a"), F.size("y").alias("n_b"), "common", F.when(close, apart).alias("apart")))
    freed(sets, pairs)
    return out


def linked(percent: int):
    return F.col("common") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))


def by_full_sets(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """classes: rep, n, component, far. Pairs of other components, one of them far from a hub, whose full sets meet early enough in their heads."""
    sets = full_sets(classes.select(F.col("rep").alias("doc_id")), docs, words)
    named = sets.select(F.struct("doc_id", "of").alias("rep"), F.size("values").alias("n"), F.col("values").alias("sketch"))
    entries = heads(named, shared_of_sets(percent)).groupBy("value", F.col("rep.doc_id").alias("rep")).agg(F.min("at").alias("at"), F.max("n").alias("size"))
    entries = written(entries.join(classes, "rep"))
    freed(sets)
    other = entries.select("value", *(F.col(c).alias(f"{c}2") for c in ("rep", "n", "component", "far", "at", "size")))
    # rows that repeat a doc_id may have several sets; for them size and place are the most favourable ones
    open_ = (F.col("far") | F.col("far2")) & (F.col("component") < F.col("component2")) & close_in_size(percent) & reach(percent, "size", "at", "size2", "at2")
    both = entries.join(other, (entries["value"] == other["value"]) & open_)
    return both.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))


def by_differences(seen: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that are both near a hub, not both linked with it, and may be linked with each other.

    seen: a (hub), b, sizes, apart. With c = (100 - p) / (100 + p), sets x and y are linked if they differ in at most c (|x| + |y|) values.
    They differ in |x~h| + |y~h| - 2 |common differences|. With over(x) = |x~h| - c |x|, they share at least (over(x) + over(y)) / 2 differences from the hub, and
    that is positive if one isn't linked with it. The least over(y) of the list, of open classes for a linked one, tells how many x shares with any, and so how long
    its head, rarest first, must be. Where x and y first meet, enough differences must be left behind in both.
    """
    c = (100.0 - percent) / (100.0 + percent)
    rows = seen.where("apart is not null").select("a", "b", "apart", linked(percent).alias("linked"), F.size("apart").alias("d"), (F.size("apart") - c * F.col("n_b")).alias("over"))
    # a hub all of whose near classes are linked with it leaves nothing open
    hubs = rows.groupBy("a").agg(F.min(F.when(~F.col("linked"), F.col("over"))).alias("least_open"), F.min("over").alias("least")).where("least_open is not null")
    rows = rows.join(hubs, "a")
    single = rows.withColumn("value", F.explode("apart")).drop("apart")
    often = single.groupBy("a", "value").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ordered = F.sort_array(F.collect_list(F.struct("often", "value")))
    same = single.join(often, ["a", "value"]).groupBy("a", "b").agg(*(F.first(x).alias(x) for x in ("linked", "d", "over", "least", "least_open")), ordered.alias("values"))
    # a difference of one class only comes first in its order and meets no one
    alone = F.col("d") - F.size("values")
    head = F.col("d") - F.greatest(F.lit(1), F.ceil((F.col("over") + F.when(F.col("linked"), F.col("least_open")).otherwise(F.col("least"))) / 2 - 1e-9)) + 1
    left = F.greatest(F.lit(0), head - alone).cast("int")
    same = same.join(found, F.col("b") == F.col("id"), "left").withColumn("component", F.coalesce("component", "b"))
    entries = same.select("a", "b", "component", "linked", "d", "over", alone.alias("alone"), F.posexplode(F.slice("values", F.lit(1), left)).alias("place", "v"))
    entries = entries.select("a", "b", "component", "linked", "over", F.col("v.value").alias("value"), (F.col("d") - F.col("alone") - F.col("place")).alias("behind"))
    entries = written(entries)
    y = entries.select("a", "value", *(F.col(x).alias(f"{x}2") for x in ("b", "component", "linked", "over", "behind")))
    needed = (F.col("over") + F.col("over2")) / 2 - 1e-9
    open_ = ~F.col("linked") & (F.col("linked2") | (F.col("b") < F.col("b2"))) & (F.col("component") != F.col("component2")) & (F.least("behind", "behind2") >= needed)
    both = entries.join(y, (entries["a"] == y["a"]) & (entries["value"] == y["value"]) & open_)
    return both.select(F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component for every id in links a, b: the smallest id that can be reached.

    Each round points every id to the smallest neighbour of its neighbours, so paths shorten geometrically.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # larger neighbours point to the smallest one
        large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        star = large.groupBy("a").agg(F.min("b").alias("low"))
        # smaller neighbours, and the node itself, point to the smallest one
        small = large.join(star, "a").select(F.explode(F.array("a", "b")).alias("b"), F.col("low").alias("a")).where("a <> b").distinct()
        after = written(small.select("a", "b"))
        if after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty():
            return after.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
        edges = after
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))


def near_groups(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest doc_id that
    can be reached. A null, empty or wordless text has no shingles and is linked with nothing. Repeated rows each return and are
    linked with each other; a null doc_id is linked with nothing and stays. Other columns are ignored; an empty table gives no rows.
    """
    docs = texts(docs)
    rows = written(sketches(docs, words))
    of = rows.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(of)
    entries = written(heads(classes, shared_of_sketches(percent)).drop("at"))
    near = 2 * percent - 100  # at twice the allowed distance
    most = F.max(F.struct("typical", -F.col("rep"), "rep", "n")).alias("h")
    hubs = entries.groupBy("value").agg(most, F.first("often").alias("often")).select("value", "often", F.col("h.rep").alias("hub"), F.col("h.n").alias("n2"))
    # A value of many classes is dealt to several tasks: its classes by their hash, its hub to each of them.
    parts = F.ceil(F.col("often") / SALT_ROWS).cast("int")
    dealt = entries.withColumn("salt", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    spread = written(hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("often"))
    pairs = dealt.join(spread, ["value", "salt"]).where(F.col("hub") != F.col("rep")).where(close_in_size(near)).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    seen = compared(estimated(pairs, classes, near), docs, words, near)
    links = written(seen.where(linked(percent)).select("a", "b"))
    found = written(components(links))

    # Where each class of a list stands: with the hub, near it, or far.
    state = F.when(F.col("rep") == F.col("hub"), 0).when(linked(percent), 0).when(F.col("apart").isNotNull(), 1).otherwise(2)
    known = seen.select(F.col("a").alias("hub"), F.col("b").alias("rep"), "n_a", "n_b", "common", "apart")
    placed = dealt.join(spread.select("value", "salt", "hub"), ["value", "salt"]).join(known, ["hub", "rep"], "left").select("value", "rep", "n", state.alias("state"))
    named = written(placed.where("state > 0").join(found, F.col("rep") == F.col("id"), "left").select("value", "rep", "n", "state", F.coalesce("component", "rep").alias("component")))
    mixed = named.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("state").alias("far"), F.count(F.lit(1)).alias("size")).where("low < high and far = 2")
    large = named.join(mixed.where(F.col("size") > LIST).select("value"), "value", "left_semi").groupBy("rep", "n", "component").agg((F.max("state") == 2).alias("far"))
    small = written(named.join(mixed.where(F.col("size") <= LIST).select("value"), "value", "left_semi"))
    other = small.select("value", *(F.col(x).alias(f"{x}2") for x in ("rep", "n", "state", "component")))
    open_ = (F.col("state") + F.col("state2") > 2) & (F.col("component") < F.col("component2")) & close_in_size(percent)
    few = small.join(other, (small["value"] == other["value"]) & open_).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))
    done = seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = few.unionByName(by_full_sets(written(large), docs, words, percent)).unionByName(by_differences(seen, found, percent)).distinct().join(done, ["a", "b"], "left_anti")
    more = compared(estimated(rest, classes, percent), docs, words, 101).where(linked(percent)).select("a", "b")
    every = written(links.unionByName(more))
    freed(entries, spread, seen, named, small, links)
    found = components(every)

    top = classes.join(found, F.col("rep") == F.col("id"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "set_key").join(top, "set_key", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows that repeat a doc_id, all or none."""
    kept = near_groups(docs, percent).where("kept").select("doc_id").distinct()
    return docs.where("doc_id is null").unionByName(docs.join(kept, "doc_id", "left_semi"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), percent=85)
