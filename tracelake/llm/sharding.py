"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents start in shards dealt by rank, so counts are at most one apart. In each round a document asks
for the shard in which most of its neighbours (documents of equal text) are, if those are more than in its own.
Moves are granted in cycles of shards, each of which gives as many documents as it takes, and as exchanges against
documents without links or groups that move as a whole. So every round leaves the sizes as they are.
Neighbours meet at their group, never in pairs: an edge count is a count by group and shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CELL_ROWS, documents, freed, ranked, texts, written

SHARDS = 24
ROUNDS = 12
#: Parts that a group of equal texts is counted in before it is counted as a whole.
CELLS = 64
#: What documents want that may go anywhere: those without links, and those of groups that are whole in their shard and move as such.
ALONE, TOGETHER = -1, -2


def circulation(asked: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """What of the asked moves can go round in cycles, so that every shard gives as much as it takes; the largest demands first.

    Each cycle uses up one demand at least, so there are at most as many cycles as pairs of shards.
    """
    left, given = dict(asked), {}
    while True:
        path, seen, dead = [], {}, set()
        out: dict[int, list[tuple[int, int]]] = {}
        for (i, j), n in left.items():
            if n and i != j:
                out.setdefault(i, []).append((n, j))
        for moves in out.values():
            moves.sort(key=lambda x: (x[0], -x[1]))
        cycle = None
        for start in sorted(out):
            path, seen = [start], {start: 0}
            while path and cycle is None:
                moves = out.get(path[-1], [])
                if not moves or path[-1] in dead:
                    dead.add(path[-1])
                    del seen[path.pop()]
                    if path:
                        out[path[-1]].pop()
                    continue
                step = moves[-1][1]
                if step in dead:
                    moves.pop()
                elif step in seen:
                    cycle = path[seen[step] :]
                else:
                    seen[step] = len(path)
                    path.append(step)
            if cycle:
                break
        if not cycle:
            return given
        pairs = list(zip(cycle, cycle[1:] + cycle[:1], strict=True))
        n = min(left[p] for p in pairs)
        for p in pairs:
            left[p] -= n
            given[p] = given.get(p, 0) + n


def granted(asked: dict[tuple[int, int], int], free: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """Rows (from, wants, low, high, to): ranks low to high - 1 of those in shard `from` that want `wants` go to `to`.

    asked: documents in shard i that want shard j; free: those in shard i that go anywhere, ALONE or with their whole group, TOGETHER.
    Opposite moves and cycles are granted first, then moves against free documents. Both tables are bounded by the square of the number of shards.
    """
    given = circulation(asked)
    used, rows = dict.fromkeys(free, 0), []
    for kind in (ALONE, TOGETHER):
        for (i, j), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
            back = min(n - given.get((i, j), 0), free.get((j, kind), 0) - used.get((j, kind), 0))
            if back > 0:
                at = used[j, kind]
                rows.append((j, kind, at, at + back, i))
                used[j, kind] += back
                given[i, j] = given.get((i, j), 0) + back
    return [(i, j, 0, n, j) for (i, j), n in sorted(given.items()) if n] + rows


def propagate(state: DataFrame, shards: int, rounds: int, rows: int) -> DataFrame:
    """state: doc_id, gid and linked (rows of the text, both null without links) and shard, besides other columns.

    Returns it with the shards of the last round. A text of more rows than a shard holds keeps as many shards as it needs, those where most of it is.
    """
    spark, capacity = state.sparkSession, max(1, rows // shards)
    # A text is ranked as one unit, unless it is larger than a cell.
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("linked") / CELL_ROWS))
    unit = F.when(F.col("gid").isNull(), F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("gid", part))
    for _ in range(rounds):
        votes = state.where("gid is not null").groupBy("gid", "shard").agg(F.count(F.lit(1)).alias("n"), F.first("linked").alias("linked"))
        most = F.greatest(F.lit(1), F.ceil(F.max("linked") / capacity)).cast("int")
        order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("fewer"), F.xxhash64("gid", "shard").alias("h"), "shard")))
        tops = votes.groupBy("gid").agg(F.slice(order, 1, most).alias("tops"), F.count(F.lit(1)).alias("spread"), F.first("linked").alias("linked"))
        aims = tops.select("gid", "spread", "linked", F.col("tops.shard").alias("keep"), F.filter("tops", lambda t: -t["fewer"] < capacity)["shard"].alias("open"))
        aim = F.when(F.size("open") > 0, F.element_at("open", (F.pmod(F.xxhash64("doc_id"), F.size("open")) + 1).cast("int")))
        inside = F.when(F.col("spread") == 1, TOGETHER)
        wants = F.when(F.array_contains("keep", F.col("shard")), inside).otherwise(aim).cast("int")
        # Documents without links take no part in the join, and a large group is dealt to several tasks.
        parts = F.ceil(F.col("linked") / CELL_ROWS).cast("int")
        grouped = state.where("gid is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), parts).cast("int"))
        told = grouped.join(aims.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("linked"), ["gid", "salt"]).withColumn("wants", wants)
        alone = state.where("gid is null").withColumn("wants", F.lit(ALONE))
        before, asking = state, written(told.select(*state.columns, "wants").unionByName(alone))
        found = asking.where("wants is not null").groupBy("shard", "wants").agg(F.count(F.lit(1)).alias("n")).collect()  # at most shards * (shards + 2) rows
        asked = {(r.shard, r.wants): r.n for r in found if r.wants >= 0}
        moves = granted(asked, {(r.shard, r.wants): r.n for r in found if r.wants < 0})
        if not moves:
            return asking.drop("wants")
        movers = ranked(asking.where("wants is not null"), ["shard", "wants"], [F.col("gid"), F.col("doc_id"), F.col("text_crc32")], unit, "place", rows)
        table = F.broadcast(spark.createDataFrame(moves, "at int, aim int, low long, high long, goes int"))  # at most 3 * shards * shards rows
        fits = (F.col("shard") == F.col("at")) & (F.col("wants") == F.col("aim")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
        moved = movers.join(table, fits, "left").withColumn("shard", F.coalesce("goes", "shard"))
        columns = state.columns
        state = written(moved.select(*columns).unionByName(asking.where("wants is null").select(*columns)))
        freed(before, asking)
    return state


def edges(state: DataFrame) -> DataFrame:
    """state: gid (null without links) and shard. One row: the edges between documents of equal text, and those of them that run between shards.

    A group's edges are counted from its numbers by shard; no pair is made.
    """
    by_shard = state.where("gid is not null").groupBy("gid", "shard").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    groups = by_shard.groupBy("gid").agg(pairs(F.sum("n")).alias("edges"), F.sum(pairs(F.col("n"))).alias("inside"))
    return groups.agg(F.coalesce(F.sum("edges"), F.lit(0.0)).alias("edges"), F.coalesce(F.sum(F.col("edges") - F.col("inside")), F.lit(0.0)).alias("cut"))


def dealt(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, gid, linked and shard of each document: gid and linked (rows of the text) are null without links; shards are dealt by rank."""
    base = texts(docs).select("doc_id", F.expr("octet_length(text)").cast("long").alias("bytes"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.unhex(F.md5("text")).alias("hash"))
    cell = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(CELLS))
    base = written(base.select("doc_id", (F.col("bytes") + 8).alias("size"), "text_crc32", "hash", cell.alias("cell")))
    # a group of any share of the rows meets as CELLS counts
    counts = base.groupBy("hash", "cell").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("hash").agg(F.sum("n").alias("linked")).where("linked > 1")
    by_cell = counts.join(groups, "hash").select("hash", "cell", "linked")
    rows = ranked(base, [], [F.col("doc_id"), F.col("text_crc32")], F.xxhash64("doc_id", "text_crc32"), "place", base.count())
    rows = rows.join(by_cell, ["hash", "cell"], "left").withColumn("gid", F.when(F.col("linked").isNotNull(), F.col("hash")))
    return written(rows.select("doc_id", "size", "text_crc32", "gid", "linked", F.pmod("place", F.lit(shards)).cast("int").alias("shard")))


def assign_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law: `rows`, counts of shards are at most one apart. size: UTF-8 bytes of the text and 8. Equal texts share a shard as far
    as a shard can hold them; a text with more rows than that fills shard after shard. Null text is empty, empty texts are one group,
    repeated rows are documents of their own, a null doc_id is placed like any other. An empty table gives no rows.
    """
    state = dealt(docs, shards)
    rows = state.count()
    state = propagate(state, shards, rounds, rows)
    slots = ranked(state, ["shard"], [F.col("doc_id"), F.col("text_crc32")], F.xxhash64("doc_id", "text_crc32"), "slot", rows)
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir))
