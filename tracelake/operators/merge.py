"""Merging of sources: duplicates, survivors, aliases, compact ids, replacements and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.contract import edge_id, table
from tracelake.functions.names import small_id
from tracelake.plans.projection import GRAPH_SQL, edges, evidence, nodes, shipments
from tracelake.sources.scratch import written


def survivors(df: DataFrame, key: list[str], id_column: str) -> DataFrame:
    """id and survivor of every row: of the rows of a key, the shortest id stays, then the smallest.

    The survivor is an aggregate, so partial results meet and no key is sorted as a whole.
    """
    best = df.groupBy(*key).agg(F.min(F.struct(F.length(id_column).alias("n"), F.col(id_column).alias("id"))).alias("best"))
    return df.join(best, key).select(F.col(id_column).alias("id"), F.col("best.id").alias("survivor"))


def rewritten(edges_: DataFrame, aliases: DataFrame) -> DataFrame:
    """aliases: id, survivor. Edges with both ends replaced, their ids computed anew, and those that fall together merged."""
    a = aliases.select(F.col("id").alias("source"), F.col("survivor").alias("_s"))
    b = aliases.select(F.col("id").alias("target"), F.col("survivor").alias("_t"))
    ends = edges_.join(a, "source", "left").join(b, "target", "left").withColumn("source", F.coalesce("_s", "source")).withColumn("target", F.coalesce("_t", "target"))
    return merged_edges(ends.withColumn("edge_id", edge_id(F.col("source"), F.col("edge_type"), F.col("target"), F.col("operation"), F.col("layer"))))


def merged_edges(edges_: DataFrame) -> DataFrame:
    """One edge of each id, with the highest confidence and the number of rows it stands for; order of the input doesn't matter."""
    return edges_.groupBy("edge_id").agg(F.first("source").alias("source"), F.first("target").alias("target"), F.first("edge_type").alias("edge_type"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("copies"))


def merged_rows(df: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """Symmetric merge of duplicate rows. rules: column to max, min, longest or first_text (the smallest non-empty one)."""
    how = {
        "max": lambda c: F.max(c),
        "min": lambda c: F.min(c),
        "longest": lambda c: F.max(F.struct(F.length(c).alias("n"), F.col(c).alias("v")))["v"],
        "first_text": lambda c: F.min(F.when(F.col(c) != "", F.col(c))),
    }
    return df.groupBy(*key).agg(*[how[rule](c).alias(c) for c, rule in rules.items()])


def compact_ids(keys: DataFrame, bits: int = 60, rounds: int = 20) -> DataFrame:
    """keys: stable_id, distinct. stable_id and id, a number below 2^bits for each, from a digest and without collisions.

    Where several ids share a number the smallest keeps it, and the others are salted; a salted number that is taken, or is shared again, is salted anew. A number
    depends on the ids alone, not on the order or number of their rows. Collisions are few, so all but the first round are small.
    """
    number = lambda salt: small_id(F.col("stable_id"), salt) % F.lit(1 << bits)
    done, left = None, keys.select("stable_id")
    for salt in range(rounds):
        tried = left.withColumn("id", number(salt))
        first = tried.groupBy("id").agg(F.min("stable_id").alias("stable_id"))
        won = written((first if done is None else first.join(done, "id", "left_anti")).select("stable_id", "id"))
        done = won if done is None else done.unionByName(won)
        left = written(left.join(won, "stable_id", "left_anti"))
        if left.isEmpty():
            return done
    raise ValueError(f"{bits} bits are too few")


def with_compact_ends(edges_: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with the small ids of both ends in place of the stable ones."""
    of = lambda end: ids.select(F.col("stable_id").alias(end), F.col("id").alias(f"_{end}"))
    return edges_.join(of("source"), "source").join(of("target"), "target").withColumn("source", F.col("_source")).withColumn("target", F.col("_target")).drop("_source", "_target")


def insert_or_ignore(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(key, "_r.*")


def latest(df: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in df.columns if c != key and c not in version]
    return df.groupBy(key).agg(F.max(F.struct(*version, *rest)).alias("_r")).select(key, "_r.*")


def round_robin(edges_: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """A sample over all types in turns, in an order that only the ids and the seed decide."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("edge_id")), 256)
    # The first n of a type suffice: a cell of its order keeps them before the type is ranked as a whole.
    cell = F.conv(F.substring(order, 1, 2), 16, 10).cast("int")
    best = edges_.select("edge_id", "edge_type", order.alias("o"), cell.alias("cell"))
    best = best.withColumn("k", F.row_number().over(Window.partitionBy("edge_type", "cell").orderBy("o"))).where(F.col("k") <= n)
    best = best.withColumn("turn", F.row_number().over(Window.partitionBy("edge_type").orderBy("o"))).where(F.col("turn") <= n)
    return best.orderBy("turn", "edge_type").limit(n).select("edge_id", "edge_type", "turn")


def _parts(s, d):
    return table(s, d, "part").select(F.concat(F.lit("table:"), F.col("p_partkey").cast("string")).alias("id"), "p_name", "p_brand", "p_type", "p_size")


def _raw_accesses(s, d):
    rows = shipments(s, d)
    source = F.concat_ws(":", F.lit("method"), F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string"))
    target = F.concat(F.lit("table:"), F.col("l_partkey").cast("string"))
    return rows.select(edge_id(source, F.col("access"), target, F.col("operation"), F.lit("TECHNICAL")).alias("edge_id"), source.alias("source"), target.alias("target"), F.col("access").alias("edge_type"), "confidence")


QUERIES = {
    "node_dedup_survivor": lambda s, d: survivors(_parts(s, d), ["p_brand", "p_type", "p_name"], "id"),
    "edge_dedup_merge": lambda s, d: merged_edges(_raw_accesses(s, d)),
    "edge_identity_sha": lambda s, d: edges(s, d).where("edge_type = 'CALLS_API'").select("edge_id", "source", "target"),
    "alias_rewrite_edges": lambda s, d: rewritten(edges(s, d).where("edge_type = 'READS'"), survivors(_parts(s, d), ["p_brand", "p_type", "p_name"], "id")).select("edge_id", "source", "target", "confidence", "copies"),
    "duplicate_row_merge": lambda s, d: merged_rows(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate", F.col("l_linestatus").alias("status")), ["l_orderkey", "l_linenumber"], {"l_quantity": "max", "l_returnflag": "first_text", "l_shipdate": "min", "status": "longest"}),
    "compact_ids_unique": lambda s, d: compact_ids(nodes(s, d).select("stable_id")),
    "compact_edges": lambda s, d: with_compact_ends(edges(s, d).where("edge_type = 'CALLS_API'"), compact_ids(nodes(s, d).where("node_type in ('SCREEN', 'API_OPERATION')").select("stable_id"))).select("edge_id", "source", "target"),
    "insert_or_ignore_evidence": lambda s, d: insert_or_ignore(evidence(s, d), "edge_id", ["source_path", "start_line", "confidence"]),
    "rules_latest_version": lambda s, d: latest(table(s, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type"),
    "stratified_edge_sample": lambda s, d: round_robin(edges(s, d), 60),
    "multi_source_union_merge": lambda s, d: merged_edges(edges(s, d).select("edge_id", "source", "target", "edge_type", "confidence").unionByName(_raw_accesses(s, d))).groupBy("edge_type", "copies").agg(F.count(F.lit(1)).alias("n")),
    "distinct_package_keys": lambda s, d: nodes(s, d).select(F.col("system_key").alias("package")).unionByName(nodes(s, d).select(F.col("database_key").alias("package"))).where("package is not null").distinct(),
}

_SMALL = "('0x' || substr(sha256({}), 1, 15))::bigint"
ORACLES = {
    "compact_ids_unique": GRAPH_SQL + f"select stable_id, {_SMALL.format('stable_id')} as id from nodes",
    "compact_edges": GRAPH_SQL + f"select edge_id, {_SMALL.format('source')} as source, {_SMALL.format('target')} as target from edges where edge_type = 'CALLS_API'",
    "node_dedup_survivor": "select 'table:' || p_partkey as id, 'table:' || min(p_partkey) over (partition by p_brand, p_type, p_name) as survivor from part",
    "edge_dedup_merge": GRAPH_SQL + "select sha256(concat_ws('|', source, access, target, operation, 'TECHNICAL')) as edge_id, source, target, access as edge_type, max(confidence) as confidence, count(*) as copies from shipments group by all",
    "edge_identity_sha": "select sha256('screen:' || o_custkey || '|CALLS_API|api-operation:' || o_orderkey || '||DATA_FLOW') as edge_id, 'screen:' || o_custkey as source, 'api-operation:' || o_orderkey as target from orders",
    "alias_rewrite_edges": GRAPH_SQL + ", alias as (select 'table:' || p_partkey as id, 'table:' || min(p_partkey) over (partition by p_brand, p_type, p_name) as survivor from part) select sha256(concat_ws('|', source, edge_type, survivor, operation, layer)) as edge_id, source, survivor as target, max(confidence) as confidence, count(*) as copies from edges join alias on target = id where edge_type = 'READS' group by source, edge_type, survivor, operation, layer",
    "duplicate_row_merge": "select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, min(l_returnflag) as l_returnflag, min(l_shipdate) as l_shipdate, max(l_linestatus) as status from lineitem group by 1, 2",
    "insert_or_ignore_evidence": GRAPH_SQL + "select edge_id, source_path, start_line, confidence from evidence qualify row_number() over (partition by edge_id order by source_path, start_line, confidence) = 1",
    "rules_latest_version": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "stratified_edge_sample": GRAPH_SQL + "select edge_id, edge_type, turn::int as turn from (select edge_id, edge_type, row_number() over (partition by edge_type order by sha256('1|' || edge_id)) as turn from edges) order by turn, edge_type limit 60",
    "multi_source_union_merge": GRAPH_SQL + "select edge_type, copies, count(*) as n from (select edge_id, edge_type, count(*) as copies from (select edge_id, edge_type from edges union all select sha256(concat_ws('|', source, access, target, operation, 'TECHNICAL')), access from shipments) group by all) group by all",
    "distinct_package_keys": GRAPH_SQL + "select system_key as package from nodes where system_key is not null union select database_key from nodes where database_key is not null",
}
