"""Joins of the graph: resolution of references, fallbacks, ownership of spans, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.contract import table
from tracelake.operators.ranks import first_of
from tracelake.plans.projection import GRAPH_SQL, edges, evidence, nodes


#: Bits of the filter of `maybe`, in words of 64: a table of at most 262,144 rows goes to every task.
BITS = 1 << 24


def maybe(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows whose key has a hash that a key of the others has too: all that a join on the key finds, and few more while the others are fewer than BITS. The join is left to do, on much less."""
    bit = lambda df: df.withColumn("_bit", F.xxhash64(key).bitwiseAND(F.lit(BITS - 1)))
    held = bit(others).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_held"))
    near = bit(rows).join(F.broadcast(held), F.shiftright("_bit", 6) == F.col("_word"))
    return near.where(F.getbit("_held", (F.col("_bit") % 64).cast("int")) == 1).select(*rows.columns)


def unique_matches(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Each left row with its match by key if there is exactly one; status is unique, ambiguous or missing.

    The right side is counted by key before the join, so a frequent key is one row of it.
    """
    by_key = right.groupBy(key).agg(F.count_distinct(right_id).alias("_n"), F.min(right_id).alias("_id"))
    joined = left.join(by_key, key, "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "unique").otherwise("ambiguous")
    return joined.select(left_id, status.alias("status"), F.when(F.col("_n") == 1, F.col("_id")).alias("match_id"))


def suffixes(route: Column) -> Column:
    """All suffixes of a route's segments, the longest first."""
    parts = F.filter(F.split(route, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/")))


def longest_suffix(calls: DataFrame, operations: DataFrame) -> DataFrame:
    """calls: call_id, route; operations: operation_id, route. All operations whose whole route is the longest suffix of the call's, each with their number.

    A call explodes into its suffixes, so the theta condition becomes an equi join. One operation is a match, several are an ambiguity that the caller sees.
    """
    tails = calls.select("call_id", F.posexplode(suffixes(F.col("route"))).alias("skipped", "tail"))
    ops = operations.select(F.array_join(F.filter(F.split("route", "/"), lambda p: p != ""), "/").alias("tail"), "operation_id").distinct()
    often = ops.groupBy("tail").agg(F.count(F.lit(1)).alias("matches"))
    best = tails.join(often, "tail").groupBy("call_id").agg(F.min(F.struct("skipped", "tail", "matches")).alias("m")).select("call_id", "m.*")
    return best.join(ops, "tail").select("call_id", "operation_id", "skipped", "matches")


def preferred_names(ids: DataFrame, names: DataFrame, locale: str, fallback: str = "en") -> DataFrame:
    """The name in the wanted locale, else in the fallback, else null; names: target_id, locale, value, one row each."""
    of = lambda code, alias: names.where(F.col("locale") == code).groupBy("target_id").agg(F.min("value").alias(alias))
    return ids.join(of(locale, "_a"), "target_id", "left").join(of(fallback, "_b"), "target_id", "left").select("target_id", F.coalesce("_a", "_b").alias("value"), F.when(F.col("_a").isNotNull(), locale).when(F.col("_b").isNotNull(), fallback).alias("locale"))


def with_precedence(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of the first table, and those of the second whose key the first lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def span_owner(comments: DataFrame, spans: DataFrame, near: int = 2, width: int = 64) -> DataFrame:
    """comments: comment_id, path, line; spans: owner_id, path, start, end. The tightest span that contains a comment, else the nearest one that starts
    up to `near` lines after it, else the file.

    Spans are dealt to bins of lines they cover, so the interval join is an equi join by path and bin. Whose a comment is depends on its line only, and of equal spans only the smallest
    owner's counts, so it is lines that meet spans, each once.
    """
    spans = spans.groupBy("path", "start", "end").agg(F.min("owner_id").alias("owner_id"))
    lines = comments.select("path", "line").distinct()
    bins = spans.select("owner_id", "path", "start", "end", F.explode(F.sequence(F.floor((F.col("start") - near) / width), F.floor(F.col("end") / width))).alias("bin"))
    placed = lines.withColumn("bin", F.floor(F.col("line") / width))
    inside = (F.col("line") >= F.col("start")) & (F.col("line") <= F.col("end"))
    soon = (F.col("start") > F.col("line")) & (F.col("start") - F.col("line") <= near)
    hits = placed.join(bins, ["path", "bin"]).where(inside | soon)
    rank = F.struct(F.when(inside, 0).otherwise(1).alias("tier"), F.when(inside, F.col("end") - F.col("start")).otherwise(F.col("start") - F.col("line")).alias("size"), F.col("owner_id"))
    best = hits.groupBy("path", "line").agg(F.min(rank).alias("b"))
    return comments.join(best, ["path", "line"], "left").select("comment_id", F.coalesce("b.owner_id", F.concat(F.lit("file:"), "path")).alias("owner_id"), F.coalesce(F.col("b.tier"), F.lit(2)).alias("tier"))


def candidates(references: DataFrame, targets: DataFrame, keep: int = 10, minimum: float = 0.85) -> DataFrame:
    """references and targets: id, name, qualified, database, schema. The best `keep` targets of the same upper name for each reference.

    The name scores 0.65, the database 0.2, the schema 0.1, and a target whose qualified name ends in the reference's 0.05, 1 at most. From `minimum`
    on a candidate is eligible. What scores alike is one class: of each class of targets only the `keep` smallest ids can be taken, and equal references are scored once.
    """
    parts = ["leaf", "database", "schema", "qualified"]
    upper = [F.upper("name").alias("leaf"), *(F.upper(F.coalesce(c, F.lit(""))).alias(c) for c in parts[1:])]
    r = references.select(F.col("id").alias("reference_id"), *upper)
    t = targets.select(F.col("id").alias("candidate_id"), *upper)
    few = first_of(t, parts, "candidate_id", ["candidate_id"], keep)
    named = few.select("leaf", *(F.col(c).alias(f"t_{c}") for c in parts[1:]), "candidate_id")
    pairs = r.select(*parts).distinct().join(named, "leaf")
    same = lambda c, by: F.when((F.col(c) != "") & (F.col(c) == F.col(f"t_{c}")), by).otherwise(0.0)
    tail = F.when(F.endswith("t_qualified", "qualified"), 0.05).otherwise(0.0)
    scored = pairs.withColumn("score", F.round(F.least(F.lit(1.0), F.lit(0.65) + same("database", 0.2) + same("schema", 0.1) + tail), 2))
    best = first_of(scored, parts, "candidate_id", [F.desc("score"), "candidate_id"], keep, "rank").select(*parts, "candidate_id", "score", "rank")
    return r.join(best, parts).select("reference_id", "candidate_id", "score", "rank", F.when(F.col("score") >= minimum, "eligible").otherwise("observe").alias("status"))


def dangling(edges_: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Ends of edges without a node, and how many edges name them."""
    ends = edges_.select(F.col("source").alias("id")).unionByName(edges_.select(F.col("target").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return ends.join(nodes_.select(F.col("stable_id").alias("id")), "id", "left_anti")


def _names(s, d):
    docs = table(s, d, "documents")
    return docs.select(F.concat(F.lit("table:"), (F.col("doc_id") % 97).cast("string")).alias("target_id"), F.col("lang").alias("locale"), F.sha2("text", 256).alias("value"))


def _parts(s, d, fold=False):
    name = F.upper("p_name") if fold else F.col("p_name")
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("database"), F.col("p_type").alias("schema"), F.concat_ws(".", F.col("p_type") if fold else F.lit(None).cast("string"), "p_name").alias("qualified"))


def _calls(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("/api/v1/"), F.lower("o_orderstatus"), F.lit("/"), (F.col("o_orderkey") % 50).cast("string")).alias("route"))


def _operations(s, d):
    c = table(s, d, "customer")
    long = c.select(F.concat(F.lit("op:"), F.col("c_custkey").cast("string")).alias("operation_id"), F.concat(F.lit("/o/"), F.col("c_custkey").cast("string")).alias("route"))
    short = c.select(F.concat(F.lit("tail:"), F.col("c_custkey").cast("string")).alias("operation_id"), F.concat(F.lit("/"), F.col("c_custkey").cast("string")).alias("route"))
    return long.unionByName(short)


def _comments(s, d):
    e = table(s, d, "events")
    comments = e.select(F.col("event_id").alias("comment_id"), F.concat(F.lit("f"), (F.col("event_id") % 11).cast("string")).alias("path"), (F.col("event_id") % 400).cast("int").alias("line"))
    p = table(s, d, "part")
    spans = p.select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("owner_id"), F.concat(F.lit("f"), (F.col("p_partkey") % 13).cast("string")).alias("path"), ((F.col("p_partkey") * 37) % 390).cast("int").alias("start"), ((F.col("p_partkey") * 37) % 390 + F.col("p_size") % 30).cast("int").alias("end"))
    return comments, spans


QUERIES = {
    "unique_match_join": lambda s, d: unique_matches(_parts(s, d).select(F.col("id").alias("ref_id"), F.concat_ws(".", "database", "schema", "name").alias("key")), _parts(s, d).where("id % 3 <> 0").select(F.concat_ws(".", "database", "schema", "name").alias("key"), "id"), "key", "ref_id", "id"),
    "longest_suffix_join": lambda s, d: longest_suffix(_calls(s, d), _operations(s, d)),
    "localized_name_fallback": lambda s, d: preferred_names(nodes(s, d).where("node_type = 'TABLE'").select(F.col("stable_id").alias("target_id")), _names(s, d), "de"),
    "mapping_precedence_union_anti": lambda s, d: with_precedence(_names(s, d).where("locale = 'fr'").select("target_id", "locale", "value"), _names(s, d).where("locale = 'en'").select("target_id", "locale", "value"), "target_id"),
    "concepts_without_links": lambda s, d: table(s, d, "benchmark").join(table(s, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("item_id")), "item_id", "left_anti").select("item_id"),
    "comment_owner_interval_join": lambda s, d: span_owner(*_comments(s, d)),
    "resolution_candidates_top10": lambda s, d: candidates(_parts(s, d), _parts(s, d, True)),
    "dangling_endpoints": lambda s, d: dangling(edges(s, d), nodes(s, d).where("not (node_type = 'TABLE' and stable_id like '%7')")),
    "orphan_evidence": lambda s, d: evidence(s, d).join(edges(s, d).where("edge_type <> 'DELETES'").select("edge_id"), "edge_id", "left_anti").groupBy("source_path").agg(F.count(F.lit(1)).alias("n")),
    "first_evidence_per_edge": lambda s, d: evidence(s, d).groupBy("edge_id").agg(F.min(F.struct("start_line", "source_path", "confidence")).alias("m")).select("edge_id", "m.*"),
    "path_actor_join": lambda s, d: edges(s, d).where("edge_type = 'CALLS_API'").join(nodes(s, d).select(F.col("stable_id").alias("source"), "system_key"), "source").groupBy("system_key").agg(F.count(F.lit(1)).alias("calls"), F.min("target").alias("first_target")),
    "hierarchy_attach": lambda s, d: nodes(s, d).where("node_type in ('SCREEN', 'APPLICATION', 'API_OPERATION')").join(edges(s, d).where("layer = 'STRUCTURAL'").select(F.col("target").alias("stable_id"), F.col("source").alias("parent")), "stable_id", "left").groupBy("node_type").agg(F.count("parent").alias("attached"), F.count_if(F.col("parent").isNull()).alias("roots")),
    "job_predecessor_self_join": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", "role").join(table(s, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before")), ["conv_id", "turn"]).groupBy("before", "role").agg(F.count(F.lit(1)).alias("n")),
}

_NAMES = "names as (select 'table:' || (doc_id % 97) as target_id, lang as locale, sha256(text) as value from documents)"
_PARTS = "parts as (select p_partkey as id, p_name as name, p_brand as database, p_type as schema from part)"
ORACLES = {
    "unique_match_join": f"with {_PARTS}, k as (select database || '.' || schema || '.' || name as key, id from parts), r as (select key, count(distinct id) as n, min(id) as m from k where id % 3 <> 0 group by 1) select k.id as ref_id, case when n is null then 'missing' when n = 1 then 'unique' else 'ambiguous' end as status, case when n = 1 then m end as match_id from k left join r using (key)",
    "longest_suffix_join": """with calls as (select o_orderkey as call_id, 'api/v1/' || lower(o_orderstatus) || '/' || (o_orderkey % 50) as route from orders),
      ops as (select 'op:' || c_custkey as operation_id, 'o/' || c_custkey as route from customer union all select 'tail:' || c_custkey, c_custkey::varchar from customer),
      m as (select call_id, operation_id, o.route from calls c join ops o on c.route = o.route or c.route like '%/' || o.route qualify rank() over (partition by call_id order by length(o.route) desc) = 1)
      select call_id, operation_id, (4 - len(string_split(route, '/')))::int as skipped, count(*) over (partition by call_id) as matches from m""",
    "localized_name_fallback": f"with {_NAMES}, a as (select target_id, min(value) as v from names where locale = 'de' group by 1), b as (select target_id, min(value) as v from names where locale = 'en' group by 1) select t.target_id, coalesce(a.v, b.v) as value, case when a.v is not null then 'de' when b.v is not null then 'en' end as locale from (select 'table:' || p_partkey as target_id from part) t left join a using (target_id) left join b using (target_id)",
    "mapping_precedence_union_anti": f"with {_NAMES} select target_id, locale, value from names where locale = 'fr' union all select target_id, locale, value from names where locale = 'en' and target_id not in (select target_id from names where locale = 'fr')",
    "concepts_without_links": "select item_id from benchmark where item_id not in (select doc_id from labels where toxic = 0)",
    "comment_owner_interval_join": """with c as (select event_id as comment_id, 'f' || (event_id % 11) as path, (event_id % 400)::int as line from events),
      s as (select 'd' || p_partkey as owner_id, 'f' || (p_partkey % 13) as path, ((p_partkey * 37) % 390)::int as a, ((p_partkey * 37) % 390 + p_size % 30)::int as b from part),
      h as (select comment_id, owner_id, case when line between a and b then 0 else 1 end as tier, case when line between a and b then b - a else a - line end as size from c join s using (path) where line between a and b or a - line between 1 and 2),
      w as (select * from h qualify row_number() over (partition by comment_id order by tier, size, owner_id) = 1)
      select comment_id, coalesce(owner_id, 'file:' || path) as owner_id, coalesce(tier, 2) as tier from c left join w using (comment_id)""",
    "resolution_candidates_top10": f"with {_PARTS}, x as (select r.id as reference_id, t.id as candidate_id, round(least(1.0, 0.65 + case when r.database = t.database then 0.2 else 0 end + case when r.schema = t.schema then 0.1 else 0 end + case when suffix(upper(t.schema || '.' || t.name), upper(r.name)) then 0.05 else 0 end), 2)::double as score from parts r join parts t on upper(r.name) = upper(t.name)), y as (select *, row_number() over (partition by reference_id order by score desc, candidate_id)::int as rank from x) select *, case when score >= 0.85 then 'eligible' else 'observe' end as status from y where rank <= 10",
    "dangling_endpoints": GRAPH_SQL + "select target as id, count(*) as n from edges where target like 'table:%7' group by 1",
    "orphan_evidence": GRAPH_SQL + "select source_path, count(*) as n from evidence where edge_id not in (select edge_id from edges where edge_type <> 'DELETES') group by 1",
    "first_evidence_per_edge": GRAPH_SQL + "select edge_id, start_line, source_path, confidence from evidence qualify row_number() over (partition by edge_id order by start_line, source_path, confidence) = 1",
    "path_actor_join": GRAPH_SQL + "select system_key, count(*) as calls, min(target) as first_target from edges join nodes on source = stable_id where edge_type = 'CALLS_API' group by 1",
    "hierarchy_attach": GRAPH_SQL + "select node_type, count(p) as attached, count(*) filter (p is null) as roots from nodes left join (select target, source as p from edges where layer = 'STRUCTURAL') on target = stable_id where node_type in ('SCREEN', 'APPLICATION', 'API_OPERATION') group by 1",
    "job_predecessor_self_join": "select b.role as before, a.role, count(*) as n from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1 group by all",
}
