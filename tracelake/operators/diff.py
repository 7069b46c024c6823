"""Differences between graphs, plans, file inventories and stored fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.contract import table
from tracelake.plans.projection import GRAPH_SQL, edges, nodes


def changes(base: DataFrame, head: DataFrame, key: list[str], value: str) -> DataFrame:
    """key and status: added, removed, changed (the value differs) of each key that is not the same on both sides."""
    b = base.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    h = head.select(*key, F.col(value).alias("_h"), F.lit(True).alias("_in_h"))
    both = b.join(h, key, "full")
    status = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_h").isNull(), "removed").when(~F.col("_b").eqNullSafe(F.col("_h")), "changed")
    return both.withColumn("status", status).where("status is not null").select(*key, "status")


def digest(lines: DataFrame, owner: str) -> DataFrame:
    """lines: owner and line. One fingerprint for each owner's set of lines.

    It is a digest of how many different lines there are and of the sum of their digests' first 60 bits. Sums are combined before the
    shuffle, so an owner of any number of lines never has them in one row; two sets agree if their numbers and sums do.
    """
    # Halves of the bits are summed up as long numbers, as a decimal for each line costs more than its digest.
    value = F.conv(F.substring(F.sha2("line", 256), 1, 15), 16, 10).cast("long")
    high, low = F.sum(F.shiftright(value, 30)).cast("decimal(28,0)"), F.sum(value.bitwiseAND(F.lit(2**30 - 1))).cast("decimal(28,0)")
    total = (high * F.lit(2**30).cast("decimal(10,0)") + low).cast("string")
    sums = lines.select(owner, "line").distinct().groupBy(owner).agg(F.count(F.lit(1)).alias("n"), total.alias("sum"))
    return sums.select(owner, F.substring(F.sha2(F.concat_ws(":", F.col("n").cast("string"), "sum"), 256), 1, 20).alias("fingerprint"))


def fingerprints(edges_: DataFrame) -> DataFrame:
    """node and the digest of its outgoing edges."""
    return digest(edges_.select(F.col("source").alias("node"), F.concat_ws("|", "edge_type", "target", "operation").alias("line")), "node")


def combined(members: DataFrame, prints: DataFrame) -> DataFrame:
    """members: owner, node. One digest over each owner's nodes; a node without a fingerprint counts as MISSING."""
    lines = members.join(prints, "node", "left").select("owner", F.concat_ws("=", "node", F.coalesce("fingerprint", F.lit("MISSING"))).alias("line"))
    return digest(lines, "owner")


def affected(rules: DataFrame, changed: DataFrame) -> DataFrame:
    """rules: item_id, nodes; changed: node. The rules that name a changed node."""
    return rules.select("item_id", F.explode("nodes").alias("node")).join(changed.select("node").distinct(), "node", "left_semi").select("item_id").distinct()


def stale(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Files by path and hash: changed, deleted, added."""
    return changes(recorded, current, ["path"], "sha256").withColumn("status", F.when(F.col("status") == "removed", "deleted").otherwise(F.col("status")))


def planned(plan: DataFrame, actual: DataFrame) -> DataFrame:
    """plan, actual: item. Each item as planned, unplanned or untouched."""
    p, a = plan.select("item").distinct().withColumn("_p", F.lit(1)), actual.select("item").distinct().withColumn("_a", F.lit(1))
    status = F.when(F.col("_p").isNull(), "unplanned").when(F.col("_a").isNull(), "untouched").otherwise("planned")
    return p.join(a, "item", "full").select("item", status.alias("status"))


def _base(s, d):
    return edges(s, d).where("edge_type <> 'CALLS_API' or target not like '%3'")


def _head(s, d):
    e = edges(s, d).where("edge_type <> 'DELETES' or target not like '%9'")
    return e.withColumn("confidence", F.when(F.col("target").like("table:%1"), 0.5).otherwise(F.col("confidence")))


def _files(s, d, later=False):
    p = table(s, d, "pages")
    html = F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("<!-- new -->"))).otherwise(F.col("html")) if later else F.col("html")
    keep = p.where("page_id % 11 <> 0") if later else p.where("page_id % 13 <> 0")
    return keep.select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.sha2(html, 256).alias("sha256"))


QUERIES = {
    "graph_diff_edges": lambda s, d: changes(_base(s, d), _head(s, d), ["edge_id"], "confidence"),
    "fingerprints": lambda s, d: fingerprints(edges(s, d)),
    "combined_fingerprints": lambda s, d: combined(edges(s, d).where("edge_type = 'CALLS_API'").select(F.col("source").alias("owner"), F.col("target").alias("node")), fingerprints(edges(s, d))),
    "graph_diff_modified": lambda s, d: changes(fingerprints(_base(s, d)), fingerprints(_head(s, d)), ["node"], "fingerprint").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first_node")),
    "stale_files": lambda s, d: stale(_files(s, d), _files(s, d, True)),
    "plan_compare": lambda s, d: planned(nodes(s, d).where("node_type = 'TABLE'").select(F.lower("name").alias("item")), nodes(s, d).where("node_type in ('TABLE', 'APPLICATION') and database_key is distinct from 'Brand#1'").select(F.lower("name").alias("item"))),
    "affected_rules": lambda s, d: affected(table(s, d, "benchmark").select("item_id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(F.lit("table:"), ((F.col("item_id") * 5 + k) % 600).cast("string"))).alias("nodes")), edges(s, d).where("edge_type = 'READS'").select(F.col("target").alias("node"))),
}

_BASE = ", base as (select * from edges where edge_type <> 'CALLS_API' or target not like '%3'), head as (select edge_id, source, target, edge_type, layer, operation, case when target like 'table:%1' then 0.5 else confidence end::double as confidence from edges where edge_type <> 'DELETES' or target not like '%9') "
_DIGEST = "substr(sha256(count(*) || ':' || sum(('0x' || substr(sha256(line), 1, 15))::bigint)), 1, 20)"
_PRINT = "select node, " + _DIGEST + " as fingerprint from (select distinct source as node, concat_ws('|', edge_type, target, operation) as line from {}) group by 1"
ORACLES = {
    "graph_diff_edges": GRAPH_SQL + _BASE + "select edge_id, case when b.edge_id is null then 'added' when h.edge_id is null then 'removed' else 'changed' end as status from base b full join head h using (edge_id) where b.edge_id is null or h.edge_id is null or b.confidence <> h.confidence",
    "fingerprints": GRAPH_SQL + _PRINT.format("edges"),
    "combined_fingerprints": GRAPH_SQL + f", p as ({_PRINT.format('edges')}), l as (select distinct e.source as owner, target || '=' || coalesce(fingerprint, 'MISSING') as line from edges e left join p on target = node where edge_type = 'CALLS_API') select owner, {_DIGEST} as fingerprint from l group by 1",
    "graph_diff_modified": GRAPH_SQL + _BASE + f", b as ({_PRINT.format('base')}), h as ({_PRINT.format('head')}), x as (select node, case when b.fingerprint is null then 'added' when h.fingerprint is null then 'removed' when b.fingerprint <> h.fingerprint then 'changed' end as status from b full join h using (node)) select status, count(*) as n, min(node) as first_node from x where status is not null group by 1",
    "stale_files": "with a as (select 'page/' || page_id as path, sha256(html) as x from pages where page_id % 13 <> 0), b as (select 'page/' || page_id as path, sha256(case when page_id % 7 = 0 then html || '<!-- new -->' else html end) as x from pages where page_id % 11 <> 0) select path, case when a.x is null then 'added' when b.x is null then 'deleted' else 'changed' end as status from a full join b using (path) where a.x is distinct from b.x",
    "plan_compare": GRAPH_SQL + "select item, case when p is null then 'unplanned' when a is null then 'untouched' else 'planned' end as status from (select distinct lower(name) as item, 1 as p from nodes where node_type = 'TABLE') full join (select distinct lower(name) as item, 1 as a from nodes where node_type in ('TABLE', 'APPLICATION') and database_key is distinct from 'Brand#1') using (item)",
    "affected_rules": GRAPH_SQL + ", c as (select distinct target from edges where edge_type = 'READS'), r as (select item_id, 'table:' || ((item_id * 5 + k) % 600) as node from benchmark, (values (0), (1), (2)) v(k)) select distinct item_id from r where node in (select target from c)",
}
