"""The business tree: menus of features of flows, each flow with one owner, and what has lost its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.contract import FLOW_PARTS, STEP_EDGES, table
from tracelake.operators.frontier import leading, tree
from tracelake.operators.joins import maybe
from tracelake.operators.ranks import first_of
from tracelake.plans.calls import CALLS_SQL, call_edges, call_nodes
from tracelake.sources.scratch import written

# What holds flows, and the flows that it holds; menus that no route names; operations that are listed without a place.
PARTS = {"SCREEN": "UI_ACTION", "JOB_NETWORK": "JOB"}
BATCH, STRANDED, UNSORTED = "menu:batch", "menu:stranded", "menu:unsorted"
LISTED = 300


def features(nodes_: DataFrame, routes: DataFrame) -> DataFrame:
    """nodes: stable_id, node_type; routes: stable_id, route. feature, entry, node_type, menu: screens by the first segment of their route, job networks in one menu."""
    first = F.lower(F.get(F.filter(F.split("route", "/"), lambda p: (p != "") & ~F.startswith(p, F.lit(":"))), F.lit(0)))
    rows = nodes_.where(F.col("node_type").isin(*PARTS)).select("stable_id", "node_type").join(routes, "stable_id", "left")
    menu = F.when(F.col("node_type") == "JOB_NETWORK", BATCH).otherwise(F.concat(F.lit("menu:"), F.coalesce(first, F.lit("home"))))
    return rows.select(F.concat(F.lit("feature:"), "stable_id").alias("feature"), F.col("stable_id").alias("entry"), "node_type", menu.alias("menu"))


def given(features_: DataFrame, nodes_: DataFrame, extra: DataFrame) -> DataFrame:
    """extra: feature, entry. Those whose feature and entry there are."""
    known = written(extra.join(features_.select("feature"), "feature", "left_semi").select("feature", "entry"))
    return written(known.join(maybe(nodes_.select(F.col("stable_id").alias("entry")), known, "entry"), "entry", "left_semi").select("feature", "entry"))


def flow_owners(features_: DataFrame, nodes_: DataFrame, edges_: DataFrame, extra: DataFrame, docs: DataFrame) -> DataFrame:
    """flow, feature: each flow under one of the features that list it: the one its document was saved under, else the first.

    A feature lists the actions or jobs that it contains, itself where it contains none, and the entries that people gave it. extra: feature, entry, as from `given`; docs: flow, feature.
    """
    kinds = nodes_.where(F.col("node_type").isin(*PARTS.values())).select(F.col("stable_id").alias("target"), F.col("node_type").alias("part_type"))
    held = edges_.where("edge_type = 'CONTAINS'").select(F.col("source").alias("entry"), "target").join(kinds, "target").join(features_, "entry")
    wanted = F.when(F.col("node_type") == "SCREEN", PARTS["SCREEN"]).otherwise(PARTS["JOB_NETWORK"])
    held = held.where(F.col("part_type") == wanted).select("feature", F.col("target").alias("part"))
    itself = features_.join(held.select("feature").distinct(), "feature", "left_anti").select("feature", F.col("entry").alias("part"))
    listed = held.unionByName(itself).unionByName(extra.select("feature", F.col("entry").alias("part"))).distinct().select("feature", F.concat(F.lit("flow:"), "part").alias("flow"))
    saved = docs.select("flow", F.col("feature").alias("saved"))
    # The choice is a minimum, so it is made before flows that many features share come together.
    choice = F.min(F.struct((~F.coalesce(F.col("saved") == F.col("feature"), F.lit(False))).alias("other"), "feature")).alias("c")
    return listed.join(saved, "flow", "left").groupBy("flow").agg(choice).select("flow", F.col("c.feature").alias("feature"))


def unassigned(features_: DataFrame, nodes_: DataFrame, edges_: DataFrame, extra: DataFrame) -> DataFrame:
    """stable_id of the operations that no feature reaches and nobody gave to one. extra: feature, entry, as from `given`.

    All starts are walked as one, along those steps only that lead to an operation.
    """
    parts = nodes_.where(F.col("node_type").isin(*FLOW_PARTS)).select(F.col("stable_id").alias("target"))
    held = edges_.where("edge_type = 'CONTAINS'").select("source", "target").join(parts, "target", "left_semi")
    links = edges_.where(F.col("edge_type").isin(*STEP_EDGES)).select("source", "target").unionByName(held)
    links = written(links.select(F.col("source").alias("state"), F.col("target").alias("to")), compression="zstd")
    operations = written(nodes_.where("node_type = 'API_OPERATION'").select(F.col("stable_id").alias("state")))
    ahead = leading(operations, links, []).select(F.col("state").alias("to"))
    moves = links.join(ahead, "to", "left_semi").select(F.col("state").alias("at"), "to", F.lit("").alias("edge_id"), F.lit(True).alias("onward"))
    starts = features_.select("entry").unionByName(extra.select("entry")).distinct().select(F.lit("all").alias("start"), F.col("entry").alias("state"))
    reached = tree(starts, moves, 1_000_000).select("state")
    return operations.join(reached, "state", "left_anti").join(extra.select(F.col("entry").alias("state")), "state", "left_anti").select(F.col("state").alias("stable_id"))


def business_tree(nodes_: DataFrame, edges_: DataFrame, routes: DataFrame, extra: DataFrame, docs: DataFrame) -> DataFrame:
    """menu, feature, item, kind (flow, document, stranded, operation), documented. docs: flow, feature, one for each flow.

    flow: what a feature owns; document: one whose flow no feature lists any more, under the feature it was saved with; stranded: one whose feature is gone too; operation: the first LISTED
    operations without a place, by id. Features without flows have a row without item.
    """
    of = written(features(nodes_, routes))
    extra = given(of, nodes_, extra)
    owned = written(flow_owners(of, nodes_, edges_, extra, docs))
    told = owned.join(docs.select("flow", F.lit(True).alias("documented")), "flow", "left")
    flows = of.select("menu", "feature").join(told, "feature", "left").select("menu", "feature", F.col("flow").alias("item"), F.lit("flow").alias("kind"), F.coalesce("documented", F.lit(False)).alias("documented"))
    left = docs.join(owned.select("flow"), "flow", "left_anti").join(of.select("feature", "menu"), "feature", "left")
    kept = left.select(F.coalesce("menu", F.lit(STRANDED)).alias("menu"), "feature", F.col("flow").alias("item"), F.when(F.col("menu").isNull(), "stranded").otherwise("document").alias("kind"), F.lit(True).alias("documented"))
    lost = first_of(unassigned(of, nodes_, edges_, extra).withColumn("menu", F.lit(UNSORTED)), ["menu"], "stable_id", ["stable_id"], LISTED)
    lost = lost.select("menu", F.lit(None).cast("string").alias("feature"), F.concat(F.lit("entry:"), "stable_id").alias("item"), F.lit("operation").alias("kind"), F.lit(False).alias("documented"))
    return flows.unionByName(kept).unionByName(lost)


def menu_sums(rows: DataFrame) -> DataFrame:
    """menu, features, items, documented: what each menu holds, summed up from the rows of its features."""
    by_feature = rows.groupBy("menu", "feature").agg(F.count("item").alias("items"), F.count_if("documented").alias("documented"))
    return by_feature.groupBy("menu").agg(F.count("feature").alias("features"), F.sum("items").alias("items"), F.sum("documented").alias("documented"))


def _graph(s, d):
    """The graph of calls with actions that screens share, and job networks."""
    ids = lambda kind, key: F.concat(F.lit(f"{kind}:"), key.cast("string"))
    c, n = table(s, d, "customer"), table(s, d, "supplier")
    held = c.where("c_custkey % 3 = 0").select(ids("screen", F.col("c_custkey")).alias("source"), ids("action", F.col("c_custkey") % 97).alias("target"))
    held = held.unionByName(n.where("s_nationkey % 4 <> 0").select(ids("network", F.col("s_nationkey")).alias("source"), ids("job", F.col("s_suppkey")).alias("target")))
    more = held.select(F.col("target").alias("stable_id")).where("stable_id like 'action:%'").distinct().withColumn("node_type", F.lit("UI_ACTION"))
    more = more.unionByName(n.select(ids("network", F.col("s_nationkey")).alias("stable_id"), F.lit("JOB_NETWORK").alias("node_type")).distinct())
    # every fourth screen's operations are called by nobody
    calls = call_edges(s, d).select("edge_id", "source", "target", "edge_type").where("not (edge_type = 'CALLS_API' and substring_index(source, ':', -1) % 4 = 0)")
    held = held.select(F.concat_ws(">", "source", "target").alias("edge_id"), "source", "target", F.lit("CONTAINS").alias("edge_type"))
    return call_nodes(s, d).select("stable_id", "node_type").unionByName(more), calls.unionByName(held)


def _tree(s, d):
    nodes_, edges_ = _graph(s, d)
    routes = table(s, d, "customer").select(F.concat(F.lit("screen:"), F.col("c_custkey").cast("string")).alias("stable_id"), F.concat(F.lit("/"), F.when(F.col("c_custkey") % 11 == 0, ":id").otherwise(F.col("c_mktsegment")), F.lit("/"), F.col("c_custkey").cast("string")).alias("route"))
    extra = table(s, d, "orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("feature:screen:"), (F.col("o_custkey") + 3).cast("string")).alias("feature"), F.concat(F.lit("api:"), F.col("o_orderkey").cast("string")).alias("entry"))
    docs = table(s, d, "documents").groupBy((F.col("doc_id") % 120).alias("k")).agg(F.min("doc_id").alias("d"))
    docs = docs.select(F.concat(F.lit("flow:action:"), F.col("k").cast("string")).alias("flow"), F.concat(F.lit("feature:screen:"), (F.col("d") * 7 % 400).cast("string")).alias("feature"))
    return business_tree(nodes_, edges_, routes, extra, docs)


QUERIES = {"business_tree": _tree, "business_menus": lambda s, d: menu_sums(_tree(s, d))}

_TREE = CALLS_SQL + """
  , held as materialized (select 'screen:' || c_custkey as source, 'action:' || (c_custkey % 97) as target from customer where c_custkey % 3 = 0 union all select 'network:' || s_nationkey, 'job:' || s_suppkey from supplier where s_nationkey % 4 <> 0),
  calls as materialized (select source, target from edges where edge_type in ('CALLS_API', 'HANDLED_BY', 'CALLS', 'STARTS', 'RESOLVES_TO') and not (edge_type = 'CALLS_API' and split_part(source, ':', 2)::bigint % 4 = 0) union all select source, target from held),
  feat as materialized (
    select 'feature:screen:' || c_custkey as feature, 'screen:' || c_custkey as entry, 'menu:' || case when c_custkey % 11 = 0 then c_custkey::varchar else lower(c_mktsegment) end as menu from customer
    union all select distinct 'feature:network:' || s_nationkey, 'network:' || s_nationkey, 'menu:batch' from supplier),
  extra as materialized (select feature, 'api:' || o_orderkey as entry from (select 'feature:screen:' || (o_custkey + 3) as feature, o_orderkey from orders where o_orderkey % 50 = 0) where feature in (select feature from feat)),
  docs as materialized (select 'flow:action:' || k as flow, 'feature:screen:' || (d * 7 % 400) as feature from (select doc_id % 120 as k, min(doc_id) as d from documents group by 1)),
  listed as (
    select feature, 'flow:' || target as flow from feat join held on source = entry
    union select feature, 'flow:' || entry from feat where entry not in (select source from held) union select feature, 'flow:' || entry from extra),
  owned as materialized (select l.flow, coalesce(min(l.feature) filter (l.feature = d.feature), min(l.feature)) as feature from listed l left join docs d on d.flow = l.flow group by 1),
  reach as (select entry as node from feat union select entry from extra union select target from reach join calls on source = node),
  lost as (select stable_id, row_number() over (order by stable_id) as k from nodes where node_type = 'API_OPERATION' and stable_id not in (select node from reach)),
  tree as (
    select menu, f.feature, o.flow as item, 'flow' as kind, d.flow is not null as documented from feat f left join owned o on o.feature = f.feature left join docs d on d.flow = o.flow
    union all select coalesce(menu, 'menu:stranded'), d.feature, flow, case when menu is null then 'stranded' else 'document' end, true from docs d left join feat f on f.feature = d.feature where flow not in (select flow from owned)
    union all select 'menu:unsorted', null, 'entry:' || stable_id, 'operation', false from lost where k <= 300) """
ORACLES = {
    "business_tree": _TREE + "select * from tree",
    "business_menus": _TREE + "select menu, count(distinct feature) as features, count(item) as items, count(*) filter (documented) as documented from tree group by 1",
}
