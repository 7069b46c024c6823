"""Links across sources: resolvers that each make a graph of a graph, in a fixed order, each on what the one before has made.

A graph is three tables. Each resolver's tables are written, so the next one reads rows and not a plan. Edges are known by their ends and type and issues by kind
and node, so resolving what is resolved already changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.contract import table
from tracelake.operators.linking import backends, deferred, redirected
from tracelake.sources.scratch import written


@dataclass(frozen=True)
class Graph:
    """nodes: id, kind, gateway, verb, route, to_verb, to_route, database, schema, name; edges: source, target, edge_type, schema, confidence; issues: kind, node."""

    nodes: DataFrame
    edges: DataFrame
    issues: DataFrame

    def but(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, issues: DataFrame | None = None) -> Graph:
        """The graph with other tables, edges and issues that mean the same merged."""
        e = self.edges if edges is None else written(edges.groupBy("source", "target", "edge_type").agg(F.min("schema").alias("schema"), F.max("confidence").alias("confidence")))
        i = self.issues if issues is None else written(issues.select("kind", "node").distinct())
        return Graph(self.nodes if nodes is None else written(nodes), e, i)


def _linked(graph: Graph, asked: DataFrame, known: DataFrame, edge_type: str, missing: str | None) -> Graph:
    """asked: call_id, verb, route; known: operation_id, verb, route. Edges to the only match; calls with several, and with none if that has a name, are issues."""
    found = written(backends(asked.where("verb is not null and route is not null"), known))
    new = found.where("operation_id is not null").select(F.col("call_id").alias("source"), F.col("operation_id").alias("target"), F.lit(edge_type).alias("edge_type"), F.lit(None).cast("string").alias("schema"), "confidence")
    kind = F.when(F.col("match") == "ambiguous", "AMBIGUOUS_API_LINK").when(F.col("match") == "missing", F.lit(missing))
    told = found.select(kind.alias("kind"), F.col("call_id").alias("node")).where("kind is not null")
    return graph.but(edges=graph.edges.unionByName(new), issues=graph.issues.unionByName(told))


def gateway(graph: Graph) -> Graph:
    """ROUTES_TO from a gateway's route to the operation behind it."""
    operations = graph.nodes.where("kind = 'API_OPERATION'")
    asked = operations.where("gateway").select(F.col("id").alias("call_id"), F.col("to_verb").alias("verb"), F.col("to_route").alias("route"))
    return _linked(graph, asked, operations.where("not gateway").select(F.col("id").alias("operation_id"), "verb", "route"), "ROUTES_TO", "GATEWAY_BACKEND_NOT_FOUND")


def api(graph: Graph) -> Graph:
    """CALLS_API from a call to the operation it names, a gateway's or one behind it."""
    asked = graph.nodes.where("kind = 'API_CALL'").select(F.col("id").alias("call_id"), "verb", "route")
    return _linked(graph, asked, graph.nodes.where("kind = 'API_OPERATION'").select(F.col("id").alias("operation_id"), "verb", "route"), "CALLS_API", None)


def replaced(graph: Graph, names: DataFrame) -> Graph:
    """names: old, new. Edges and issues of the old node are the new one's, and the old node is gone."""
    names = written(names)
    to = lambda df, column: df.join(names.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
    nodes = graph.nodes.join(names.select(F.col("old").alias("id")), "id", "left_anti")
    return graph.but(nodes, to(to(graph.edges, "source"), "target").select(*graph.edges.columns), to(graph.issues, "node").select("kind", "node"))


def references(graph: Graph) -> Graph:
    """A reference gives way to the only object it can mean; one that can mean several stays, as an issue."""
    objects = graph.nodes.where("kind = 'TABLE'").select("id", "database", "schema", "name")
    found = written(deferred(graph.nodes.where("kind = 'REFERENCE'").select("id", "database", "schema", "name"), objects))
    told = found.where("status = 'ambiguous'").select(F.lit("AMBIGUOUS_DB_LINK").alias("kind"), F.col("id").alias("node"))
    graph = graph.but(issues=graph.issues.unionByName(told))
    return replaced(graph, found.where("status = 'resolved'").select(F.col("id").alias("old"), F.col("target_id").alias("new")))


def catalogue(graph: Graph) -> Graph:
    """Ends `table:DATABASE:NAME` that are no nodes become the catalogue's object of that name, of the schema that their edges name where there are several."""
    ends = graph.edges.select(F.col("source").alias("id"), "schema").unionByName(graph.edges.select(F.col("target").alias("id"), "schema"))
    lost = written(ends.where("id like 'table:%:%'").distinct().join(graph.nodes.select("id"), "id", "left_anti"))
    part = F.split("id", ":", 3)
    missing = lost.select("id", F.upper(part[1]).alias("database"), F.upper(part[2]).alias("name")).distinct()
    objects = graph.nodes.where("kind = 'TABLE'").select(F.col("id").alias("object_id"), F.upper("database").alias("database"), F.upper("schema").alias("schema"), F.upper("name").alias("name"))
    found = redirected(missing, objects, lost.where("schema <> ''").select("id", F.upper("schema").alias("schema")))
    return replaced(graph, found.where("object_id is not null").select(F.col("id").alias("old"), F.col("object_id").alias("new")))


def dangling(graph: Graph) -> Graph:
    """Ends that are still no nodes get one, and an issue."""
    ends = graph.edges.select(F.col("source").alias("id")).unionByName(graph.edges.select(F.col("target").alias("id"))).distinct()
    lost = written(ends.join(graph.nodes.select("id"), "id", "left_anti"))
    made = lost.select(*(F.col("id") if c == "id" else F.lit("UNRESOLVED_REFERENCE").alias(c) if c == "kind" else F.lit(None).cast(graph.nodes.schema[c].dataType).alias(c) for c in graph.nodes.columns))
    return graph.but(graph.nodes.unionByName(made), issues=graph.issues.unionByName(lost.select(F.lit("DANGLING_REFERENCE").alias("kind"), F.col("id").alias("node"))))


#: The order counts: calls may lead to gateways, references are resolved before the catalogue is asked, and only what is left then is dangling.
RESOLVERS: tuple[Callable[[Graph], Graph], ...] = (gateway, api, references, catalogue, dangling)


def linked(graph: Graph) -> Graph:
    for resolve in RESOLVERS:
        graph = resolve(graph)
    return graph


def _graph(s, d) -> Graph:
    """Operations and gateways of customers, calls of orders, and jobs that touch parts by references and by names."""
    c, o, p = table(s, d, "customer"), table(s, d, "orders"), table(s, d, "part")
    names = ("id", "kind", "gateway", "verb", "route", "to_verb", "to_route", "database", "schema", "name")

    def node(df: DataFrame, **values) -> DataFrame:
        return df.select(*(values.get(n, F.lit(None).cast("boolean" if n == "gateway" else "string")).alias(n) for n in names))

    text = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    get, operation, no = F.lit("GET"), F.lit("API_OPERATION"), F.lit(False)
    behind = F.concat(F.when(F.col("c_custkey") % 2 == 0, "/o/").otherwise("/zz/"), F.col("c_custkey").cast("string"))
    called = F.concat(F.when(F.col("o_orderkey") % 20 == 0, "https://h.example/x/public/").otherwise("/o/"), F.col("o_custkey").cast("string"))
    parts = [
        node(c, id=text("op:", "c_custkey"), kind=operation, gateway=no, verb=get, route=text("/o/", "c_custkey")),
        node(c.where("c_custkey % 7 = 0"), id=text("op2:", "c_custkey"), kind=operation, gateway=no, verb=get, route=text("/o/", "c_custkey")),
        node(c.where("c_custkey % 3 = 0"), id=text("gw:", "c_custkey"), kind=operation, gateway=F.lit(True), verb=get, route=text("/public/", "c_custkey"), to_verb=get, to_route=behind),
        node(o.where("o_orderkey % 10 = 0"), id=text("call:", "o_orderkey"), kind=F.lit("API_CALL"), gateway=no, verb=get, route=called),
        node(p, id=text("table:", "p_partkey"), kind=F.lit("TABLE"), gateway=no, database=F.col("p_brand"), schema=F.col("p_type"), name=F.col("p_name")),
        node(p.where("p_partkey % 4 = 0"), id=text("ref:", "p_partkey"), kind=F.lit("REFERENCE"), gateway=no, database=F.col("p_brand"), name=F.col("p_name")),
        node(p, id=text("job:", "p_partkey"), kind=F.lit("JOB"), gateway=no),
    ]
    nodes_ = parts[0]
    for more in parts[1:]:
        nodes_ = nodes_.unionByName(more)
    edge = lambda df, target, kind, schema: df.select(text("job:", "p_partkey").alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), schema.alias("schema"), F.lit(0.9).alias("confidence"))
    none = F.lit(None).cast("string")
    by_name = F.upper(F.concat_ws(":", F.lit("table"), "p_brand", "p_name"))
    by_name = F.concat(F.lit("table"), F.substring(by_name, 6, 1000))
    edges_ = edge(p.where("p_partkey % 4 = 0"), text("ref:", "p_partkey"), "READS", none)
    edges_ = edges_.unionByName(edge(p.where("p_partkey % 4 = 1"), by_name, "UPDATES", F.when(F.col("p_partkey") % 8 == 1, F.col("p_type"))))
    edges_ = edges_.unionByName(edge(p.where("p_partkey % 4 = 2"), F.concat(F.lit("table:NO:"), F.col("p_partkey").cast("string")), "READS", none))
    return Graph(nodes_, edges_, s.createDataFrame([], "kind string, node string"))


QUERIES = {
    "linked_edges": lambda s, d: linked(_graph(s, d)).edges.select("source", "target", "edge_type", "confidence"),
    "linked_issues": lambda s, d: linked(_graph(s, d)).issues,
    "linked_twice": lambda s, d: linked(linked(_graph(s, d))).nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
}

_SQL = """
with obj as (select p_partkey as p, upper(p_brand) as db, upper(p_type) as sc, upper(p_name) as nm, count(*) over (partition by upper(p_brand), upper(p_name)) as n, count(*) over (partition by upper(p_brand), upper(p_type), upper(p_name)) as k from part),
lost as (select db, nm, any_value(n) as n, count(distinct sc) filter (p % 8 = 1) as hints, min(sc) filter (p % 8 = 1) as hint from obj where p % 4 = 1 group by db, nm),
told as materialized (select l.db, l.nm, coalesce(case when l.n = 1 then (select min('table:' || p) from obj o where o.db = l.db and o.nm = l.nm) when hints = 1 then (select case when count(*) = 1 then 'table:' || min(p) end from obj o where o.db = l.db and o.nm = l.nm and o.sc = hint) end, 'table:' || l.db || ':' || l.nm) as target from lost l),
linked as materialized (
  select 'gw:' || c_custkey as source, 'op:' || c_custkey as target, 'ROUTES_TO' as edge_type, 1.0::double as confidence from customer where c_custkey % 6 = 0 and c_custkey % 7 <> 0
  union all select 'call:' || o_orderkey, 'op:' || o_custkey, 'CALLS_API', 1.0 from orders where o_orderkey % 20 = 10 and o_custkey % 7 <> 0
  union all select 'call:' || o_orderkey, 'gw:' || o_custkey, 'CALLS_API', 0.8 from orders where o_orderkey % 20 = 0 and o_custkey % 3 = 0
  union all select 'job:' || p, case when n = 1 then 'table:' || p else 'ref:' || p end, 'READS', 0.9 from obj where p % 4 = 0
  union all select 'job:' || p, target, 'UPDATES', 0.9 from obj join told using (db, nm) where p % 4 = 1
  union all select 'job:' || p, 'table:NO:' || p, 'READS', 0.9 from obj where p % 4 = 2) """
ORACLES = {
    "linked_edges": _SQL + "select * from linked",
    "linked_issues": _SQL + """select 'GATEWAY_BACKEND_NOT_FOUND' as kind, 'gw:' || c_custkey as node from customer where c_custkey % 6 = 3
      union all select 'AMBIGUOUS_API_LINK', 'gw:' || c_custkey from customer where c_custkey % 42 = 0
      union all select 'AMBIGUOUS_API_LINK', 'call:' || o_orderkey from orders where o_orderkey % 20 = 10 and o_custkey % 7 = 0
      union all select 'AMBIGUOUS_DB_LINK', 'ref:' || p from obj where p % 4 = 0 and n > 1
      union all select distinct 'DANGLING_REFERENCE', target from linked where target like 'table:%:%'""",
    "linked_twice": _SQL + """select 'API_OPERATION' as kind, count(*) + count(*) filter (c_custkey % 7 = 0) + count(*) filter (c_custkey % 3 = 0) as n from customer
      union all select 'API_CALL', count(*) from orders where o_orderkey % 10 = 0 having count(*) > 0 union all select 'TABLE', count(*) from part union all select 'JOB', count(*) from part
      union all select 'REFERENCE', count(*) from obj where p % 4 = 0 and n > 1 having count(*) > 0 union all select 'UNRESOLVED_REFERENCE', count(distinct target) from linked where target like 'table:%:%'""",
}
