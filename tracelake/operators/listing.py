"""Lookups and ordered listings over nodes, edges, evidence and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.contract import SEVERITIES, serving_edge_type
from tracelake.plans.projection import GRAPH_SQL, edges, evidence, issues, nodes


def by_type(nodes_: DataFrame, node_type: str, limit: int = 50) -> DataFrame:
    """Nodes of a type in either case, by id."""
    return nodes_.where(F.upper("node_type") == node_type.upper()).orderBy("stable_id").limit(limit)


def by_name(nodes_: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Nodes of a qualified name, without regard to case; only where there is none, those that contain it."""
    qualified, wanted = F.lower("qualified_name"), name.lower()
    exact = nodes_.where(qualified == wanted).withColumn("_tier", F.lit(0))
    loose = nodes_.where(F.contains(qualified, F.lit(wanted)) & (qualified != wanted)).withColumn("_tier", F.lit(1))
    both = exact.unionByName(loose)
    best = both.agg(F.min("_tier").alias("_best"))
    # one row; an aggregate without keys
    return both.join(F.broadcast(best), F.col("_tier") == F.col("_best")).drop("_tier", "_best").orderBy("stable_id").limit(limit)


def table_matches(key_columns: list[Column], needle: str) -> Column:
    """A table answers to a name that is one of its keys, or ends one after a dot or colon."""
    wanted = needle.lower()
    keys = F.array(*[F.lower(k) for k in key_columns])
    return F.exists(keys, lambda k: (k == wanted) | F.endswith(k, F.lit("." + wanted)) | F.endswith(k, F.lit(":" + wanted)))


def route_fits(template: Column, route: Column) -> Column:
    """Segments agree one by one; a {parameter} takes any segment."""
    a, b = F.split(template, "/"), F.split(route, "/")
    same = F.forall(F.zip_with(a, b, lambda x, y: F.coalesce((x == y) | x.rlike(r"^\{.*\}$"), F.lit(False))), lambda ok: ok)
    return (F.size(a) == F.size(b)) & same


def normalised_route(route: Column) -> Column:
    """Verb in capitals, no host, query or trailing slash, single slashes, parameters and numbers as {id}."""
    verb = F.upper(F.regexp_extract(route, r"^\s*([A-Za-z]+)\s+", 1))
    path = F.regexp_replace(route, r"^\s*[A-Za-z]+\s+", "")
    path = F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(path, r"[?#].*$", "")
    path = F.regexp_replace(path, r"/{2,}", "/")
    path = F.regexp_replace(path, r"(?<=/)(?:\{[^/}]*\}|:[^/]+|[0-9]+)(?=/|$)", "{id}")
    path = F.regexp_replace(path, r"(?<=.)/$", "")
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(verb == "", path).otherwise(F.concat_ws(" ", verb, path))


def find_edges(edges_: DataFrame, source: str | None = None, target: str | None = None, edge_type: str | None = None, limit: int = 200) -> DataFrame:
    """Edges that meet every given condition; at least one must be given."""
    wanted = {"source": source, "target": target, "edge_type": edge_type}
    if not any(wanted.values()):
        raise ValueError("a source, a target or a type is needed")
    for column, value in wanted.items():
        if value:
            edges_ = edges_.where(F.col(column) == value)
    return edges_.orderBy("edge_id").limit(limit)


def by_severity(issues_: DataFrame, limit: int = 100) -> DataFrame:
    """Errors first, then warnings, then the rest; by id."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, k) for k, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))
    return issues_.withColumn("rank", rank).orderBy("rank", "issue_id").limit(limit)


def visible(edges_: DataFrame, level: str) -> DataFrame:
    """Edges shown on a level: SYSTEM shows data flow, APPLICATION hides structure, TECHNICAL shows all."""
    keep = {"SYSTEM": F.col("layer") == "DATA_FLOW", "APPLICATION": F.col("layer") != "STRUCTURAL", "TECHNICAL": F.lit(True)}
    return edges_.where(keep[level])


def invalid_edges(edges_: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Edges that break the contract: an unknown end, a confidence outside 0 to 1, an empty type."""
    ids = nodes_.select(F.col("stable_id").alias("id"))
    no_source = edges_.join(ids, F.col("source") == F.col("id"), "left_anti").select("edge_id", F.lit("source").alias("fault"))
    no_target = edges_.join(ids, F.col("target") == F.col("id"), "left_anti").select("edge_id", F.lit("target").alias("fault"))
    bad = edges_.where((F.col("confidence") < 0) | (F.col("confidence") > 1) | (F.col("edge_type") == "")).select("edge_id", F.lit("value").alias("fault"))
    return no_source.unionByName(no_target).unionByName(bad)


def _column_listing(spark, d):
    parts = nodes(spark, d).where("node_type = 'TABLE'").select(F.col("stable_id").alias("id"), "name", "qualified_name", "database_key")
    parts = parts.where(table_matches([F.col("id"), F.col("name"), F.col("qualified_name")], "economy.small widget"))
    return parts.select("id", "qualified_name", "database_key")


QUERIES = {
    "find_nodes_by_type": lambda s, d: by_type(nodes(s, d), "screen", 50).select("stable_id", "name"),
    "find_node_by_name_exact": lambda s, d: by_name(nodes(s, d), "nation_3").select("stable_id", "qualified_name"),
    "find_nodes_like": lambda s, d: by_name(nodes(s, d), "Customer#00000001").select("stable_id", "qualified_name"),
    "find_edges_by_type": lambda s, d: find_edges(edges(s, d), source="screen:7", edge_type="CALLS_API").select("edge_id", "source", "target"),
    "evidence_for_target": lambda s, d: evidence(s, d).join(find_edges(edges(s, d), target="table:5").select("edge_id"), "edge_id", "left_semi").orderBy("source_path", "start_line", "edge_id", "confidence").limit(100),
    "issues_filtered": lambda s, d: issues(s, d).where("issue_type = 'CLICK' and severity = 'INFO'").orderBy("issue_id").limit(100).select("issue_id", "source_path", "message"),
    "severity_ordered_issues": lambda s, d: by_severity(issues(s, d)).select("issue_id", "severity", "rank"),
    "table_by_any_key": _column_listing,
    "api_route_template_match": lambda s, d: nodes(s, d).where("node_type = 'API_OPERATION'").where(route_fits(F.lit("GET /orders/{status}/{id}"), F.col("name"))).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_route")),
    "normalised_routes": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select(normalised_route(F.concat(F.lit("get "), F.col("url"))).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n")),
    "serving_edge_translation": lambda s, d: edges(s, d).select(serving_edge_type(F.when(F.col("edge_type") == "READS", "READS_FROM").when(F.col("edge_type").isin("INSERTS", "UPDATES", "DELETES"), "WRITES_TO").when(F.col("edge_type") == "HANDLED_BY", "HANDLES_API").otherwise(F.col("edge_type")), F.col("operation"), F.lit("TABLE")).alias("served"), F.when(F.col("layer") == "DATA_FLOW", "TECHNICAL").otherwise(F.col("layer")).alias("layer")).groupBy("served", "layer").agg(F.count(F.lit(1)).alias("n")),
    "edges_visible_by_level": lambda s, d: visible(edges(s, d), "APPLICATION").groupBy("edge_type", "layer").agg(F.count(F.lit(1)).alias("n")),
    "contract_violations": lambda s, d: invalid_edges(edges(s, d).where("source <> 'system:0'").unionByName(edges(s, d).where("edge_type = 'READS'").withColumn("target", F.concat(F.lit("gone:"), F.substring("target", 7, 9))).where("target like 'gone:1%'")), nodes(s, d)).groupBy("fault").agg(F.count(F.lit(1)).alias("n")),
}

ORACLES = {
    "find_nodes_by_type": GRAPH_SQL + "select stable_id, name from nodes where node_type = 'SCREEN' order by stable_id limit 50",
    "find_node_by_name_exact": GRAPH_SQL + "select stable_id, qualified_name from nodes where lower(qualified_name) = 'nation_3' or (not exists (select 1 from nodes where lower(qualified_name) = 'nation_3') and contains(lower(qualified_name), 'nation_3')) order by stable_id limit 50",
    "find_nodes_like": GRAPH_SQL + "select stable_id, qualified_name from nodes where contains(lower(qualified_name), 'customer#00000001') order by stable_id limit 50",
    "find_edges_by_type": GRAPH_SQL + "select edge_id, source, target from edges where source = 'screen:7' and edge_type = 'CALLS_API' order by edge_id limit 200",
    "evidence_for_target": GRAPH_SQL + "select * from evidence where edge_id in (select edge_id from edges where target = 'table:5' order by edge_id limit 200) order by source_path, start_line, edge_id, confidence limit 100",
    "issues_filtered": GRAPH_SQL + "select issue_id, source_path, message from issues where issue_type = 'CLICK' and severity = 'INFO' order by issue_id limit 100",
    "severity_ordered_issues": GRAPH_SQL + "select issue_id, severity, case severity when 'ERROR' then 0 when 'WARNING' then 1 else 2 end as rank from issues order by rank, issue_id limit 100",
    "table_by_any_key": GRAPH_SQL + "select stable_id as id, qualified_name, database_key from nodes where node_type = 'TABLE' and lower(qualified_name) like '%.economy.small widget'",
    "api_route_template_match": GRAPH_SQL + "select count(*) as n, min(name) as first_route from nodes where node_type = 'API_OPERATION' and name like 'GET /orders/%'",
    "normalised_routes": r"select 'GET ' || case when p = '' then '/' else p end as route, count(*) as n from (select regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/{2,}', '/', 'g'), '/[0-9]+(/|$)', '/{id}\1', 'g'), '(.)/$', '\1') as p from pages) group by 1",
    "serving_edge_translation": GRAPH_SQL + "select edge_type as served, case layer when 'DATA_FLOW' then 'TECHNICAL' else layer end as layer, count(*) as n from edges group by all",
    "edges_visible_by_level": GRAPH_SQL + "select edge_type, layer, count(*) as n from edges where layer <> 'STRUCTURAL' group by all",
    "contract_violations": GRAPH_SQL + "select 'target' as fault, count(*) as n from edges where edge_type = 'READS' and target like 'table:1%' having count(*) > 0",
}
