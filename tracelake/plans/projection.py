"""The driver's tables as a lineage graph: nodes, edges, evidence and issues.

Each part of the graph is a projection with a literal type, so a filter on the type leaves the scans of the other parts out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.contract import edge_id, table


def _id(kind: str, *keys: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.col(k).cast("string") for k in keys])


def _verb(priority: Column) -> Column:
    return F.when(priority == "1-URGENT", "POST").when(priority == "2-HIGH", "PUT").when(priority == "5-LOW", "DELETE").otherwise("GET")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nodes(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """stable_id, node_type, name, qualified_name, system_key, database_key. Without `distinct`, a method has a row for each of its lines, which saves a shuffle where repeats don't count."""
    once = DataFrame.distinct if distinct else (lambda df: df)
    read = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string")

    def node(df: DataFrame, kind: str, key: Column, name: Column, qualified: Column, system: Column = none, database: Column = none) -> DataFrame:
        return df.select(key.alias("stable_id"), F.lit(kind).alias("node_type"), name.alias("name"), qualified.alias("qualified_name"), system.alias("system_key"), database.alias("database_key"))

    customers = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    route = F.concat(_verb(F.col("o_orderpriority")), F.lit(" /orders/"), F.lower("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string"))
    return _all(
        [
            node(read("region"), "SYSTEM", _id("system", "r_regionkey"), F.col("r_name"), F.col("r_name"), _id("system", "r_regionkey")),
            node(read("nation"), "APPLICATION", _id("application", "n_nationkey"), F.col("n_name"), F.col("n_name"), _id("system", "n_regionkey")),
            node(customers, "SCREEN", _id("screen", "c_custkey"), F.col("c_name"), F.concat_ws(".", "n_name", "c_name"), _id("system", "n_regionkey")),
            node(read("orders"), "API_OPERATION", _id("api-operation", "o_orderkey"), route, route),
            node(once(read("lineitem").select("l_orderkey", "l_suppkey")), "METHOD", _id("method", "l_orderkey", "l_suppkey"), F.concat(F.lit("handle"), F.col("l_suppkey").cast("string")), F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string"))),
            node(read("part"), "TABLE", _id("table", "p_partkey"), F.col("p_name"), F.concat_ws(".", "p_brand", "p_type", "p_name"), none, F.col("p_brand")),
        ]
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as accesses of a method to a table: order, supplier, part, access, operation, confidence, path, line."""
    access = F.when(F.col("l_returnflag") == "R", "DELETES").when(F.col("l_returnflag") == "A", "UPDATES").when(F.col("l_linestatus") == "O", "INSERTS").otherwise("READS")
    operation = F.when(F.col("l_returnflag") == "R", "DELETE").when(F.col("l_returnflag") == "A", "UPDATE").when(F.col("l_linestatus") == "O", "INSERT").otherwise("SELECT")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_partkey", access.alias("access"), operation.alias("operation"),
        F.when(F.col("l_discount") >= 0.05, 0.8).otherwise(1.0).alias("confidence"),
        F.concat(F.lit("shipments/"), F.date_format("l_shipdate", "yyyy-MM"), F.lit(".sql")).alias("source_path"), F.col("l_linenumber").alias("start_line"),
    )


def edges(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """edge_id, source, target, edge_type, layer, operation, confidence. Without `distinct`, an edge has a row for each line that shows it, with that line's confidence."""
    once = DataFrame.distinct if distinct else (lambda df: df)
    read = lambda name: table(spark, sf_dir, name)

    def edge(df: DataFrame, kind: Column, source: Column, target: Column, layer: str, operation: Column | None = None, confidence: Column | None = None) -> DataFrame:
        operation = F.lit("") if operation is None else operation
        layers = F.lit(layer)
        return df.select(edge_id(source, kind, target, operation, layers).alias("edge_id"), source.alias("source"), target.alias("target"), kind.alias("edge_type"), layers.alias("layer"), operation.alias("operation"), (F.lit(1.0) if confidence is None else confidence).alias("confidence"))

    data = shipments(spark, sf_dir)
    if distinct:
        data = data.groupBy("l_orderkey", "l_suppkey", "l_partkey", "access", "operation").agg(F.min("confidence").alias("confidence"))
    return _all(
        [
            edge(read("nation"), F.lit("CONTAINS"), _id("system", "n_regionkey"), _id("application", "n_nationkey"), "STRUCTURAL"),
            edge(read("customer"), F.lit("CONTAINS"), _id("application", "c_nationkey"), _id("screen", "c_custkey"), "STRUCTURAL"),
            edge(read("orders"), F.lit("CALLS_API"), _id("screen", "o_custkey"), _id("api-operation", "o_orderkey"), "DATA_FLOW"),
            edge(once(read("lineitem").select("l_orderkey", "l_suppkey")), F.lit("HANDLED_BY"), _id("api-operation", "l_orderkey"), _id("method", "l_orderkey", "l_suppkey"), "TECHNICAL"),
            edge(data, F.col("access"), _id("method", "l_orderkey", "l_suppkey"), _id("table", "l_partkey"), "TECHNICAL", F.col("operation"), F.col("confidence")),
        ]
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, source_path, start_line, confidence of each place that shows an access."""
    source, target = _id("method", "l_orderkey", "l_suppkey"), _id("table", "l_partkey")
    rows = shipments(spark, sf_dir)
    return rows.select(edge_id(source, F.col("access"), target, F.col("operation"), F.lit("TECHNICAL")).alias("edge_id"), "source_path", "start_line", "confidence")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issue_id, issue_type, severity, source_node, source_path, start_line, message."""
    kind = F.col("event_type")
    severity = F.when(kind == "error", "ERROR").when(kind == "purchase", "WARNING").otherwise("INFO")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("issue_id"), F.upper(kind).alias("issue_type"), severity.alias("severity"), _id("screen", "user_id").alias("source_node"),
        F.concat(F.lit("logs/"), kind, F.lit("/"), (F.col("event_id") % 7).cast("string")).alias("source_path"), (F.col("event_id") % 500).cast("int").alias("start_line"),
        F.concat(F.lit("value "), F.col("props")).alias("message"),
    )


#: The same projection in DuckDB SQL; oracles put it before their own SELECT.
GRAPH_SQL = """
with recursive shipments as (
  select *, case when l_returnflag='R' then 'DELETES' when l_returnflag='A' then 'UPDATES' when l_linestatus='O' then 'INSERTS' else 'READS' end as access,
    case when l_returnflag='R' then 'DELETE' when l_returnflag='A' then 'UPDATE' when l_linestatus='O' then 'INSERT' else 'SELECT' end as operation,
    case when l_discount >= 0.05 then 0.8 else 1.0 end::double as confidence,
    'shipments/' || strftime(l_shipdate, '%Y-%m') || '.sql' as source_path, l_linenumber as start_line,
    'method:' || l_orderkey || ':' || l_suppkey as source, 'table:' || l_partkey as target
  from lineitem),
nodes as materialized (
  select 'system:' || r_regionkey as stable_id, 'SYSTEM' as node_type, r_name as name, r_name as qualified_name, 'system:' || r_regionkey as system_key, null::varchar as database_key from region
  union all select 'application:' || n_nationkey, 'APPLICATION', n_name, n_name, 'system:' || n_regionkey, null from nation
  union all select 'screen:' || c_custkey, 'SCREEN', c_name, n_name || '.' || c_name, 'system:' || n_regionkey, null from customer join nation on c_nationkey = n_nationkey
  union all select 'api-operation:' || o_orderkey, 'API_OPERATION', r, r, null, null from (select o_orderkey, case o_orderpriority when '1-URGENT' then 'POST' when '2-HIGH' then 'PUT' when '5-LOW' then 'DELETE' else 'GET' end || ' /orders/' || lower(o_orderstatus) || '/' || o_orderkey as r from orders)
  union all select distinct 'method:' || l_orderkey || ':' || l_suppkey, 'METHOD', 'handle' || l_suppkey, l_orderkey || '.' || l_suppkey, null, null from lineitem
  union all select 'table:' || p_partkey, 'TABLE', p_name, p_brand || '.' || p_type || '.' || p_name, null, p_brand from part),
raw_edges as materialized (
  select 'system:' || n_regionkey as source, 'application:' || n_nationkey as target, 'CONTAINS' as edge_type, 'STRUCTURAL' as layer, '' as operation, 1.0::double as confidence from nation
  union all select 'application:' || c_nationkey, 'screen:' || c_custkey, 'CONTAINS', 'STRUCTURAL', '', 1.0 from customer
  union all select 'screen:' || o_custkey, 'api-operation:' || o_orderkey, 'CALLS_API', 'DATA_FLOW', '', 1.0 from orders
  union all select distinct 'api-operation:' || l_orderkey, source, 'HANDLED_BY', 'TECHNICAL', '', 1.0 from shipments
  union all select source, target, access, 'TECHNICAL', operation, min(confidence) from shipments group by source, target, access, operation),
edges as materialized (select sha256(concat_ws('|', source, edge_type, target, operation, layer)) as edge_id, * from raw_edges),
evidence as (select sha256(concat_ws('|', source, access, target, operation, 'TECHNICAL')) as edge_id, source_path, start_line, confidence from shipments),
issues as (
  select event_id as issue_id, upper(event_type) as issue_type, case event_type when 'error' then 'ERROR' when 'purchase' then 'WARNING' else 'INFO' end as severity,
    'screen:' || user_id as source_node, 'logs/' || event_type || '/' || (event_id % 7) as source_path, (event_id % 500)::int as start_line, 'value ' || props as message from events)
"""
