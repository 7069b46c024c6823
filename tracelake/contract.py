"""Vocabulary of the lineage graph, and Column functions for its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Edge classes of the graph contract.
READ_EDGES = ("READS", "REMOTE_READS")
WRITE_EDGES = ("INSERTS", "UPDATES", "DELETES", "MERGES", "WRITES", "LOADS_INTO")
CALL_EDGES = ("CALLS", "CALLS_API", "HANDLED_BY", "TRIGGERS", "TRIGGERS_JOB", "RESOLVES_TO", "ENTRY_IN", "ROUTES_TO", "PUBLISHES", "CONSUMED_BY")
COLUMN_EDGES = ("READS_COLUMN", "WRITES_COLUMN")
#: Engine and serving names of all edges that touch data.
FLOW_DATA_EDGES = (*READ_EDGES, *WRITE_EDGES, *COLUMN_EDGES, "READS_FROM", "WRITES_TO", "POPULATES", "USES_SEQUENCE")
STEP_EDGES = (*CALL_EDGES, "HANDLES_API", "STARTS", "INVOKES", "BELONGS_TO", "EXECUTES_SQL", "DEFINES_STATEMENT", "INCLUDES_FRAGMENT")
REMOTE_TARGETS = ("EXTERNAL_DATABASE_OBJECT", "DATABASE_LINK")
FLOW_PARTS = ("UI_ACTION", "JOB", "INLINE_SQL", "SQL_STATEMENT", "PROCEDURE", "FUNCTION", "LOCAL_ROUTINE")
DATA_TARGETS = ("TABLE", "VIEW", "MATERIALIZED_VIEW", "COLUMN", "SEQUENCE", "EXTERNAL_DATABASE_OBJECT")
CALLER_TYPES = ("SCREEN", "UI_ACTION", "JOB", "JOB_NETWORK", "EXECUTABLE", "APPLICATION")
SEVERITIES = ("ERROR", "WARNING", "INFO")
# How much an edge of a type tells about its ends, best first; others count DEFAULT_PRIORITY.
EDGE_PRIORITY = {
    "INSERTS": 10, "UPDATES": 10, "DELETES": 10, "MERGES": 10, "WRITES": 10, "LOADS_INTO": 10, "READS": 9, "REMOTE_READS": 9,
    "HANDLED_BY": 8, "CALLS_API": 8, "STARTS": 8, "TRIGGERS": 8, "PUBLISHES": 8, "CONSUMED_BY": 8, "ROUTES_TO": 8, "DEPENDS_ON": 7, "CALLS": 7,
    "USES_SEQUENCE": 6, "RESOLVES_TO": 6, "MAPS_TO": 5, "ENTRY_IN": 5, "IMPLEMENTS": 5, "BELONGS_TO": 3, "USES": 2, "CONTAINS": 2, "PROJECT_REFERENCE": 1,
}
DEFAULT_PRIORITY = 3
# How much more, or less, a node of a type counts in a search; others count 1.
TYPE_PRIOR = {
    "TABLE": 1.4, "API_OPERATION": 1.4, "PROCEDURE": 1.3, "FUNCTION": 1.2, "PLSQL_PACKAGE": 1.2, "SCREEN": 1.3, "UI_ACTION": 1.2, "JOB": 1.3, "JOB_NETWORK": 1.2,
    "COMMAND_MODE": 1.2, "TRIGGER": 1.2, "VIEW": 1.3, "SQL_FILE": 1.1, "MESSAGE_TOPIC": 1.2, "METHOD": 1.0, "COLUMN": 0.7, "CSHARP_TYPE": 0.8, "FILE": 0.4,
    "INLINE_SQL": 0.4, "UNRESOLVED_REFERENCE": 0.3, "SYSTEM": 0.3, "REPOSITORY": 0.3, "DATABASE": 0.3, "DATABASE_SCHEMA": 0.3, "DOTNET_PROJECT": 0.3, "DOTNET_SOLUTION": 0.2,
}


def is_data_edge(edge_type: Column) -> Column:
    """A read or write of data, under its engine or its serving name, or the use of a sequence."""
    return edge_type.isin(*FLOW_DATA_EDGES)


def valued(name: Column, values: dict, default) -> Column:
    """The value of a name in one of the fixed tables."""
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, name), F.lit(default))


def follows(edge_type: Column, target_type: Column) -> Column:
    """A flow steps along call edges, and into the parts that a container holds."""
    return F.when(edge_type == "CONTAINS", target_type.isin(*FLOW_PARTS)).otherwise(edge_type.isin(*STEP_EDGES))


def edge_id(source: Column, edge_type: Column, target: Column, operation: Column, layer: Column) -> Column:
    """The identity of an edge: a digest of source, type, target, operation and layer."""
    return F.sha2(F.concat_ws("|", source, edge_type, target, operation, layer), 256)


def short_key(name: Column) -> Column:
    """The id in half as many bytes where it is a digest in hexadecimal; others are longer than those, so different ids stay different."""
    return F.when((F.length(name) == 64) & name.rlike("^[0-9a-f]{64}$"), F.unhex(name)).otherwise(F.encode(F.concat(F.lit("#" * 33), name), "utf-8"))


def long_name(key: Column) -> Column:
    """The id of a `short_key`."""
    return F.when(F.octet_length(key) == 32, F.lower(F.hex(key))).otherwise(F.substring(F.decode(key, "utf-8"), 34, 2**31 - 1))


def serving_edge_type(edge_type: Column, operation: Column, target_type: Column) -> Column:
    """The type under which an edge is served."""
    wrote = F.create_map(*[F.lit(x) for k, v in (("INSERT", "INSERTS"), ("UPDATE", "UPDATES"), ("DELETE", "DELETES"), ("MERGE", "MERGES")) for x in (k, v)])
    return (
        F.when((edge_type == "READS_FROM") & target_type.isin(*REMOTE_TARGETS), "REMOTE_READS")
        .when(edge_type == "READS_FROM", "READS")
        .when(edge_type == "WRITES_TO", F.coalesce(F.try_element_at(wrote, F.upper(operation)), F.lit("WRITES")))
        .when(edge_type == "HANDLES_API", "HANDLED_BY")
        .when(edge_type == "INVOKES", "CALLS")
        .otherwise(edge_type)
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
