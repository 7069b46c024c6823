"""Links between systems: gateways to backends, deferred references, catalogue ids, jobs to programs, and the keys they are found by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.contract import table
from tracelake.functions.names import executable, leaf, owner, route, route_key, slug, sql_name, system_of
from tracelake.functions.text import compact, fold_ascii
from tracelake.operators.joins import suffixes
from tracelake.plans.projection import GRAPH_SQL, edges, nodes


def backends(calls: DataFrame, operations: DataFrame) -> DataFrame:
    """calls: call_id, verb, route; operations: operation_id, verb, route. call_id, match, matches, operation_id (if there is one), confidence.

    The whole route decides, else the operations whose route is the longest suffix of the call's, else those that the call's route is a suffix of. One
    match is a link, of confidence 1 if the whole route is equal and 0.8 otherwise; several are ambiguous, none is missing. Both sides explode into suffixes.
    """
    asked = calls.select("call_id", route_key(F.col("verb"), F.col("route")).alias("key"), F.upper(F.trim("verb")).alias("verb"), F.array_join(F.filter(F.split(F.lower(route(F.col("route"))), "/"), lambda p: p != ""), "/").alias("path"))
    known = operations.select("operation_id", F.upper(F.trim("verb")).alias("verb"), F.array_join(F.filter(F.split(F.lower(route(F.col("route"))), "/"), lambda p: p != ""), "/").alias("path")).distinct()
    by_path = known.groupBy("verb", "path").agg(F.count_distinct("operation_id").alias("n"), F.min("operation_id").alias("one"))
    tails = asked.select("call_id", "verb", F.posexplode(suffixes(F.col("path"))).alias("skipped", "path"))
    down = tails.join(by_path, ["verb", "path"]).groupBy("call_id").agg(F.min(F.struct("skipped", "n", "one")).alias("d"))
    ends = known.select("operation_id", "verb", F.explode(suffixes(F.col("path"))).alias("path")).groupBy("verb", "path").agg(F.count_distinct("operation_id").alias("m"), F.min("operation_id").alias("other"))
    rows = asked.join(down, "call_id", "left").join(ends, ["verb", "path"], "left")
    n = F.coalesce("d.n", "m", F.lit(0))
    match = F.when(F.col("d.skipped") == 0, "exact").when(F.col("d.n").isNotNull(), "suffix").when(F.col("m").isNotNull(), "within")
    status = F.when(n == 1, match).when(n > 1, "ambiguous").otherwise("missing")
    return rows.select("call_id", status.alias("match"), n.alias("matches"), F.when(n == 1, F.coalesce("d.one", "other")).alias("operation_id"), F.when(n == 1, F.when(match == "exact", 1.0).otherwise(0.8)).alias("confidence"))


def deferred(references: DataFrame, objects: DataFrame) -> DataFrame:
    """references and objects: id, database, schema, name. id, status, candidates, target_id: an object of the same database, schema and name, else of any schema; one only is a match.

    A name with a database link is remote. Objects are counted by their full key and by the key without schema before they are joined.
    """
    upper = lambda c: F.upper(F.coalesce(c, F.lit("")))
    index = objects.select("id", upper("database").alias("database"), F.explode(F.array_distinct(F.array(upper("schema"), F.lit("")))).alias("schema"), upper("name").alias("name"))
    index = index.groupBy("database", "schema", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("one"))
    asked = references.select(F.col("id").alias("ref"), F.contains("name", F.lit("@")).alias("remote"), upper("database").alias("database"), upper("schema").alias("schema"), upper("name").alias("name"))
    wide = index.where("schema = ''").select("database", "name", F.col("n").alias("m"), F.col("one").alias("other"))
    rows = asked.join(index, ["database", "schema", "name"], "left").join(wide, ["database", "name"], "left")
    n, one = F.coalesce("n", "m", F.lit(0)), F.coalesce("one", "other")
    status = F.when(F.col("remote"), "remote").when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("missing")
    return rows.select(F.col("ref").alias("id"), status.alias("status"), F.when(~F.col("remote"), n).otherwise(0).alias("candidates"), F.when(status == "resolved", one).alias("target_id"))


def redirected(missing: DataFrame, objects: DataFrame, hints: DataFrame) -> DataFrame:
    """missing: id, database, name; objects: object_id, database, schema, name; hints: id, schema (named on edges). The only object of the name, else the only one of the only schema named."""
    by_name = objects.groupBy("database", "name").agg(F.count(F.lit(1)).alias("n"), F.min("object_id").alias("one"))
    by_schema = objects.groupBy("database", "schema", "name").agg(F.count(F.lit(1)).alias("k"), F.min("object_id").alias("other"))
    single = hints.groupBy("id").agg(F.count_distinct("schema").alias("s"), F.min("schema").alias("schema")).where("s = 1").select("id", "schema")
    rows = missing.join(by_name, ["database", "name"], "left").join(single, "id", "left").join(by_schema, ["database", "schema", "name"], "left")
    to = F.when(F.col("n") == 1, F.col("one")).when(F.col("k") == 1, F.col("other"))
    return rows.select("id", to.alias("object_id"), F.when(to.isNotNull() & (F.col("n") == 1), "name").when(to.isNotNull(), "schema").when(F.col("n").isNull(), "missing").otherwise("ambiguous").alias("by"))


def job_programs(jobs: DataFrame, aliases: DataFrame, programs: DataFrame) -> DataFrame:
    """jobs: job, command; aliases: set_id, name; programs: program, name. STARTS edges of each job to the programs of its name or of a name in the same set of aliases, and jobs without one as issues."""
    keyed = aliases.select("set_id", executable(F.col("name")).alias("key")).where("key <> ''").distinct()
    asked = jobs.select("job", executable(F.col("command")).alias("key"))
    sets = asked.join(keyed, "key").select("job", "set_id").distinct()
    keys = asked.unionByName(sets.join(keyed, "set_id").select("job", "key")).distinct()
    hits = keys.join(programs.select("program", executable(F.col("name")).alias("key")).distinct(), "key").select("job", "program").distinct()
    none = jobs.select("job").join(hits, "job", "left_anti")
    return hits.select("job", "program", F.lit("STARTS").alias("kind")).unionByName(none.select("job", F.lit(None).cast("string").alias("program"), F.lit("JOB_EXECUTABLE_NOT_FOUND").alias("kind")))


def localised(names: DataFrame, targets: DataFrame) -> DataFrame:
    """names: code, locale, value; targets: target, name. The value for every target of the code, in whatever database it is; codes without a target have none."""
    key = lambda c: F.upper(F.trim(c))
    last = names.groupBy(key(F.col("code")).alias("key"), "locale").agg(F.max("value").alias("value"))
    return last.join(targets.select("target", key(F.col("name")).alias("key")), "key", "left").select("key", "locale", "value", "target")


def attached(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """child, parent: CONTAINS edges for nodes without a structural parent: a database's objects belong to it, other nodes to their system, and the rest to none."""
    parented = edges_.where("edge_type = 'CONTAINS'").select(F.col("target").alias("stable_id")).distinct()
    free = nodes_.where("node_type <> 'SYSTEM'").join(parented, "stable_id", "left_anti")
    parent = F.when(F.col("database_key").isNotNull(), F.concat(F.lit("database:"), F.upper("database_key"))).otherwise(F.col("system_key"))
    return free.select(F.col("stable_id").alias("child"), parent.alias("parent")).where("parent is not null")


def identity(stable_id: Column) -> Column:
    """kind, database and name of an id by its prefix: `table:DB:NAME`, `column:DB:TABLE:COLUMN`, `routine:DB:PACKAGE:NAME`."""
    parts = F.split(stable_id, ":")
    kind = parts[0]
    inner = F.when(kind.isin("table", "view", "sequence") & (F.size(parts) >= 3), F.upper(F.element_at(parts, -1))).when(kind.isin("column", "routine") & (F.size(parts) >= 4), F.upper(F.concat_ws(".", parts[2], parts[3]))).otherwise(F.element_at(parts, -1))
    return F.struct(kind.alias("kind"), F.when(F.size(parts) >= 3, F.upper(parts[1])).alias("database"), inner.alias("name"))


def lookup_keys(nodes_: DataFrame) -> DataFrame:
    """node, key: what a node is looked up by. An operation by its verb and route; a table by its name alone, with its schema, with its database, and with both."""
    schema = F.element_at(F.split("qualified_name", r"\."), -2)
    name, database = F.upper("name"), F.upper("database_key")
    of_table = F.array(name, F.concat_ws(".", F.upper(schema), name), F.concat_ws(".", database, name), F.concat_ws(".", database, F.upper(schema), name))
    call = F.array(F.concat_ws(" ", F.upper(F.split("name", " ")[0]), route(F.split("name", " ")[1])))
    keys = F.when(F.col("node_type") == "TABLE", of_table).when(F.col("node_type") == "API_OPERATION", call)
    return nodes_.select(F.col("stable_id").alias("node"), F.explode(F.array_distinct(keys)).alias("key"))


def without_table(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """columns: database, table, column, line; tables: database, table. CATALOG_REFERENCE_MISSING for each table that columns name and the catalogue lacks."""
    gone = columns.join(tables.select("database", "table").distinct(), ["database", "table"], "left_anti")
    return gone.groupBy("database", "table").agg(F.count(F.lit(1)).alias("columns"), F.min("line").alias("first_line")).withColumn("issue_type", F.lit("CATALOG_REFERENCE_MISSING"))


def known_names(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """names, catalogue: name. The names whose last part the catalogue has."""
    return names.withColumn("_k", leaf(F.col("name"))).join(catalogue.select(leaf(F.col("name")).alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def rolled_up(routines: DataFrame, contains: DataFrame) -> DataFrame:
    """routines: node; contains: source, target. owner, n: routines by the package that contains them, by themselves where none does."""
    parent = contains.groupBy(F.col("target").alias("node")).agg(F.min("source").alias("package"))
    return routines.join(parent, "node", "left").groupBy(F.coalesce("package", "node").alias("owner")).agg(F.count(F.lit(1)).alias("n"))


def _calls(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderkey") % 7 == 0, "POST").otherwise("get").alias("verb"), F.concat(F.lit("https://host.example//API/v1/"), F.col("o_orderstatus"), F.lit("/"), (F.col("o_orderkey") % 50).cast("string"), F.lit("/?x=1")).alias("route"))


def _operations(s, d):
    c = table(s, d, "customer")
    key = F.col("c_custkey").cast("string")
    one = c.select(F.concat(F.lit("op:"), key).alias("operation_id"), F.lit("GET").alias("verb"), F.concat(F.lit("/o/"), key).alias("route"))
    two = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("tail:"), key), F.lit("GET"), key)
    long = c.where("c_custkey % 5 = 0").select(F.concat(F.lit("long:"), key), F.lit("POST"), F.concat(F.lit("/gw/api/v1/p/"), key))
    return one.union(two).union(long)


def _objects(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("database"), F.col("p_type").alias("schema"), F.col("p_name").alias("name"))


def _references(s, d):
    k = F.col("p_partkey")
    schema = F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, F.lit(None).cast("string")).otherwise("OTHER")
    return table(s, d, "part").select(k.alias("id"), F.upper("p_brand").alias("database"), schema.alias("schema"), F.when(k % 10 == 0, F.concat("p_name", F.lit("@link"))).otherwise(F.lower("p_name")).alias("name"))


QUERIES = {
    "gateway_backends": lambda s, d: backends(_calls(s, d), _operations(s, d)),
    "deferred_references": lambda s, d: deferred(_references(s, d), _objects(s, d)),
    "catalogue_redirects": lambda s, d: redirected(_objects(s, d).select("id", "database", "name"), _objects(s, d).where("id % 4 <> 0").select(F.col("id").alias("object_id"), "database", "schema", "name"), _objects(s, d).where("id % 2 = 0").select("id", "schema")),
    "job_programs": lambda s, d: job_programs(table(s, d, "supplier").select(F.concat(F.lit("job:"), F.col("s_suppkey").cast("string")).alias("job"), F.concat(F.lit("C:\\bin\\Run-Task_"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".EXE")).alias("command")), s.range(30).select((F.col("id") % 6).alias("set_id"), F.concat(F.lit("run task "), F.col("id").cast("string")).alias("name")), s.range(10, 25).select(F.concat(F.lit("exe:"), F.col("id").cast("string")).alias("program"), F.concat(F.lit("/opt/run_task_"), F.col("id").cast("string"), F.lit(".exe")).alias("name"))),
    "localised_targets": lambda s, d: localised(table(s, d, "documents").select(F.concat(F.lit(" "), F.lower(F.concat(F.lit("small widget "), (F.col("doc_id") % 5).cast("string")))).alias("code"), F.col("lang").alias("locale"), F.md5("text").alias("value")).unionByName(table(s, d, "documents").select(F.lit("small widget").alias("code"), F.col("lang").alias("locale"), F.md5("text").alias("value"))), nodes(s, d).where("node_type = 'TABLE'").select(F.col("stable_id").alias("target"), F.col("name"))),
    "hierarchy_edges": lambda s, d: attached(nodes(s, d), edges(s, d)),
    "id_identities": lambda s, d: nodes(s, d).select("stable_id", identity(F.when(F.col("node_type") == "TABLE", F.concat_ws(":", F.lit("table"), "database_key", "name")).otherwise(F.col("stable_id"))).alias("i")).select("stable_id", "i.*"),
    "lookup_keys": lambda s, d: lookup_keys(nodes(s, d)),
    "columns_without_table": lambda s, d: without_table(table(s, d, "lineitem").select((F.col("l_suppkey") % 5).alias("database"), F.col("l_partkey").alias("table"), F.col("l_linenumber").alias("column"), F.col("l_orderkey").alias("line")), table(s, d, "part").where("p_size % 2 = 0").select((F.col("p_partkey") % 5).alias("database"), F.col("p_partkey").alias("table"))),
    "catalogue_members": lambda s, d: known_names(nodes(s, d).where("node_type in ('TABLE', 'SCREEN')").select("stable_id", F.regexp_replace(F.concat(F.lit("db."), "name", F.lit("@l")), "[# ]", "_").alias("name")), table(s, d, "part").where("p_size < 25").select(F.regexp_replace("p_name", "[# ]", "_").alias("name"))).select("stable_id"),
    "package_rollup": lambda s, d: rolled_up(nodes(s, d).where("node_type = 'METHOD'").select(F.col("stable_id").alias("node")), edges(s, d).where("edge_type = 'HANDLED_BY' and source like '%1'").select("source", "target")),
    "scalar_names": lambda s, d: table(s, d, "part").select("p_partkey", sql_name(F.concat_ws(".", F.lit('"Own er"'), F.lower("p_brand"), F.lit(" x "))).alias("sql_name"), leaf(F.concat(F.lower("p_brand"), F.lit(".t"), F.col("p_partkey").cast("string"), F.lit("@remote"))).alias("leaf"), owner(F.concat_ws(".", "p_brand", F.lit("t"))).alias("owner"), slug(F.concat(F.lit("a/B\\"), F.col("p_name"), F.lit(" (x)"))).alias("slug"), executable(F.concat(F.lit("/x/"), F.col("p_name"), F.lit(".Exe"))).alias("executable"), route(F.concat(F.lit("http://h//A/{id}/:part/"), F.col("p_partkey").cast("string"), F.lit("/"))).alias("route"), compact(F.col("p_name"), fold_ascii).alias("compact"), system_of(F.when(F.col("p_partkey") % 3 == 0, "JOB").when(F.col("p_partkey") % 3 == 1, "TABLE").otherwise("METHOD"), F.lit("S"), F.col("p_brand"), F.lit(None).cast("string")).alias("lane")),
}

ORACLES = {
    "gateway_backends": """with calls as (select o_orderkey as call_id, case when o_orderkey % 7 = 0 then 'POST' else 'GET' end as verb, 'api/v1/' || lower(o_orderstatus) || '/' || (o_orderkey % 50) as path from orders),
      ops as (select 'op:' || c_custkey as operation_id, 'GET' as verb, 'o/' || c_custkey as path from customer union all select 'tail:' || c_custkey, 'GET', c_custkey::varchar from customer where c_custkey % 3 = 0 union all select 'long:' || c_custkey, 'POST', 'gw/api/v1/p/' || c_custkey from customer where c_custkey % 5 = 0),
      down as (select call_id, operation_id, length(o.path) as l, o.path = c.path as whole from calls c join ops o on c.verb = o.verb and (c.path = o.path or suffix(c.path, '/' || o.path)) qualify rank() over (partition by call_id order by length(o.path) desc) = 1),
      d as (select call_id, count(*) as n, min(operation_id) as one, bool_or(whole) as whole from down group by 1),
      u as (select call_id, count(*) as n, min(operation_id) as one from calls c join ops o on c.verb = o.verb and (c.path = o.path or suffix(o.path, '/' || c.path)) group by 1),
      x as (select c.call_id, coalesce(d.n, u.n, 0) as n, coalesce(d.one, u.one) as one, case when d.whole then 'exact' when d.n is not null then 'suffix' else 'within' end as kind from calls c left join d using (call_id) left join u using (call_id))
      select call_id, case when n = 1 then kind when n > 1 then 'ambiguous' else 'missing' end as match, n as matches, case when n = 1 then one end as operation_id, case when n = 1 then case when kind = 'exact' then 1.0 else 0.8 end end::double as confidence from x""",
    "deferred_references": """with o as (select p_partkey as id, upper(p_brand) as db, upper(p_type) as sc, upper(p_name) as nm from part),
      r as (select p_partkey as id, p_partkey % 10 = 0 as remote, upper(p_brand) as db, case p_partkey % 3 when 0 then upper(p_type) when 1 then '' else 'OTHER' end as sc, upper(p_name) as nm from part),
      a as (select db, sc, nm, count(*) as n, min(id) as one from o group by all), b as (select db, nm, count(*) as n, min(id) as one from o group by all),
      x as (select r.id, remote, coalesce(a.n, b.n, 0) as n, coalesce(a.one, b.one) as one from r left join a using (db, sc, nm) left join b using (db, nm))
      select id, case when remote then 'remote' when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'missing' end as status, case when remote then 0 else n end as candidates, case when not remote and n = 1 then one end as target_id from x""",
    "catalogue_redirects": """with o as (select * from part where p_partkey % 4 <> 0), a as (select p_brand, p_name, count(*) as n, min(p_partkey) as one from o group by all), b as (select p_brand, p_type, p_name, count(*) as k, min(p_partkey) as other from o group by all),
      x as (select p.p_partkey as id, n, one, case when p.p_partkey % 2 = 0 then k end as k, other from part p left join a on a.p_brand = p.p_brand and a.p_name = p.p_name left join b on b.p_brand = p.p_brand and b.p_name = p.p_name and b.p_type = p.p_type)
      select id, case when n = 1 then one when k = 1 then other end as object_id, case when n = 1 then 'name' when k = 1 then 'schema' when n is null then 'missing' else 'ambiguous' end as by from x""",
    "job_programs": "with j as (select 'job:' || s_suppkey as job, s_suppkey % 40 as k from supplier), n as (select job, k as p from j union select job, unnest(range(k % 6, 30, 6)) from j where k < 30), h as (select distinct job, 'exe:' || p as program from n where p between 10 and 24) select job, program, 'STARTS' as kind from h union all select job, null, 'JOB_EXECUTABLE_NOT_FOUND' from j where job not in (select job from h)",
    "localised_targets": "with n as (select 'SMALL WIDGET ' || (doc_id % 5) as key, lang as locale, md5(text) as value from documents union all select 'SMALL WIDGET', lang, md5(text) from documents), l as (select key, locale, max(value) as value from n group by all) select key, locale, value, 'table:' || p_partkey as target from l left join part on upper(trim(p_name)) = key",
    "hierarchy_edges": GRAPH_SQL + "select stable_id as child, coalesce('database:' || upper(database_key), system_key) as parent from nodes where node_type <> 'SYSTEM' and stable_id not in (select target from edges where edge_type = 'CONTAINS') and coalesce(database_key, system_key) is not null",
    "id_identities": GRAPH_SQL + "select stable_id, split_part(stable_id, ':', 1) as kind, case when node_type = 'TABLE' then upper(database_key) when node_type = 'METHOD' then split_part(stable_id, ':', 2) end as database, case when node_type = 'TABLE' then upper(name) else split_part(stable_id, ':', -1) end as name from nodes",
    "lookup_keys": GRAPH_SQL + ", t as (select 'table:' || p_partkey as node, upper(p_name) as n, upper(p_type) as s, upper(p_brand) as b from part) select node, n as key from t union select node, s || '.' || n from t union select node, b || '.' || n from t union select node, b || '.' || s || '.' || n from t union all select stable_id, name from nodes where node_type = 'API_OPERATION'",
    "columns_without_table": "with c as (select l_suppkey % 5 as database, l_partkey as \"table\", l_orderkey as line from lineitem) select database, \"table\", count(*) as columns, min(line) as first_line, 'CATALOG_REFERENCE_MISSING' as issue_type from c where (database, \"table\") not in (select (p_partkey % 5, p_partkey) from part where p_size % 2 = 0) group by all",
    "catalogue_members": GRAPH_SQL + "select stable_id from nodes where node_type in ('TABLE', 'SCREEN') and upper(name) in (select upper(p_name) from part where p_size < 25)",
    "package_rollup": GRAPH_SQL + ", c as (select target, min(source) as p from edges where edge_type = 'HANDLED_BY' and source like '%1' group by 1) select coalesce(p, stable_id) as owner, count(*) as n from nodes left join c on target = stable_id where node_type = 'METHOD' group by 1",
    "scalar_names": "select p_partkey, 'Own er.' || upper(p_brand) || '.X' as sql_name, 'T' || p_partkey as leaf, upper(p_brand) as owner, rtrim(regexp_replace(regexp_replace(lower(p_name) || ' (x)', '[^a-z0-9_.-]', '-', 'g'), '-{2,}', '-', 'g'), '-') as slug, regexp_replace(lower(p_name), '[-_. ]', '', 'g') as executable, '/A/{id}/{id}/' || p_partkey as route, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as compact, case p_partkey % 3 when 0 then 'Jobnet' when 1 then p_brand else 'S' end as lane from part",
}
