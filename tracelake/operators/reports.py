"""Lookups, listings in a stated order, detail counts and reports over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.contract import DATA_TARGETS, WRITE_EDGES, short_key, table
from tracelake.functions.names import shortened, small_id
from tracelake.functions.text import fold_ascii, tokens
from tracelake.operators.ranks import first_of
from tracelake.plans.projection import GRAPH_SQL, edges, evidence, issues, nodes
from tracelake.sources.scratch import written

# Types that a comparison passes over in silence, edges of structure, issues that go once their object is known, and caps of lists and texts.
QUIET_TYPES = ("FILE", "REPOSITORY", "INLINE_SQL", "UNRESOLVED_REFERENCE")
STRUCTURE = ("CONTAINS", "BELONGS_TO", "PROJECT_REFERENCE")
RESOLVABLE = ("TABLE_NOT_IMPORTED", "COLUMN_NOT_IMPORTED", "PROCEDURE_NOT_FOUND", "EXTERNAL_OBJECT")
MOST_ITEMS, SNIPPET, LINE, DOC = 200, 500, 240, 600


def by_any_id(requests: DataFrame, nodes_: DataFrame) -> DataFrame:
    """requests: text. A number is a small id, all else a stable id."""
    known = nodes_.select("stable_id", "node_type", F.explode(F.array(F.col("stable_id"), small_id(F.col("stable_id")).cast("string"))).alias("text"))
    return requests.join(known, "text").select("text", "stable_id", "node_type")


def is_data_target(node_type: Column, table_property: Column) -> Column:
    """Whether a node is something of a database: by its type, or an unresolved reference that names a table."""
    return node_type.isin(*DATA_TARGETS) | ((node_type == "UNRESOLVED_REFERENCE") & table_property.isNotNull())


def searched(nodes_: DataFrame, names: DataFrame, text: str, types: tuple[str, ...] = (), but: tuple[str, ...] = (), keep: int = 50) -> DataFrame:
    """nodes with the text in an id, a name, a type or a localised value; an exact name first, then by localised or own name and id. names: target_id, value."""
    has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    local = names.groupBy("target_id").agg(F.max(has("value")).alias("hit"), F.min("value").alias("value"))
    rows = nodes_.join(local, F.col("stable_id") == F.col("target_id"), "left")
    rows = rows.where(has("stable_id") | has("name") | has("qualified_name") | has("node_type") | F.coalesce("hit", F.lit(False)))
    rows = rows.where(F.col("node_type").isin(*types)) if types else rows
    rows = rows.where(~F.col("node_type").isin(*but)) if but else rows
    exact = F.when(F.lower("name") == text.lower(), 0).otherwise(1).alias("exact")
    order = ["exact", F.lower(F.coalesce("value", "name")), "stable_id"]
    return rows.withColumn("exact", exact).orderBy(*order).limit(keep).select("stable_id", "exact")


def at_level(nodes_: DataFrame, edges_: DataFrame, root: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Edges between nodes of the types and the root itself."""
    kept = nodes_.where(F.col("node_type").isin(*types)).select("stable_id").unionByName(root.select("stable_id")).distinct()
    return edges_.join(kept.withColumnRenamed("stable_id", "source"), "source", "left_semi").join(kept.withColumnRenamed("stable_id", "target"), "target", "left_semi").select(*edges_.columns)


def compared_graphs(base: tuple[DataFrame, ...], head: tuple[DataFrame, ...]) -> DataFrame:
    """base and head: nodes, edges, issues. section, change, key of what is new or gone: nodes but quiet ones, edges but structure, columns of tables as schema, new issues.

    Issues are known by type, severity, file and message without its digits, so those that only moved are not new.
    """

    def both_ways(a: DataFrame, b: DataFrame, section: str, repeated: bool = False) -> DataFrame:
        # Both sides are read once and meet in one aggregate, which leaves out repeats too.
        sided = a.select("key", F.lit(1).alias("gone"), F.lit(0).alias("new")).unionByName(b.select("key", F.lit(0).alias("gone"), F.lit(1).alias("new")))
        rows = sided.groupBy("key").agg(F.sum("gone").alias("gone"), F.sum("new").alias("new")).where("gone = 0 or new = 0")
        rows = rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("gone") + F.col("new")))) if repeated else rows
        return rows.select("key", F.when(F.col("gone") > 0, "removed").otherwise("added").alias("change"), F.lit(section).alias("section"))

    own = lambda n: n.where(~F.col("node_type").isin(*QUIET_TYPES)).select(F.col("stable_id").alias("key"))
    linked = lambda e: e.where(~F.col("edge_type").isin(*STRUCTURE)).select(F.concat_ws("|", "source", "edge_type", "operation", "target").alias("key"))
    columns = lambda n, e: e.where("edge_type = 'CONTAINS'").join(n.where("node_type = 'COLUMN'").select(F.col("stable_id").alias("target")), "target", "left_semi").select(F.concat_ws("|", "source", "target").alias("key"))
    said = lambda i: i.select(F.concat_ws("|", "issue_type", "severity", F.coalesce("source_path", F.lit("")), F.regexp_replace(F.coalesce("message", F.lit("")), "[0-9]+", "#")).alias("key"))
    out = both_ways(own(base[0]), own(head[0]), "nodes", repeated=True).unionByName(both_ways(linked(base[1]), linked(head[1]), "edges")).unionByName(both_ways(columns(base[0], base[1]), columns(head[0], head[1]), "schema"))
    return out.unionByName(both_ways(said(base[2]), said(head[2]), "issues").where("change = 'added'"))


def capped(changes: DataFrame, keep: int = MOST_ITEMS) -> DataFrame:
    """changes: section, change, key. The first `keep` of each list, with the list's true length."""
    changes = written(changes, compression="zstd")  # read twice
    sizes = changes.groupBy("section", "change").agg(F.count(F.lit(1)).alias("total"))
    return first_of(changes, ["section", "change"], "key", ["key"], keep).join(sizes, ["section", "change"])


def pruned(issues_: DataFrame, known: DataFrame) -> DataFrame:
    """issues: issue_id, issue_type, name; known: name. All but those that say of a known object that it is missing."""
    kinds = F.col("issue_type").isin(*RESOLVABLE)
    return issues_.where(~kinds).unionByName(issues_.where(kinds).join(known.select("name").distinct(), "name", "left_anti").select(*issues_.columns))


def containing_all(texts: DataFrame, question: str) -> DataFrame:
    """texts: id, text. Those that contain every word of the question, in any order."""
    found = F.lit(True)
    for word in question.lower().split():
        found = found & F.contains(F.lower("text"), F.lit(word))
    return texts.where(found).select("id")


def preferred_meanings(mapping: DataFrame, meanings: DataFrame, locale: str) -> DataFrame:
    """mapping: target_id, semantic; meanings: semantic, locale, label, status. The approved label in the wanted locale, else in English; targets without either go."""
    of = lambda code, name: meanings.where(F.col("locale") == code).where("status = 'approved'").groupBy("semantic").agg(F.min("label").alias(name))
    rows = mapping.join(of(locale, "a"), "semantic", "left").join(of("en", "b"), "semantic", "left")
    return rows.select("target_id", "semantic", F.coalesce("a", "b").alias("label")).where("label is not null")


def detail_counts(nodes_: DataFrame, edges_: DataFrame, proof: DataFrame) -> DataFrame:
    """node, n_in, n_out, n_evidence (of its edges), n_writers: what a node's page counts. Ends are counted before they meet the nodes."""
    counts = proof.groupBy(short_key(F.col("edge_id")).alias("key")).agg(F.count(F.lit(1)).alias("v"))
    rows = edges_.withColumn("key", short_key(F.col("edge_id"))).join(counts, "key", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    # Both ends of an edge come from one row, as a union of the two would join edges with evidence twice.
    end = lambda node, i, wrote: F.struct(F.col(node).alias("node"), F.lit(i).alias("i"), F.lit(1 - i).alias("o"), wrote.alias("w"))
    ends = F.array(end("source", 0, F.lit(0)), end("target", 1, F.coalesce(F.col("edge_type").isin(*WRITE_EDGES).cast("int"), F.lit(0))))
    sums = rows.select("v", F.inline(ends)).groupBy("node").agg(*(F.sum(k).alias(v) for k, v in (("i", "n_in"), ("o", "n_out"), ("v", "n_evidence"), ("w", "n_writers"))))
    return nodes_.select(F.col("stable_id").alias("node")).join(sums, "node", "left").select("node", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_in", "n_out", "n_evidence", "n_writers")))


def rolled_up_tree(flows_: DataFrame) -> DataFrame:
    """flows: menu, feature, flow, status, questions. A row for each feature, each menu (feature null) and the whole tree: flows, approved ones, open questions."""
    sums = [F.count(F.lit(1)).alias("flows"), F.count_if(F.col("status") == "approved").alias("approved"), F.sum("questions").alias("questions")]
    leaves = flows_.groupBy("menu", "feature").agg(*sums)
    up = [F.sum(c).alias(c) for c in ("flows", "approved", "questions")]
    menus = leaves.groupBy("menu").agg(*up).select("menu", F.lit(None).cast("string").alias("feature"), "flows", "approved", "questions")
    whole = menus.agg(*up).select(F.lit(None).cast("string").alias("menu"), F.lit(None).cast("string").alias("feature"), "flows", "approved", "questions")
    return leaves.select("menu", "feature", "flows", "approved", "questions").unionByName(menus).unionByName(whole)


def dense_ids(keys: DataFrame, name: str = "id") -> DataFrame:
    """keys: stable_id, distinct. Numbers from 1 in the order of the ids, without a gap.

    The ids are dealt by range; each part numbers its own from the number of those before it.
    """
    parts = written(keys.repartitionByRange("stable_id").withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each part
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("stable_id"))
    return parts.withColumn("_k", inside).join(F.broadcast(offsets), "_part").select("stable_id", (F.col("_before") + F.col("_k")).cast("long").alias(name))


def serving_rows(proof: DataFrame, ids: DataFrame) -> DataFrame:
    """proof: edge_id, source_path, start_line, confidence; ids: stable_id, id. Evidence under small ids; a line that isn't positive is null."""
    line = F.when(F.col("start_line") > 0, F.col("start_line"))
    return proof.join(ids.select(F.col("stable_id").alias("edge_id"), "id"), "edge_id").select("id", "source_path", line.alias("line"), "confidence")


def names_of(nodes_: DataFrame, proof: DataFrame, names: DataFrame) -> DataFrame:
    """proof: node, path, line; names: target_id, locale, value. For each node its first evidence and its names by locale."""
    first = proof.groupBy("node").agg(F.min(F.struct("path", "line")).alias("p"))
    best = names.groupBy("target_id", "locale").agg(F.min("value").alias("value"))
    local = best.groupBy(F.col("target_id").alias("node")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "locale", "value"))), ";").alias("names"))  # at most a row for each locale
    return nodes_.select(F.col("stable_id").alias("node")).join(first, "node", "left").join(local, "node", "left").select("node", F.col("p.path").alias("path"), F.col("p.line").alias("line"), "names")


def citations(texts: DataFrame, members: DataFrame) -> DataFrame:
    """texts: id, owner, text; members: owner, node, name. What [[names]] in a text refer to: a name that one node of the owner has."""
    cited = texts.select("id", "owner", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1)))).alias("name"))
    known = members.groupBy("owner", "name").agg(F.count_distinct("node").alias("n"), F.min("node").alias("node"))
    rows = cited.join(known, ["owner", "name"], "left")
    status = F.when(F.col("n") == 1, "linked").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return rows.select("id", "name", status.alias("status"), F.when(F.col("n") == 1, F.col("node")).alias("node"))


def shown_way(path: Column, most: int = 5) -> Column:
    """A chain of hops; a longer one keeps two at either end around an ellipsis."""
    short = F.concat(F.slice(path, 1, 2), F.array(F.lit("…")), F.slice(path, -2, 2))
    return F.array_join(F.when(F.size(path) <= most, path).otherwise(short), " → ")


def meaning_of(entries: DataFrame, links: DataFrame) -> DataFrame:
    """entries: semantic, locale, label, aliases; links: semantic, node. One row for each meaning: labels by locale, aliases in order without repeats, linked nodes."""
    rows = entries.groupBy("semantic").agg(F.sort_array(F.collect_list(F.struct("locale", "label", "aliases"))).alias("all"))  # at most a row for each locale
    linked = links.groupBy("semantic").agg(F.count_distinct("node").alias("linked"))
    rows = rows.join(linked, "semantic", "left")
    return rows.select("semantic", F.array_join("all.label", ";").alias("labels"), F.array_join(F.array_distinct(F.flatten("all.aliases")), ";").alias("aliases"), F.coalesce("linked", F.lit(0)).alias("linked"))


def uncertain(answer: DataFrame, stale: DataFrame, nodes_: DataFrame, issues_: DataFrame) -> DataFrame:
    """answer: id, node. For each answer: its nodes in changed files (stale: node), those that are unresolved, and the kinds of issues on them."""
    marked = answer.join(stale.select("node").distinct().withColumn("s", F.lit(1)), "node", "left").join(nodes_.where("node_type = 'UNRESOLVED_REFERENCE'").select(F.col("stable_id").alias("node")).withColumn("u", F.lit(1)), "node", "left")
    kinds = answer.join(issues_.select(F.col("source_node").alias("node"), "issue_type").distinct(), "node").groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("issue_type")), ",").alias("kinds"))
    return marked.groupBy("id").agg(F.count("s").alias("stale"), F.count("u").alias("unresolved")).join(kinds, "id", "left")


def _dec(s, d):
    return table(s, d, "documents").select(F.concat(F.lit("table:"), (F.col("doc_id") % 97).cast("string")).alias("target_id"), F.col("lang").alias("locale"), F.md5("text").alias("value"))


def _base(s, d):
    return nodes(s, d).where("not (node_type = 'SCREEN' and stable_id like '%4')"), edges(s, d).where("edge_type <> 'READS' or target not like '%3'"), issues(s, d).where("issue_type <> 'ERROR'")


def _head(s, d):
    return nodes(s, d).where("not (node_type = 'TABLE' and stable_id like '%7')"), edges(s, d).where("edge_type <> 'DELETES' or target not like '%9'"), issues(s, d)


def _flow_rows(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderpriority").alias("menu"), F.col("o_orderstatus").alias("feature"), F.col("o_orderkey").alias("flow"), F.when(F.col("o_custkey") % 3 == 0, "approved").otherwise("draft").alias("status"), (F.col("o_orderkey") % 4).alias("questions"))


QUERIES = {
    "nodes_by_any_id": lambda s, d: by_any_id(nodes(s, d).select(F.when(F.crc32("stable_id") % 2 == 0, F.col("stable_id")).otherwise(small_id(F.col("stable_id")).cast("string")).alias("text")), nodes(s, d)).select("stable_id", "node_type"),
    "evidence_location": lambda s, d: evidence(s, d).select("edge_id", F.concat_ws(":", "source_path", "start_line").alias("location")),
    "data_target_nodes": lambda s, d: nodes(s, d).where(is_data_target(F.col("node_type"), F.lit(None).cast("string"))).groupBy("node_type").agg(F.count(F.lit(1)).alias("n")),
    "node_search": lambda s, d: searched(nodes(s, d), _dec(s, d), "ring", but=("API_OPERATION",)),
    "edges_at_level": lambda s, d: at_level(nodes(s, d), edges(s, d), nodes(s, d).where("node_type = 'SYSTEM'"), ("APPLICATION", "SCREEN", "TABLE")).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")),
    "graph_compare": lambda s, d: compared_graphs(_base(s, d), _head(s, d)),
    "graph_compare_capped": lambda s, d: capped(compared_graphs(_base(s, d), _head(s, d))),
    "changed_node_ids": lambda s, d: compared_graphs(_base(s, d), _head(s, d)).where("section in ('nodes', 'edges')").select(F.explode(F.when(F.col("section") == "nodes", F.array("key")).otherwise(F.array(F.split("key", r"\|")[0], F.split("key", r"\|")[3]))).alias("node")).distinct(),
    "heavy_properties": lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.length("text") <= 1024, F.col("text")).alias("kept")),
    "stale_issues_pruned": lambda s, d: pruned(table(s, d, "events").select(F.col("event_id").alias("issue_id"), F.when(F.col("event_type") == "click", "TABLE_NOT_IMPORTED").otherwise("OTHER").alias("issue_type"), (F.col("event_id") % 100).cast("string").alias("name")), table(s, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("name"))).select("issue_id"),
    "business_search": lambda s, d: containing_all(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("text")), "Ring brand#1"),
    "preferred_meanings": lambda s, d: preferred_meanings(table(s, d, "part").select(F.concat(F.lit("table:"), F.col("p_partkey").cast("string")).alias("target_id"), (F.col("p_partkey") % 70).alias("semantic")), table(s, d, "documents").select((F.col("doc_id") % 61).alias("semantic"), F.col("lang").alias("locale"), F.md5("text").alias("label"), F.when(F.col("doc_id") % 3 == 0, "draft").otherwise("approved").alias("status")), "fr"),
    "issues_with_nodes": lambda s, d: issues(s, d).join(nodes(s, d).select(F.col("stable_id").alias("source_node"), "name"), "source_node", "left").select("issue_id", "issue_type", "name"),
    "io_of_owners": lambda s, d: edges(s, d).where("edge_type = 'READS'").join(nodes(s, d).where("node_type = 'METHOD'").select(F.col("stable_id").alias("source")), "source", "left_semi").join(nodes(s, d).select(F.col("stable_id").alias("target"), F.col("name").alias("item")), "target").select("source", "target", "item"),
    "nodes_in_changed_files": lambda s, d: evidence(s, d).where("source_path like '%-01.sql'").join(edges(s, d).select("edge_id", F.col("source").alias("node")), "edge_id").select("node").distinct(),
    "label_term_totals": lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("concept"), F.size(F.array_distinct(tokens(F.concat_ws(" ", "p_name", "p_type"), fold_ascii))).alias("terms")),
    "concepts_unlinked": lambda s, d: table(s, d, "customer").select((F.col("c_custkey") % 40).alias("semantic"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("aliases")).join(s.range(0, 40, 3).select(F.col("id").alias("semantic")), "semantic", "left_anti").groupBy("semantic").agg(F.array_join(F.slice(F.sort_array(F.collect_set("label")), 1, 100), ", ").alias("labels"), F.max("aliases").alias("aliases")),
    "node_detail_counts": lambda s, d: detail_counts(nodes(s, d), edges(s, d), evidence(s, d)),
    "menu_rollup": lambda s, d: rolled_up_tree(_flow_rows(s, d)),
    "dense_ids": lambda s, d: dense_ids(nodes(s, d).select("stable_id")),
    "shortest_name_first": lambda s, d: nodes(s, d).where("node_type = 'TABLE'").groupBy(F.split("name", " ")[1].alias("word")).agg(F.min(F.struct(F.when(F.lower("name") == "ring", 0).otherwise(1).alias("exact"), F.length("name").alias("length"), "name", "stable_id")).alias("m")).select("word", F.col("m.name").alias("name"), F.col("m.stable_id").alias("stable_id")),
    "columns_in_order": lambda s, d: table(s, d, "lineitem").select("l_orderkey", F.to_json(F.struct(F.col("l_linenumber").cast("string").alias("ordinal_position"))).alias("properties"), "l_partkey").withColumn("position", F.get_json_object("properties", "$.ordinal_position").cast("int")).withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("position", "l_partkey"))).select("l_orderkey", "l_partkey", "rank"),
    "flows_complete_first": lambda s, d: _flow_rows(s, d).withColumn("k", F.row_number().over(Window.partitionBy("menu", "feature").orderBy((F.col("status") == "approved").desc(), "flow"))).where("k <= 12").select("menu", "feature", "flow", "k"),
    "unassigned_operations": lambda s, d: nodes(s, d).where("node_type = 'API_OPERATION'").join(edges(s, d).where("edge_type = 'CALLS_API' and source like '%1'").select(F.col("target").alias("stable_id")), "stable_id", "left_anti").orderBy("stable_id").limit(300).select("stable_id"),
    "snippets": lambda s, d: table(s, d, "documents").select("doc_id", F.length(shortened(F.col("text"), SNIPPET)).alias("n"), F.md5(shortened(F.col("text"), LINE)).alias("line")),
    "snapshot_sections": lambda s, d: _dec(s, d).where("locale in ('en', 'de')").select("locale", "value").exceptAll(_dec(s, d).where("locale in ('de', 'fr')").select("locale", "value")).withColumn("side", F.lit("left")).unionByName(_dec(s, d).where("locale in ('de', 'fr')").select("locale", "value").exceptAll(_dec(s, d).where("locale in ('en', 'de')").select("locale", "value")).withColumn("side", F.lit("right"))),
    "serving_evidence": lambda s, d: serving_rows(evidence(s, d).withColumn("start_line", F.col("start_line") - 2), edges(s, d).select(F.col("edge_id").alias("stable_id"), small_id(F.col("edge_id")).alias("id"))),
    "node_facts": lambda s, d: names_of(nodes(s, d).where("node_type in ('TABLE', 'METHOD')"), evidence(s, d).join(edges(s, d).select("edge_id", F.col("source").alias("node")), "edge_id").select("node", F.col("source_path").alias("path"), F.col("start_line").alias("line")), _dec(s, d)),
    "citation_links": lambda s, d: citations(table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("owner"), F.concat(F.lit("see [["), F.col("c_nationkey").cast("string"), F.lit("]] and [[x]] or [["), (F.col("c_custkey") % 30).cast("string"), F.lit("]]")).alias("text")), table(s, d, "supplier").select((F.col("s_suppkey") % 5).alias("owner"), F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 30).cast("string").alias("name"))),
    "hop_chains": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t")).select("conv_id", shown_way(F.col("t.role")).alias("way")),
    "meanings": lambda s, d: meaning_of(table(s, d, "documents").groupBy((F.col("doc_id") % 23).alias("semantic"), F.col("lang").alias("locale")).agg(F.min(F.md5("text")).alias("label"), F.array_sort(F.collect_set("source")).alias("aliases")), table(s, d, "customer").select((F.col("c_custkey") % 30).alias("semantic"), F.col("c_nationkey").alias("node"))),
    "answer_uncertainty": lambda s, d: uncertain(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("screen:"), F.col("o_custkey").cast("string")).alias("node")), nodes(s, d).where("node_type = 'SCREEN' and stable_id like '%3'").select(F.col("stable_id").alias("node")), nodes(s, d), issues(s, d)),
}

_SMALL = "('0x' || substr(sha256({}), 1, 15))::bigint"
_DEC = ", dec as (select 'table:' || (doc_id % 97) as target_id, lang as locale, md5(text) as value from documents)"
_TWO = GRAPH_SQL + """, bn as (select * from nodes where not (node_type = 'SCREEN' and stable_id like '%4')), hn as (select * from nodes where not (node_type = 'TABLE' and stable_id like '%7')),
  ek as (select concat_ws('|', source, edge_type, operation, target) as key, edge_type, target from edges where edge_type <> 'CONTAINS'), be as (select distinct key from ek where edge_type <> 'READS' or target not like '%3'), he as (select distinct key from ek where edge_type <> 'DELETES' or target not like '%9'),
  ik as (select distinct issue_type, concat_ws('|', issue_type, severity, source_path, regexp_replace(message, '[0-9]+', '#', 'g')) as key from issues), bi as (select key from ik where issue_type <> 'ERROR'),
  changes as (select 'nodes' as section, 'added' as change, stable_id as key from hn where stable_id not in (select stable_id from bn) union all select 'nodes', 'removed', stable_id from bn where stable_id not in (select stable_id from hn)
    union all select 'edges', 'added', key from he where key not in (select key from be) union all select 'edges', 'removed', key from be where key not in (select key from he) union all select 'issues', 'added', key from ik where key not in (select key from bi)) """
_FLOWS = "with f as (select o_orderpriority as menu, o_orderstatus as feature, o_orderkey as flow, case when o_custkey % 3 = 0 then 'approved' else 'draft' end as status, o_orderkey % 4 as questions from orders) "
_SHORT = "case when length({0}) <= {1} then {0} else rtrim(substr({0}, 1, {1} - 1)) || '…' end"
_PLAIN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
ORACLES = {
    "nodes_by_any_id": GRAPH_SQL + "select stable_id, node_type from nodes",
    "evidence_location": GRAPH_SQL + "select edge_id, source_path || ':' || start_line as location from evidence",
    "data_target_nodes": "select 'TABLE' as node_type, count(*) as n from part",
    "node_search": GRAPH_SQL + _DEC + ", l as (select target_id, bool_or(contains(value, 'ring')) as hit, min(value) as value from dec group by 1) select stable_id, case when lower(name) = 'ring' then 0 else 1 end as exact from nodes left join l on stable_id = target_id where node_type <> 'API_OPERATION' and (contains(lower(stable_id), 'ring') or contains(lower(name), 'ring') or contains(lower(qualified_name), 'ring') or coalesce(hit, false)) order by exact, lower(coalesce(value, name)), stable_id limit 50",
    "edges_at_level": GRAPH_SQL + "select edge_type, count(*) as n from edges where edge_type = 'CONTAINS' group by 1",
    "graph_compare": _TWO + "select section, change, key from changes",
    "graph_compare_capped": _TWO + "select section, change, key, count(*) over (partition by section, change) as total from changes qualify row_number() over (partition by section, change order by key) <= 200",
    "changed_node_ids": _TWO + "select distinct case when section = 'nodes' then key else split_part(key, '|', k) end as node from changes, (values (1), (4)) v(k) where section <> 'issues'",
    "heavy_properties": "select doc_id, case when length(text) <= 1024 then text end as kept from documents",
    "stale_issues_pruned": "select event_id as issue_id from events where event_type <> 'click' or (event_id % 100) not in (select p_partkey from part where p_partkey % 2 = 0)",
    "business_search": "select p_partkey as id from part where contains(lower(p_type || ' ' || p_name || ' ' || p_brand), 'ring') and contains(lower(p_type || ' ' || p_name || ' ' || p_brand), 'brand#1')",
    "preferred_meanings": "with m as (select doc_id % 61 as semantic, lang, min(md5(text)) as label from documents where doc_id % 3 <> 0 group by all) select 'table:' || p_partkey as target_id, p_partkey % 70 as semantic, coalesce(a.label, b.label) as label from part left join m a on a.semantic = p_partkey % 70 and a.lang = 'fr' left join m b on b.semantic = p_partkey % 70 and b.lang = 'en' where coalesce(a.label, b.label) is not null",
    "issues_with_nodes": GRAPH_SQL + "select issue_id, issue_type, name from issues left join nodes on source_node = stable_id",
    "io_of_owners": GRAPH_SQL + "select source, target, name as item from edges join nodes on target = stable_id where edge_type = 'READS'",
    "nodes_in_changed_files": GRAPH_SQL + "select distinct e.source as node from evidence join edges e using (edge_id) where source_path like '%-01.sql'",
    "label_term_totals": "select p_partkey as concept, len(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda t: length(t) >= 2)))::int as terms from part",
    "concepts_unlinked": "select c_custkey % 40 as semantic, array_to_string(list_slice(list_sort(list(distinct c_name)), 1, 100), ', ') as labels, max(c_nationkey) as aliases from customer where (c_custkey % 40) % 3 <> 0 group by 1",
    "node_detail_counts": GRAPH_SQL + ", v as (select edge_id, count(*) as v from evidence group by 1), e as (select source, target, edge_type, coalesce(v, 0) as v from edges left join v using (edge_id)), u as (select source as node, 0 as i, 1 as o, v, 0 as w from e union all select target, 1, 0, v, case when edge_type in ('INSERTS', 'UPDATES', 'DELETES') then 1 else 0 end from e), g as (select node, sum(i)::bigint as n_in, sum(o)::bigint as n_out, sum(v)::bigint as n_evidence, sum(w)::bigint as n_writers from u group by 1) select stable_id as node, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out, coalesce(n_evidence, 0) as n_evidence, coalesce(n_writers, 0) as n_writers from nodes left join g on node = stable_id",
    "menu_rollup": _FLOWS + "select menu, feature, count(*) as flows, count(*) filter (status = 'approved') as approved, sum(questions)::bigint as questions from f group by grouping sets ((menu, feature), (menu), ())",
    "dense_ids": GRAPH_SQL + "select stable_id, row_number() over (order by stable_id) as id from nodes",
    "shortest_name_first": GRAPH_SQL + "select split_part(name, ' ', 2) as word, name, stable_id from nodes where node_type = 'TABLE' qualify row_number() over (partition by split_part(name, ' ', 2) order by lower(name) <> 'ring', length(name), name, stable_id) = 1",
    "columns_in_order": "select l_orderkey, l_partkey, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey))::int as rank from lineitem",
    "flows_complete_first": _FLOWS + "select menu, feature, flow, (row_number() over (partition by menu, feature order by status = 'approved' desc, flow))::int as k from f qualify k <= 12",
    "unassigned_operations": GRAPH_SQL + "select stable_id from nodes where node_type = 'API_OPERATION' and stable_id not in (select target from edges where edge_type = 'CALLS_API' and source like '%1') order by 1 limit 300",
    "snippets": "select doc_id, length(" + _SHORT.format(_PLAIN, 500) + ")::int as n, md5(" + _SHORT.format(_PLAIN, 240) + ") as line from documents",
    "snapshot_sections": "with d as (select lang as locale, md5(text) as value from documents), a as (select * from d where locale in ('en', 'de')), b as (select * from d where locale in ('de', 'fr')) select *, 'left' as side from (select * from a except all select * from b) union all select *, 'right' from (select * from b except all select * from a)",
    "serving_evidence": GRAPH_SQL + f"select {_SMALL.format('edge_id')} as id, source_path, case when start_line > 2 then start_line - 2 end as line, confidence from evidence join edges using (edge_id)".replace("evidence join edges using (edge_id)", "(select v.* from evidence v join (select distinct edge_id from edges) using (edge_id))"),
    "node_facts": GRAPH_SQL + _DEC + ", p as (select e.source as node, min((source_path, start_line)) as p from evidence join edges e using (edge_id) group by 1), l as (select target_id, string_agg(locale || '=' || value, ';' order by locale || '=' || value) as names from (select target_id, locale, min(value) as value from dec group by all) group by 1) select stable_id as node, p[1] as path, p[2] as line, names from nodes left join p on node = stable_id left join l on target_id = stable_id where node_type in ('TABLE', 'METHOD')",
    "citation_links": "with c as (select c_custkey as id, c_custkey % 5 as owner, unnest(list_distinct([c_nationkey::varchar, 'x', (c_custkey % 30)::varchar])) as name from customer), m as (select s_suppkey % 5 as owner, (s_suppkey % 30)::varchar as name, count(distinct s_suppkey) as n, min(s_suppkey) as node from supplier group by all) select id, name, case when n = 1 then 'linked' when n > 1 then 'ambiguous' else 'unknown' end as status, case when n = 1 then node end as node from c left join m using (owner, name)",
    "hop_chains": "with t as (select conv_id, list(role order by turn, role) as r from conversations group by 1) select conv_id, array_to_string(case when len(r) <= 5 then r else list_concat(r[1:2], ['…'], r[len(r) - 1:len(r)]) end, ' → ') as way from t",
    "meanings": "with e as (select doc_id % 23 as semantic, lang as locale, min(md5(text)) as label, list_sort(list(distinct source)) as aliases from documents group by all), l as (select c_custkey % 30 as semantic, count(distinct c_nationkey) as linked from customer group by 1), u as (select semantic, a, min((locale, i)) as f from (select semantic, locale, unnest(aliases) as a, generate_subscripts(aliases, 1) as i from e) group by all), x as (select semantic, string_agg(a, ';' order by f) as aliases from u group by 1), y as (select semantic, string_agg(label, ';' order by locale) as labels from e group by 1) select semantic, labels, aliases, coalesce(linked, 0) as linked from y join x using (semantic) left join l using (semantic)",
    "answer_uncertainty": GRAPH_SQL + ", a as (select o_orderkey as id, 'screen:' || o_custkey as node from orders), k as (select id, string_agg(distinct issue_type, ',' order by issue_type) as kinds from a join issues on source_node = node group by 1) select id, case when node like '%3' and node in (select stable_id from nodes) then 1 else 0 end::bigint as stale, 0::bigint as unresolved, kinds from a left join k using (id)",
}
