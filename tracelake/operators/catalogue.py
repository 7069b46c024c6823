"""Catalogues, dictionaries, routing of references, message topics, skeletons of flows and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.contract import TYPE_PRIOR, table, valued
from tracelake.functions.text import tokens
from tracelake.operators.joins import maybe
from tracelake.operators.ranks import first_of
from tracelake.operators.traverse import _every_screen, flows
from tracelake.plans.projection import GRAPH_SQL, edges, evidence, nodes
from tracelake.sources.scratch import written

# Kinds of objects a catalogue may hold, and states of a dictionary entry.
OBJECT_TYPES = ("TABLE", "VIEW", "MATERIALIZED_VIEW")
STATES = ("approved", "draft", "rejected")


def catalogue_nodes(objects: DataFrame) -> DataFrame:
    """objects: database, schema, object. A node for each; its id names the schema only where the object's name repeats in the database."""
    distinct = objects.select("database", "schema", "object").distinct()
    often = distinct.groupBy("database", "object").agg((F.count(F.lit(1)) > 1).alias("repeats"))
    node = F.concat_ws(":", F.lit("table"), "database", F.when(F.col("repeats"), F.concat_ws(".", "schema", "object")).otherwise(F.col("object")))
    return distinct.join(often, ["database", "object"]).select(node.alias("node"), "database", "schema", "object")


def rejected_records(objects: DataFrame) -> DataFrame:
    """Records without a name, or of a kind that is not an object's, with the reason."""
    reason = F.when(F.trim(F.coalesce("object", F.lit(""))) == "", "name").when(~F.upper("kind").isin(*OBJECT_TYPES), "kind")
    return objects.withColumn("reason", reason).where("reason is not null")


def mapped(rows: DataFrame, fields: dict[str, str], constants: dict[str, str], transforms: dict[str, tuple[str, ...]]) -> DataFrame:
    """A profile's projection: field to header, constants, and chains of trim, upper, lower."""
    steps = {"trim": F.trim, "upper": F.upper, "lower": F.lower}

    def made(field: str, header: str) -> Column:
        value = F.col(header).cast("string")
        for step in transforms.get(field, ()):
            value = steps[step](value)
        return value.alias(field)

    return rows.select(*[made(f, h) for f, h in fields.items()], *[F.lit(v).alias(k) for k, v in constants.items()])


def dictionary(rows: DataFrame) -> DataFrame:
    """rows: id, locale, label, aliases, state, line. The last line of each id and locale, aliases apart; bad ids and states are left out."""
    good = rows.where(F.col("id").rlike(r"^[A-Za-z][A-Za-z0-9_.-]*$") & F.col("state").isin(*STATES))
    last = good.groupBy("id", "locale").agg(F.max(F.struct("line", "label", "aliases", "state")).alias("r"))
    return last.select("id", "locale", "r.label", F.array_distinct(F.filter(F.split("r.aliases", r"\s*\|\s*"), lambda a: a != "")).alias("aliases"), "r.state")


def alias_links(concepts: DataFrame, names: DataFrame, cap: int = 50) -> DataFrame:
    """concepts: concept, alias; names: node, name. Nodes whose compact name is the alias's; at most `cap` of an alias, the smallest ids."""
    compact = lambda c: F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    # Nodes are cut before they meet the aliases: which come first depends on the compact name only.
    few = first_of(names.select("node", compact(F.col("name")).alias("key")), ["key"], "node", ["node"], cap)
    return concepts.select("concept", compact(F.col("alias")).alias("key")).distinct().join(few, "key").select("concept", "node")


def message_edges(flows_: DataFrame, endpoints: DataFrame) -> DataFrame:
    """flows: topic, producer, consumer; endpoints: name, node. PUBLISHES and CONSUMED_BY edges of topics, only for names with one node; the rest as issues."""
    ends = flows_.select("topic", F.lit("PUBLISHES").alias("edge_type"), F.col("producer").alias("name")).unionByName(flows_.select("topic", F.lit("CONSUMED_BY").alias("edge_type"), F.col("consumer").alias("name"))).distinct()
    known = endpoints.groupBy("name").agg(F.count_distinct("node").alias("n"), F.min("node").alias("node"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("linked")
    return ends.join(known, "name", "left").select("topic", "edge_type", "name", status.alias("status"), F.when(F.col("n") == 1, F.col("node")).alias("node"))


def routed(references: DataFrame, synonyms: DataFrame, catalogue: DataFrame) -> DataFrame:
    """references: ref, owner, name; synonyms: name, target; catalogue: owner, name. Where each leads: a synonym's target, a table of the owner,
    one of another owner, or nowhere, with the confidence of each."""
    s = synonyms.groupBy("name").agg(F.min("target").alias("target"))
    via = references.join(s, "name", "left").withColumn("name", F.coalesce("target", "name"))
    own = catalogue.select("owner", "name").distinct().withColumn("own", F.lit(True))
    other = catalogue.groupBy("name").agg(F.min("owner").alias("other"))
    out = via.join(own, ["owner", "name"], "left").join(other, "name", "left")
    kind = F.when(F.col("own"), F.when(F.col("target").isNotNull(), "synonym").otherwise("own")).when(F.col("other").isNotNull(), "other").otherwise("absent")
    return out.select("ref", "name", kind.alias("route"), F.when(kind == "absent", 0.5).when(kind == "other", 0.8).otherwise(1.0).alias("confidence"))


def skeletons(flows_: DataFrame, systems: DataFrame) -> DataFrame:
    """flows: start, path; systems: node, system. One step for each system a flow's paths reach, numbered by first reach, then name."""
    reached = flows_.select("start", F.posexplode("path").alias("pos", "node")).join(systems, "node").groupBy("start", "system").agg(F.min("pos").alias("first"))
    return reached.withColumn("step", F.row_number().over(Window.partitionBy("start").orderBy("first", "system"))).select("start", "system", "step")


def ranked_by_overlap(documents: DataFrame, wanted: list[str], keep: int = 4) -> DataFrame:
    """documents: doc, nodes. Those that share most nodes with the wanted ones."""
    n = F.size(F.array_intersect("nodes", F.array(*[F.lit(w) for w in wanted])))
    return documents.select("doc", n.alias("shared")).where("shared > 0").orderBy(F.desc("shared"), "doc").limit(keep)


def suggestions(concepts: DataFrame, names: DataFrame, keep: int = 5) -> DataFrame:
    """concepts: concept, label, aliases, status; names: node, name. For each node the approved concepts that share a term with its name, best first.

    A label or alias that stands in the name scores 0.84 and 0.05 for each of its terms up to three, 0.99 at most; others 0.42 and up to 0.37 by the share of
    the concept's terms, 0.79 at most. Pairs come from an index of terms. A term of many concepts and many names makes
    all their pairs before the best are kept; what a concept scores depends on the folded name only, so nodes of the same one are paired and scored once.
    """
    approved = concepts.where("lower(status) = 'approved'").select("concept", "label", F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("every"))
    approved = approved.withColumn("t", F.array_distinct(tokens(F.array_join("every", " "))))
    a = approved.select("concept", "label", F.transform("every", lambda x: F.lower(F.trim(x))).alias("every"), F.size("t").alias("of"), F.explode("t").alias("term"))
    folded = names.select("node", F.lower("name").alias("context"))
    b = folded.select("context").distinct().select("context", F.explode(F.array_distinct(tokens(F.col("context")))).alias("term"))
    hits = a.join(b, "term").groupBy("concept", "label", "context").agg(F.count(F.lit(1)).alias("shared"), F.first("of").alias("of"), F.first("every").alias("every"))
    stands = F.get(F.filter("every", lambda x: (x != "") & F.contains(F.col("context"), x)), 0)
    n = F.least(F.size(F.array_distinct(tokens(stands))), F.lit(3))
    score = F.when(stands.isNotNull(), F.least(F.lit(0.99), 0.84 + n * 0.05)).otherwise(F.least(F.lit(0.79), 0.42 + F.col("shared") / F.col("of") * 0.37))
    scored = hits.select("concept", "label", "context", F.round(score, 2).alias("score"))
    best = first_of(scored, ["context"], "concept", [F.desc("score"), F.lower("label"), "concept"], keep, "rank")
    return folded.join(best, "context").select("node", "concept", "score", "rank")


def in_file(rows: DataFrame, path: str) -> DataFrame:
    """The rows whose path is the file (tier 0), or ends in its last three segments (tier 1)."""
    plain = path.replace("\\", "/").removeprefix("./").removeprefix("/")
    tail = "/".join(plain.split("/")[-3:])
    tier = F.when(F.col("path") == plain, 0).when(F.endswith("path", F.lit(tail)), 1)
    return rows.withColumn("tier", tier).where("tier is not null")


def file_seeds(located: DataFrame, path: str, line: int, last: int | None = None) -> DataFrame:
    """located: node, node_type, path, line. Nodes in the file (else in files that end in its last three segments) by their type's prior, ten times as much between the lines."""
    weight = F.when(F.col("line").between(line, last or line), 10.0).otherwise(1.0) * valued(F.col("node_type"), TYPE_PRIOR, 1.0)
    # Of a node, only what lies in its best tier counts; written, as the best tier of all is asked for first.
    each = in_file(located, path).groupBy("node").agg(F.max(F.struct((-F.col("tier")).alias("near"), weight.alias("score"))).alias("m"))
    each = written(each.select("node", "m.near", "m.score"))
    best = each.agg(F.max("near").alias("best"))
    return each.join(F.broadcast(best), F.col("near") == F.col("best")).select("node", "score")


def shown_in(evidence_: DataFrame, edges_: DataFrame, nodes_: DataFrame, path: str) -> DataFrame:
    """node, node_type, path, line: the sources of the edges that evidence in the file shows, at each place.

    A file shows few edges, so only edges and nodes that may be among them are joined. Repeated edges and nodes give repeated rows.
    """
    shown = written(in_file(evidence_.select("edge_id", F.col("source_path").alias("path"), F.col("start_line").alias("line")), path).select("edge_id", "path", "line"))
    sources = maybe(edges_.select("edge_id", F.col("source").alias("node")), shown, "edge_id")
    found = written(shown.join(sources, "edge_id").select("node", "path", "line").distinct())
    return found.join(maybe(nodes_.select(F.col("stable_id").alias("node"), "node_type"), found, "node"), "node")


def _seeds(s, d):
    path = "./shipments/1996-03.sql"  # neither nodes nor edges are made distinct, as repeats don't change a maximum
    return file_seeds(shown_in(evidence(s, d), edges(s, d, distinct=False), nodes(s, d, distinct=False), path), path, 2, 3)


def _objects(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_brand").alias("database"), F.col("p_type").alias("schema"), F.col("p_name").alias("object"), F.when(F.col("p_size") % 9 == 0, "INDEX").otherwise("TABLE").alias("kind"), F.col("p_partkey").alias("line"))


def _entries(s, d):
    docs = table(s, d, "documents")
    ident = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("9x"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("c"), (F.col("doc_id") % 37).cast("string")))
    state = F.when(F.col("doc_id") % 11 == 0, "unknown").otherwise("approved")
    return docs.select(ident.alias("id"), F.col("lang").alias("locale"), F.md5("text").alias("label"), F.concat_ws(" | ", "source", "lang", "source").alias("aliases"), state.alias("state"), F.col("doc_id").alias("line"))


def _refs(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("ref"), (F.col("o_custkey") % 5).alias("owner"), F.concat(F.lit("n"), (F.col("o_orderkey") % 40).cast("string")).alias("name"))


def _topics(s, d):
    c = table(s, d, "customer")
    return c.select((F.col("c_custkey") % 12).alias("topic"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("producer"), F.concat(F.lit("handle"), (F.col("c_custkey") % 30).cast("string")).alias("consumer"))


QUERIES = {
    "catalogue_nodes": lambda s, d: catalogue_nodes(_objects(s, d)),
    "catalogue_rejects": lambda s, d: rejected_records(_objects(s, d)).select("database", "line", "reason"),
    "catalogue_profile_map": lambda s, d: mapped(table(s, d, "part"), {"table_code": "p_partkey", "schema": "p_type", "name": "p_name"}, {"database": "DB1"}, {"schema": ("lower", "trim"), "name": ("upper",)}),
    "dictionary_load": lambda s, d: dictionary(_entries(s, d)),
    "alias_links": lambda s, d: alias_links(table(s, d, "part").select(F.col("p_partkey").alias("concept"), F.upper("p_name").alias("alias")), nodes(s, d).where("node_type = 'TABLE'").select(F.col("stable_id").alias("node"), "name")).groupBy("concept").agg(F.count(F.lit(1)).alias("links"), F.min("node").alias("first_node")),
    "message_edges": lambda s, d: message_edges(_topics(s, d), nodes(s, d).where("node_type in ('APPLICATION', 'METHOD')").select("name", F.col("stable_id").alias("node"))),
    "reference_routing": lambda s, d: routed(_refs(s, d), s.range(0, 40, 4).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("n"), (F.col("id") + 1).cast("string")).alias("target")), s.range(36).select((F.col("id") % 3).alias("owner"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))),
    "flow_skeleton_steps": lambda s, d: skeletons(flows(_every_screen(s, d), edges(s, d), nodes(s, d), keep=()), nodes(s, d).select(F.col("stable_id").alias("node"), F.coalesce("system_key", "node_type").alias("system"))),
    "docs_by_overlap": lambda s, d: ranked_by_overlap(table(s, d, "benchmark").select(F.col("item_id").alias("doc"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.concat(F.lit("t"), ((F.col("item_id") * 7 + k * k) % 50).cast("string"))).alias("nodes")), ["t1", "t4", "t8", "t9", "t21"]),
    "semantic_suggestions": lambda s, d: suggestions(table(s, d, "nation").select(F.col("n_nationkey").alias("concept"), F.concat(F.lit("small "), F.lower("n_name")).alias("label"), F.array(F.concat_ws(" ", F.lit("widget"), F.col("n_nationkey").cast("string")), F.lit("")).alias("aliases"), F.when(F.col("n_nationkey") % 7 == 0, "draft").otherwise("approved").alias("status")), nodes(s, d).where("node_type = 'TABLE'").select(F.col("stable_id").alias("node"), "name")),
    "file_seeds": _seeds,
}

ORACLES = {
    "catalogue_nodes": "with o as (select distinct p_brand as database, p_type as schema, p_name as object from part) select 'table:' || database || ':' || case when count(*) over (partition by database, object) > 1 then schema || '.' || object else object end as node, database, schema, object from o",
    "catalogue_rejects": "select p_brand as database, p_partkey as line, 'kind' as reason from part where p_size % 9 = 0",
    "catalogue_profile_map": "select p_partkey::varchar as table_code, trim(lower(p_type)) as schema, upper(p_name) as name, 'DB1' as database from part",
    "dictionary_load": "select 'c' || (doc_id % 37) as id, lang as locale, md5(text) as label, [source, lang] as aliases, 'approved' as state from documents where doc_id % 10 <> 0 and doc_id % 11 <> 0 qualify row_number() over (partition by doc_id % 37, lang order by doc_id desc) = 1",
    "alias_links": "with k as (select p_partkey as concept, lower(replace(p_name, ' ', '')) as key from part), n as (select 'table:' || p_partkey as node, lower(replace(p_name, ' ', '')) as key from part), r as (select concept, node from k join n using (key) qualify row_number() over (partition by concept order by node) <= 50) select concept, count(*) as links, min(node) as first_node from r group by 1",
    "message_edges": GRAPH_SQL + ", f as (select c_custkey % 12 as topic, 'NATION_' || c_nationkey as producer, 'handle' || (c_custkey % 30) as consumer from customer), e as (select distinct topic, 'PUBLISHES' as edge_type, producer as name from f union select distinct topic, 'CONSUMED_BY', consumer from f), k as (select name, count(distinct stable_id) as n, min(stable_id) as node from nodes where node_type in ('APPLICATION', 'METHOD') group by 1) select topic, edge_type, name, case when n is null then 'missing' when n > 1 then 'ambiguous' else 'linked' end as status, case when n = 1 then node end as node from e left join k using (name)",
    "reference_routing": "with r as (select o_orderkey as ref, o_custkey % 5 as owner, o_orderkey % 40 as k from orders), v as (select ref, owner, k % 4 = 0 as syn, case when k % 4 = 0 then k + 1 else k end as k from r) select ref, 'n' || k as name, case when k < 36 and k % 3 = owner then case when syn then 'synonym' else 'own' end when k < 36 then 'other' else 'absent' end as route, case when k >= 36 then 0.5 when k % 3 = owner then 1.0 else 0.8 end::double as confidence from v",
    "flow_skeleton_steps": GRAPH_SQL + ", s as (select stable_id as start, system_key from nodes where node_type = 'SCREEN' and stable_id in (select a.source from edges a join edges m on m.source = a.target join edges t on t.source = m.target)), p as (select start, system_key as system, 0 as first from s union all select start, k, f from s, (values ('API_OPERATION', 1), ('METHOD', 2)) t(k, f)), b as (select distinct s.start, n.database_key from s join nodes n on false) select start, system, (row_number() over (partition by start order by first, system))::int as step from (select * from p union all select start, 'TABLE', 3 from s)",
    "docs_by_overlap": "select item_id as doc, len(list_intersect(list_distinct(list_transform([0, 1, 2, 3, 4, 5], lambda k: 't' || ((item_id * 7 + k * k) % 50))), ['t1', 't4', 't8', 't9', 't21']))::int as shared from benchmark where shared > 0 order by shared desc, doc limit 4",
    "semantic_suggestions": """with c as (select n_nationkey as concept, 'small ' || lower(n_name) as label, 'widget ' || n_nationkey as alias from nation where n_nationkey % 7 <> 0),
      t as (select concept, label, alias, list_distinct(list_filter(regexp_split_to_array(label || ' ' || alias, '[^a-z0-9]+'), lambda x: length(x) >= 2)) as terms from c),
      n as (select 'table:' || p_partkey as node, lower(p_name) as context, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) >= 2)) as own from part),
      h as (select node, concept, label, case when contains(context, label) then label when contains(context, alias) then alias end as stands, len(list_intersect(terms, own)) as shared, len(terms) as all_terms from t join n on len(list_intersect(terms, own)) > 0),
      s as (select node, concept, label, round(case when stands is not null then least(0.99, 0.84 + least(len(list_filter(regexp_split_to_array(stands, '[^a-z0-9]+'), lambda x: length(x) >= 2)), 3) * 0.05) else least(0.79, 0.42 + shared / all_terms * 0.37) end, 2)::double as score from h)
      select node, concept, score, (row_number() over (partition by node order by score desc, label, concept))::int as rank from s qualify rank <= 5""",
    "file_seeds": GRAPH_SQL + "select e.source as node, max(case when start_line between 2 and 3 then 10.0 else 1.0 end)::double as score from evidence v join edges e using (edge_id) where source_path = 'shipments/1996-03.sql' group by 1",
}
