"""Rules, decisions and names kept as versioned rows, and small reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.contract import table
from tracelake.operators.diff import combined, fingerprints
from tracelake.operators.merge import latest
from tracelake.plans.projection import GRAPH_SQL, edges, evidence, nodes

# The steps a rule may take.
TRANSITIONS = (("draft", "approved"), ("approved", "needs_review"), ("needs_review", "approved"), ("draft", "retired"), ("approved", "retired"), ("needs_review", "retired"))
LOCALES = ("ja", "en", "vi")


def invalid_transitions(versions: DataFrame, allowed: tuple = TRANSITIONS) -> DataFrame:
    """versions: rule, version, status. Steps between versions that are not allowed."""
    order = Window.partitionBy("rule").orderBy("version")
    steps = versions.select("rule", "version", "status", F.lag("status").over(order).alias("before")).where("before is not null")
    table_ = F.broadcast(versions.sparkSession.createDataFrame(list(allowed), "before string, status string"))  # a fixed list
    return steps.join(table_, ["before", "status"], "left_anti")


def revalidated(rules: DataFrame, prints: DataFrame) -> DataFrame:
    """rules: rule, nodes, fingerprint, status. Approved rules whose nodes have other fingerprints now need review."""
    now = combined(rules.select(F.col("rule").alias("owner"), F.explode("nodes").alias("node")), prints)
    joined = rules.join(now.select(F.col("owner").alias("rule"), F.col("fingerprint").alias("now")), "rule", "left")
    moved = (F.col("status") == "approved") & ~F.col("fingerprint").eqNullSafe(F.col("now"))
    return joined.select("rule", F.when(moved, "needs_review").otherwise(F.col("status")).alias("status"))


def names_in_order(names: DataFrame) -> DataFrame:
    """names: target, locale, value, review. All names of a target as one line, in the order of the locales; rejected ones are left out."""
    place = F.coalesce(*[F.when(F.col("locale") == x, k) for k, x in enumerate(LOCALES)], F.lit(len(LOCALES)))
    rows = names.where("review <> 'rejected'").select("target", F.struct(place.alias("k"), "locale", "value").alias("n"))
    g = rows.groupBy("target").agg(F.sort_array(F.collect_set("n")).alias("all"))
    return g.select("target", F.array_join(F.transform("all", lambda n: F.concat_ws(":", n["locale"], n["value"])), "; ").alias("names"))


def unique_labels(nodes_: DataFrame) -> DataFrame:
    """A label for each node: its name, with its system where the name repeats, and with a part of its digest where that repeats too."""
    often = nodes_.groupBy("name").agg((F.count(F.lit(1)) > 1).alias("repeats"))
    first = nodes_.join(often, "name").select("stable_id", F.when(F.col("repeats"), F.concat_ws("/", F.coalesce("system_key", "database_key"), "name")).otherwise(F.col("name")).alias("label"))
    taken = first.groupBy("label").agg((F.count(F.lit(1)) > 1).alias("again"))
    return first.join(taken, "label").select("stable_id", F.when(F.col("again"), F.concat_ws("#", "label", F.substring(F.sha2("stable_id", 256), 1, 8))).otherwise(F.col("label")).alias("label"))


def response_confidence(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """The least confidence of what an answer holds; null for an empty answer."""
    return nodes_.select(F.lit(1.0).alias("confidence")).unionByName(edges_.select("confidence")).agg(F.min("confidence").alias("confidence"))


def page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The rows behind a cursor, one more than a page, so that a next page shows."""
    return rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(size + 1)


def by_policy(rows: DataFrame, key: list[str], line: str, policy: str) -> DataFrame:
    """Rows of a catalogue that repeat a key: the first or the last line wins, or with `error` all are returned that are too many."""
    if policy == "error":
        return rows.groupBy(*key).agg(F.count_distinct(F.struct(*[c for c in rows.columns if c not in (*key, line)])).alias("n")).where("n > 1")
    rest = [c for c in rows.columns if c not in (*key, line)]
    pick = F.min if policy == "first-wins" else F.max
    return rows.groupBy(*key).agg(pick(F.struct(line, *rest)).alias("_r")).select(*key, "_r.*")


def issue_owners(issues_: DataFrame, located: DataFrame) -> DataFrame:
    """issues: issue_id, node, path; located: node, path. How many nodes an issue belongs to: its own, and all with evidence in its file.

    The members of a file are one table, and issues point to the file; no pair of an issue and a node of a busy file is made.
    """
    members = located.select("path", "node").distinct()
    sizes = members.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    inside = issues_.join(members, ["path", "node"], "left_semi").select("issue_id").withColumn("inside", F.lit(True))
    out = issues_.select("issue_id", "node", "path").join(sizes, "path", "left").join(inside, "issue_id", "left")
    own = F.when(F.col("node").isNotNull() & F.col("inside").isNull(), 1).otherwise(0)
    return out.select("issue_id", (F.coalesce("n", F.lit(0)) + own).alias("owners")).where("owners > 0")


def _versions(s, d):
    e = table(s, d, "events")
    status = F.element_at(F.array(*[F.lit(x) for x in ("draft", "approved", "needs_review", "retired", "approved")]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("user_id").alias("rule"), F.col("event_id").alias("version"), status.alias("status"))


def _rules(s, d):
    nodes_ = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(F.lit("screen:"), ((F.col("item_id") * 3 + k) % 140).cast("string")))
    return table(s, d, "benchmark").select(F.col("item_id").alias("rule"), nodes_.alias("nodes"), F.when(F.col("item_id") % 2 == 0, "approved").otherwise("draft").alias("status"))


def _revalidate(s, d):
    before = combined(_rules(s, d).select(F.col("rule").alias("owner"), F.explode("nodes").alias("node")), fingerprints(edges(s, d))).select(F.col("owner").alias("rule"), "fingerprint")
    after = fingerprints(edges(s, d).where("not (source like 'screen:%7' and target like '%1')"))
    return revalidated(_rules(s, d).join(before, "rule"), after)


def _line_names(s, d):
    docs = table(s, d, "documents")
    return docs.select((F.col("doc_id") % 61).alias("target"), F.col("lang").alias("locale"), F.substring(F.md5("text"), 1, 6).alias("value"), F.when(F.col("doc_id") % 5 == 0, "rejected").otherwise("ok").alias("review"))


QUERIES = {
    "rule_transitions_invalid": lambda s, d: invalid_transitions(_versions(s, d)),
    "rule_status_now": lambda s, d: latest(_versions(s, d), "rule", ["version"]),
    "rule_revalidation": _revalidate,
    "names_by_locale": lambda s, d: names_in_order(_line_names(s, d)),
    "unique_node_labels": lambda s, d: unique_labels(nodes(s, d).where("node_type in ('TABLE', 'APPLICATION')")),
    "response_confidence": lambda s, d: response_confidence(nodes(s, d).where("node_type = 'SYSTEM'"), edges(s, d).where("target = 'table:5'")),
    "evidence_cursor_page": lambda s, d: page(edges(s, d).select("edge_id", "edge_type"), "edge_id", "8", 25),
    "duplicate_policy_last_wins": lambda s, d: by_policy(table(s, d, "part").select("p_brand", "p_type", "p_partkey", "p_name"), ["p_brand", "p_type"], "p_partkey", "last-wins"),
    "duplicate_policy_error": lambda s, d: by_policy(table(s, d, "part").select("p_brand", "p_type", "p_partkey", "p_name"), ["p_brand", "p_type"], "p_partkey", "error"),
    "issue_attribution": lambda s, d: issue_owners(table(s, d, "events").select(F.col("event_id").alias("issue_id"), F.concat(F.lit("screen:"), F.col("user_id").cast("string")).alias("node"), F.concat(F.lit("shipments/1996-0"), (F.col("event_id") % 9 + 1).cast("string"), F.lit(".sql")).alias("path")), evidence(s, d).select(F.col("edge_id").alias("node"), F.col("source_path").alias("path"))),
}

_STATUS = "v as (select user_id as rule, event_id as version, ['draft', 'approved', 'needs_review', 'retired', 'approved'][event_id % 5 + 1] as status from events)"
_P = "select source as node, substr(sha256(string_agg(distinct concat_ws('|', edge_type, target, operation), chr(10) order by concat_ws('|', edge_type, target, operation))), 1, 20) as fingerprint from {} group by 1"
_C = "select rule, substr(sha256(string_agg(line, chr(10) order by line)), 1, 20) as f from (select distinct rule, node || '=' || coalesce(fingerprint, 'MISSING') as line from m left join {} using (node)) group by 1"
ORACLES = {
    "rule_transitions_invalid": f"with {_STATUS}, s as (select *, lag(status) over (partition by rule order by version) as before from v) select before, status, rule, version from s where before is not null and before || '>' || status not in ('draft>approved', 'approved>needs_review', 'needs_review>approved', 'draft>retired', 'approved>retired', 'needs_review>retired')",
    "rule_status_now": f"with {_STATUS} select rule, version, status from v qualify row_number() over (partition by rule order by version desc) = 1",
    "rule_revalidation": GRAPH_SQL + f", late as (select * from edges where not (source like 'screen:%7' and target like '%1')), p0 as ({_P.format('edges')}), p1 as ({_P.format('late')}), m as (select item_id as rule, 'screen:' || ((item_id * 3 + k) % 140) as node from benchmark, (values (0), (1), (2)) t(k)), c0 as ({_C.format('p0')}), c1 as ({_C.format('p1')}) select rule, case when rule % 2 = 0 then case when c0.f <> c1.f then 'needs_review' else 'approved' end else 'draft' end as status from c0 join c1 using (rule)",
    "names_by_locale": "with n as (select distinct doc_id % 61 as target, case lang when 'ja' then 0 when 'en' then 1 when 'vi' then 2 else 3 end as k, lang, substr(md5(text), 1, 6) as v from documents where doc_id % 5 <> 0) select target, string_agg(lang || ':' || v, '; ' order by k, lang, v) as names from n group by 1",
    "unique_node_labels": GRAPH_SQL + ", n as (select * from nodes where node_type in ('TABLE', 'APPLICATION')), f as (select stable_id, case when count(*) over (partition by name) > 1 then coalesce(system_key, database_key) || '/' || name else name end as label from n) select stable_id, case when count(*) over (partition by label) > 1 then label || '#' || substr(sha256(stable_id), 1, 8) else label end as label from f",
    "response_confidence": GRAPH_SQL + "select least(1.0, min(confidence))::double as confidence from edges where target = 'table:5'",
    "evidence_cursor_page": GRAPH_SQL + "select edge_id, edge_type from edges where edge_id > '8' order by edge_id limit 26",
    "duplicate_policy_last_wins": "select p_brand, p_type, p_partkey, p_name from part qualify row_number() over (partition by p_brand, p_type order by p_partkey desc) = 1",
    "duplicate_policy_error": "select p_brand, p_type, count(distinct p_name) as n from part group by 1, 2 having count(distinct p_name) > 1",
    "issue_attribution": GRAPH_SQL + ", i as (select event_id as issue_id, 'screen:' || user_id as node, 'shipments/1996-0' || (event_id % 9 + 1) || '.sql' as path from events), o as (select issue_id, node from i union select issue_id, edge_id from i join evidence on path = source_path) select issue_id, count(*) as owners from o group by 1",
}
