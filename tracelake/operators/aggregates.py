"""Counts, quality figures and bounded reports over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.contract import WRITE_EDGES, table
from tracelake.operators.ranks import first_of
from tracelake.plans.projection import GRAPH_SQL, edges, evidence, issues, nodes


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def access_per_table(edges_: DataFrame) -> DataFrame:
    """Readers and writers of each table that any edge touches."""
    wrote, read = F.col("edge_type").isin(*WRITE_EDGES), F.col("edge_type") == "READS"
    # Sources are made distinct first: two distinct counts in one aggregate would hold every edge three times.
    data = edges_.where(wrote | read).groupBy("target", "source", read.alias("read")).agg(F.min("confidence").alias("confidence"))
    of = lambda side: F.count_if(side & F.col("source").isNotNull())
    return data.groupBy("target").agg(of(F.col("read")).alias("readers"), of(~F.col("read")).alias("writers"), F.min("confidence").alias("confidence"))


def quality(nodes_: DataFrame, edges_: DataFrame, issues_: DataFrame) -> DataFrame:
    """Global figures as rows metric, value; one pass over each table."""
    per = [
        nodes_.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node_type") == "TABLE").alias("tables"), F.count_if(F.col("system_key").isNull()).alias("nodes_without_system")),
        edges_.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("confidence") < 0.9).alias("low_confidence_edges")),
        issues_.agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count(F.lit(1)).alias("issues")),
    ]
    rows = None
    for df in per:
        one = df.unpivot([], df.columns, "metric", "value")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def bounded(issues_: DataFrame, most: int) -> DataFrame:
    """The first most - 1 issues of each path and type, and a row that counts the rest.

    What is cut is only counted.
    """
    keys = ["source_path", "issue_type"]
    rows = issues_.select(*keys, "issue_id")
    kept = first_of(rows, keys, "issue_id", ["issue_id"], most - 1).select(*keys, "issue_id", F.lit(0).cast("long").alias("omitted"))
    rest = rows.groupBy(*keys).agg((F.count(F.lit(1)) - (most - 1)).alias("omitted")).where("omitted > 0").select(*keys, F.lit(None).cast("long").alias("issue_id"), "omitted")
    return kept.unionByName(rest)


def wilson(correct: Column, judged: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of correct out of judged; null where nothing was judged."""
    p, n = correct / judged, judged.cast("double")
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (middle - spread) / (1 + z * z / n), (middle + spread) / (1 + z * z / n)
    return F.when(judged > 0, F.round(low, 6)), F.when(judged > 0, F.round(high, 6))


def sample_scores(verdicts: DataFrame) -> DataFrame:
    """verdicts: edge_type, verdict (correct, wrong, unsure). Precision and its interval by type."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    g = verdicts.groupBy("edge_type").agg(of("correct").alias("correct"), of("wrong").alias("wrong"), of("unsure").alias("unsure"))
    judged = F.col("correct") + F.col("wrong")
    low, high = wilson(F.col("correct"), judged)
    return g.select("edge_type", "correct", "wrong", "unsure", F.when(judged > 0, F.round(F.col("correct") / judged, 6)).alias("precision"), low.alias("low"), high.alias("high"))


def recall(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """truth, found: kind and keys. Counts and ratios by kind; a ratio of nothing is null."""
    t = truth.select("kind", *keys).distinct().withColumn("t", F.lit(1))
    f = found.select("kind", *keys).distinct().withColumn("f", F.lit(1))
    both = t.join(f, ["kind", *keys], "full")
    g = both.groupBy("kind").agg(F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("hits"), F.count("t").alias("truth"), F.count("f").alias("found"))
    share = lambda of: F.when(F.col(of) > 0, F.round(F.col("hits") / F.col(of), 3))
    return g.select("kind", "hits", "truth", "found", share("truth").alias("recall"), share("found").alias("precision"))


def _verdicts(s, d):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("READS", "INSERTS", "UPDATES", "DELETES")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(s, d, "labels").select(kinds.alias("edge_type"), F.when(F.col("toxic") == 1, "unsure").when(F.col("quality") == 1, "correct").otherwise("wrong").alias("verdict"))


def _usage(s, d):
    c = table(s, d, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.length("text") < 100).alias("short"), F.count_distinct("conv_id").alias("users"))


def _found_pairs(s, d):
    e = edges(s, d).where(F.col("edge_type").isin("READS", "INSERTS", "UPDATES", "DELETES")).select(F.col("edge_type").alias("kind"), "source", "target", "confidence")
    return e.where(F.length("source") % 3 != 0), e.where("confidence = 1.0")


QUERIES = {
    "node_type_histogram": lambda s, d: histogram(nodes(s, d), "node_type"),
    "edge_type_histogram": lambda s, d: histogram(edges(s, d), "edge_type"),
    "graph_statistics": lambda s, d: quality(nodes(s, d), edges(s, d), issues(s, d)),
    "readers_writers_per_table": lambda s, d: access_per_table(edges(s, d)),
    "declaration_location": lambda s, d: evidence(s, d).groupBy("edge_id").agg(F.min(F.struct("start_line", "source_path")).alias("m")).select("edge_id", F.col("m.start_line").alias("start_line"), F.col("m.source_path").alias("source_path")),
    "issues_by_type_severity": lambda s, d: histogram(issues(s, d), "issue_type", "severity"),
    "quality_metrics_by_package": lambda s, d: nodes(s, d).groupBy(F.coalesce("system_key", F.lit("global")).alias("package")).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("node_type").alias("n_types")),
    "issue_bounding": lambda s, d: bounded(issues(s, d), 5),
    "usage_by_tool": _usage,
    "unanswered_topk": lambda s, d: table(s, d, "events").where("event_type = 'error'").groupBy("user_id", "props").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event")).orderBy(F.desc("n"), F.desc("last_event")).limit(30),
    "sample_wilson": lambda s, d: sample_scores(_verdicts(s, d)),
    "verify_precision_recall": lambda s, d: recall(*_found_pairs(s, d), ["source", "target"]),
    "issue_texts_masked": lambda s, d: issues(s, d).select("issue_type", F.regexp_replace("message", r"\d+", "#").alias("message")).groupBy("issue_type", "message").agg(F.count(F.lit(1)).alias("n")),
    "catalog_metrics": lambda s, d: table(s, d, "part").groupBy(F.col("p_brand").alias("database_key")).agg(F.count(F.lit(1)).alias("tables"), F.count_distinct("p_type").alias("schemas"), F.sum("p_size").alias("columns")),
}

_Z = 1.96
ORACLES = {
    "node_type_histogram": GRAPH_SQL + "select node_type, count(*) as n from nodes group by 1",
    "edge_type_histogram": GRAPH_SQL + "select edge_type, count(*) as n from edges group by 1",
    "graph_statistics": GRAPH_SQL + """select * from (select unnest(['nodes', 'tables', 'nodes_without_system']) as metric, unnest([count(*), count(*) filter (node_type = 'TABLE'), count(*) filter (system_key is null)]) as value from nodes
      union all select unnest(['edges', 'low_confidence_edges']), unnest([count(*), count(*) filter (confidence < 0.9)]) from edges
      union all select unnest(['errors', 'issues']), unnest([count(*) filter (severity = 'ERROR'), count(*)]) from issues)""",
    "readers_writers_per_table": GRAPH_SQL + "select target, count(distinct source) filter (edge_type = 'READS') as readers, count(distinct source) filter (edge_type <> 'READS') as writers, min(confidence) as confidence from edges where target like 'table:%' group by 1",
    "declaration_location": GRAPH_SQL + "select edge_id, min(start_line) as start_line, min_by(source_path, start_line::varchar || source_path) as source_path from (select edge_id, start_line, source_path from evidence) group by 1",
    "issues_by_type_severity": GRAPH_SQL + "select issue_type, severity, count(*) as n from issues group by all",
    "quality_metrics_by_package": GRAPH_SQL + "select coalesce(system_key, 'global') as package, count(*) as n_nodes, count(distinct node_type) as n_types from nodes group by 1",
    "issue_bounding": GRAPH_SQL + "select source_path, issue_type, issue_id, 0::bigint as omitted from issues qualify row_number() over (partition by source_path, issue_type order by issue_id) < 5 union all select source_path, issue_type, null, count(*) - 4 from issues group by 1, 2 having count(*) > 4",
    "usage_by_tool": "select role, count(*) as calls, count(*) filter (length(text) < 100) as short, count(distinct conv_id) as users from conversations group by 1",
    "unanswered_topk": "select user_id, props, count(*) as n, max(event_id) as last_event from events where event_type = 'error' group by 1, 2 order by n desc, last_event desc limit 30",
    "sample_wilson": f"""with g as (select ['READS', 'INSERTS', 'UPDATES', 'DELETES'][doc_id % 4 + 1] as edge_type, count(*) filter (toxic = 0 and quality = 1) as correct, count(*) filter (toxic = 0 and quality = 0) as wrong, count(*) filter (toxic = 1) as unsure from labels group by 1),
      h as (select *, correct / (correct + wrong) as p, (correct + wrong)::double as n from g)
      select edge_type, correct, wrong, unsure, round(p, 6) as precision, round((p + {_Z * _Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n), 6) as low,
      round((p + {_Z * _Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n), 6) as high from h""",
    "verify_precision_recall": GRAPH_SQL + """, pairs as (select edge_type as kind, source, target, bool_or(length(source) % 3 <> 0) as t, bool_or(confidence = 1.0) as f from edges where target like 'table:%' group by all)
      select kind, count(*) filter (t and f) as hits, count(*) filter (t) as truth, count(*) filter (f) as found, round(count(*) filter (t and f) / count(*) filter (t), 3) as recall, round(count(*) filter (t and f) / count(*) filter (f), 3) as precision from pairs group by 1""",
    "issue_texts_masked": GRAPH_SQL + r"select issue_type, regexp_replace(message, '\d+', '#', 'g') as message, count(*) as n from issues group by all",
    "catalog_metrics": "select p_brand as database_key, count(*) as tables, count(distinct p_type) as schemas, sum(p_size)::bigint as columns from part group by 1",
}
