"""What grows with the tables stays small: edges lie still while walks go on, and nothing is left out of large results."""

from pyspark.sql import functions as F

from tracelake.operators import budget, business, frontier, trees
from tracelake.operators.catalogue import alias_links, file_seeds, shown_in
from tracelake.operators.joins import maybe, span_owner
from tracelake.operators.paths import bounded_trace, data_paths, steps_to_data, users_of_data, within
from tracelake.operators.traverse import adjacency, flow_targets, flows, reach, walk
from tracelake.sources.scratch import dealt, freed


def star(spark, n):
    """s calls a, which reads n tables."""
    edges = spark.range(n).select(F.concat(F.lit("e"), "id").alias("edge_id"), F.lit("a").alias("source"), F.format_string("t%03d", "id").alias("target"), F.lit("READS").alias("edge_type"), F.lit(1.0).alias("confidence"))
    first = spark.createDataFrame([("c", "s", "a", "CALLS", 1.0)], edges.schema)
    nodes = edges.select(F.col("target").alias("stable_id"), F.lit("TABLE").alias("node_type")).unionByName(spark.createDataFrame([("s", "SCREEN"), ("a", "METHOD")], "stable_id string, node_type string"))
    return spark.createDataFrame([("s",)], "start string"), edges.unionByName(first), nodes


def test_flows_are_whole(spark):
    start, edges, nodes = star(spark, 130)
    assert flows(start, edges, nodes).count() == flow_targets(start, edges, nodes).count() == 130
    assert {r.target for r in flows(start, edges, nodes, most=2).collect()} == {"t000", "t001"}


def test_dealt_edges_are_not_shuffled_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moves = dealt(spark.range(100).select(F.col("id").cast("string").alias("at"), (F.col("id") + 1).cast("string").alias("to")), "at")
        plan = spark.range(3).select(F.col("id").cast("string").alias("at")).join(moves, "at")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    freed(moves)
    assert not spark.catalog.tableExists(moves._named)


def test_reach_is_the_walk_without_ways(spark):
    start, edges, nodes = star(spark, 9)
    moves = adjacency(edges, nodes)
    stop = F.col("to_type") == "TABLE"
    near = lambda df: sorted(df.select("start", "node", "depth", "stopped").collect())
    assert near(reach(start, moves, stop, 8)) == near(walk(start, moves, stop, 8))


def test_traces_are_cut_at_their_bound_only(spark):
    start, edges, nodes = star(spark, 9)
    traced = lambda most: tuple(bounded_trace(start, edges, nodes, F.col("to_type") == "TABLE", most_nodes=most).first())
    assert traced(12) == traced(11) == ("s", 11, 10, False)
    assert traced(10) == ("s", 10, 9, True)


def most_rows(df):
    """The rows that leave the widest join of the executed plan."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        plan += [node.children().apply(k) for k in range(node.children().size())]
        plan += [node.plan()] if hasattr(node, "plan") and "QueryStage" in node.nodeName() else []
    return most


def test_a_common_alias_meets_only_the_nodes_that_are_kept(spark):
    concepts = spark.range(40).select(F.col("id").alias("concept"), F.lit("A b").alias("alias"))
    names = spark.range(300).select(F.format_string("t%03d", "id").alias("node"), F.lit("a B").alias("name"))
    out = alias_links(concepts, names, cap=3)
    assert {(r.concept, r.node) for r in out.collect()} == {(c, f"t00{k}") for c in range(40) for k in range(3)}
    assert most_rows(out) == 120


def test_lines_meet_spans_once_however_many_comments_they_have(spark):
    comments = spark.range(500).select(F.col("id").alias("comment_id"), F.lit("f").alias("path"), (F.col("id") % 2).cast("int").alias("line"))
    spans = spark.range(90).select(F.format_string("d%02d", 99 - F.col("id")).alias("owner_id"), F.lit("f").alias("path"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    out = span_owner(comments, spans)
    assert {(r.owner_id, r.tier) for r in out.collect()} == {("d10", 0), ("file:f", 2)}
    assert most_rows(out) <= 500


def test_paths_that_fit_are_not_gone_through(spark):
    start, edges, nodes = star(spark, 9)
    paths = data_paths(start, edges, nodes)
    assert within(paths, edges, 100).count() == 9
    assert within(paths, edges, 5).count() == 3


def test_steps_to_data_are_those_of_the_routes(spark):
    _, edges, nodes = star(spark, 9)
    tables = nodes.where("node_type = 'TABLE'").select(F.col("stable_id").alias("start"))
    rows = lambda df: sorted(df.select("start", "node", "steps").collect())
    assert rows(steps_to_data(tables, edges, nodes)) == rows(users_of_data(tables, edges, nodes))


def test_hubs_are_ranked_as_others(spark, monkeypatch):
    _, edges, _ = star(spark, 130)
    ranked = [F.desc("priority"), F.asc("side"), F.asc("edge_id")]
    rows = lambda: sorted(budget.offered(edges, "both", 5, ranked).collect())
    whole = rows()
    monkeypatch.setattr(budget, "MANY", 100)
    assert rows() == whole and len(whole) == 5 + 130 + 1


def test_ways_to_no_data_are_left_out_before_the_walk(spark, monkeypatch):
    _, edges, nodes = star(spark, 9)
    dead = spark.createDataFrame([(f"d{k}", "s" if k == 0 else f"x{k - 1}", f"x{k}", "CALLS", 1.0) for k in range(3)], edges.schema)
    edges = edges.unionByName(dead).withColumn("layer", F.lit("TECHNICAL"))
    nodes = nodes.unionByName(dead.select(F.col("target").alias("stable_id"), F.lit("METHOD").alias("node_type")))
    walked, taken = frontier.walked, []
    monkeypatch.setattr(frontier, "walked", lambda starts, moves, *rest: taken.append((starts.count(), moves.count())) or walked(starts, moves, *rest))
    rows = frontier.data_between(nodes.select(F.col("stable_id").alias("start")), edges, nodes).collect()
    # s and a lead out, nine tables in; nothing walks out of x0, x1 and x2, or into them
    assert taken == [(11, 10 + 19 + 3)] and len(rows) == 10 + 9 + 9 * 2
    assert not {r.edge_id for r in rows} & {"d0", "d1", "d2"}


def test_a_file_meets_only_the_edges_it_may_show(spark):
    edges = spark.range(3000).select(F.format_string("e%04d", "id").alias("edge_id"), F.format_string("n%04d", F.col("id") % 1500).alias("source"))
    nodes = edges.select(F.col("source").alias("stable_id"), F.lit("METHOD").alias("node_type"))
    evidence = edges.select("edge_id", F.when(F.col("edge_id") < "e0005", "a/b/c.sql").otherwise("d.sql").alias("source_path"), F.lit(2).alias("start_line"))
    for path, there in (("./a/b/c.sql", 5), ("x/a/b/c.sql", 5), ("c/d.sql", 0)):
        located = shown_in(evidence, edges, nodes, path)
        assert {r.node: r.score for r in file_seeds(located, path, 2).collect()} == {f"n000{k}": 10.0 for k in range(there)}
    few = maybe(edges, edges.where("edge_id < 'e0005'"), "edge_id")
    assert 5 <= few.count() < 30 and few.where("edge_id < 'e0005'").count() == 5


def test_only_steps_to_operations_are_walked(spark, monkeypatch):
    nodes = spark.createDataFrame([("s", "SCREEN"), ("o", "API_OPERATION"), ("q", "API_OPERATION"), ("g", "API_OPERATION"), ("p", "PROCEDURE"), ("t", "TABLE")], "stable_id string, node_type string")
    edges = spark.createDataFrame([("s", "o", "CALLS_API"), ("o", "p", "HANDLED_BY"), ("p", "p", "CALLS"), ("p", "t", "READS"), ("s", "t", "CONTAINS")], "source string, target string, edge_type string").withColumn("edge_id", F.concat("source", "target"))
    walk, taken = business.tree, []
    monkeypatch.setattr(business, "tree", lambda starts, moves, *rest: taken.append(moves.count()) or walk(starts, moves, *rest))
    features = spark.createDataFrame([("feature:s", "s", "SCREEN", "menu:home")], "feature string, entry string, node_type string, menu string")
    extra = spark.createDataFrame([("feature:s", "g"), ("feature:s", "nowhere"), ("feature:none", "q")], "feature string, entry string")
    lost = business.unassigned(features, nodes, edges, business.given(features, nodes, extra))
    assert [r.stable_id for r in lost.collect()] == ["q"] and taken == [1]


def test_references_of_whole_documents(spark, monkeypatch):
    docs = [r'{"a":[1,{"ref_node_id":"n1"}],"ref_node_ids":["n2",["no"],{"ref_node_id":"n3"},5,""]}', r'{"deep":[[{"r\u0065f_node_id":"n4"}]],"x":"\"ref_node_id\":\"no\""}', '["ref_node_id"]', '"ref_node_id"', "{", None, '{"ref_node_id":{"ref_node_ids":[]},"b":"n"}', '{"ref_node_ids":{"k":"no"}}', '{"ref_node_ids":[[["no"]],"n2","n2"]}']
    docs = spark.createDataFrame(list(enumerate(docs)), "id long, doc string")
    got = sorted(map(tuple, trees.references_of(docs).collect()))
    assert got == sorted(map(tuple, trees.references(trees.opened(docs)).collect())) == [(0, "n1"), (0, "n2"), (0, "n3"), (1, "n4"), (8, "n2")]
    # what holds no key isn't opened
    written, rows = trees.written, []
    monkeypatch.setattr(trees, "written", lambda df, **o: rows.append(df.count()) or written(df, **o))
    deep = spark.createDataFrame([(0, '{"ref_node_id":"n","steps":[[[{"a":[1,2,3]}]]]}')], "id long, doc string")
    assert [tuple(r) for r in trees.references_of(deep).collect()] == [(0, "n")] and rows == [1]
