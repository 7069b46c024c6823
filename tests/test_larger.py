"""Steps that failed, or would have, on larger tables: nothing is read, held or shuffled more often than it has to be, and results stay whole."""

import hashlib

from pyspark.sql import functions as F

from tracelake.contract import long_name, short_key
from tracelake.operators import derive, details, diff, trees
from tracelake.operators.aggregates import access_per_table
from tracelake.operators.ranks import first_of
from tracelake.operators.reports import compared_graphs, detail_counts
from tracelake.operators.traverse import induced

SF = "/root/testdata/sf0.001"
EDGES = "edge_id string, source string, target string, edge_type string, operation string, confidence double"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merged_documents_are_no_broadcast(spark, monkeypatch):  # F8
    plans = []
    written = trees.written
    monkeypatch.setattr(trees, "written", lambda df, **options: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, **options))
    docs = lambda text: spark.createDataFrame([("a", text)], "id string, doc string")
    assert [r.doc for r in trees.merged(docs('{"x":1,"y":{"z":2}}'), docs('{"x":{"w":3},"y":{"v":4}}')).collect()] == ['{"x":1,"y":{"v":4,"z":2}}']
    under = [p for p in plans if "LeftSemi" in p]
    assert under and not any("BroadcastHashJoin [id" in p and "LeftSemi" in p for p in under)


def test_cards_of_screens_ask_for_no_ways(spark, monkeypatch):  # F26
    def no_walk(*_, **__):
        raise AssertionError("cards need no trails")

    monkeypatch.setattr(derive, "walk", no_walk)
    assert derive.QUERIES["entity_cards"](spark, SF).count() > 0


def test_graphs_are_compared_in_one_pass(spark):  # F32 F37 F43
    nodes = lambda *ids: spark.createDataFrame([(i, "TABLE") for i in ids], "stable_id string, node_type string")
    edges = lambda *ends: spark.createDataFrame([(a + b, a, b, "READS", "", 1.0) for a, b in ends], EDGES)
    issues = spark.createDataFrame([], "issue_type string, severity string, source_path string, message string")
    out = compared_graphs((nodes("a", "b", "b"), edges("ab", "bc"), issues), (nodes("a", "c"), edges("ab", "ca", "ca"), issues))
    assert sorted(map(tuple, out.select("section", "change", "key").collect())) == [
        ("edges", "added", "c|READS||a"), ("edges", "removed", "b|READS||c"), ("nodes", "added", "c"), ("nodes", "removed", "b"), ("nodes", "removed", "b"),
    ]
    assert "LeftAnti" not in plan(out)


def test_fingerprints_sum_long_numbers(spark):  # F44
    lines = [("a", f"line {k}") for k in range(50)] + [("a", "line 1"), ("b", "x")]
    out = diff.digest(spark.createDataFrame(lines, "owner string, line string"), "owner")
    got = {r.owner: r.fingerprint for r in out.collect()}
    for owner in "ab":
        of = {line for o, line in lines if o == owner}
        total = sum(int(hashlib.sha256(x.encode()).hexdigest()[:15], 16) for x in of)
        assert got[owner] == hashlib.sha256(f"{len(of)}:{total}".encode()).hexdigest()[:20]
    assert "as decimal(38,0)))" not in plan(out)


def test_edges_of_other_kinds_leave_before_a_shuffle(spark):  # F33
    edges = spark.createDataFrame([("1", "s:1", "s:2", "X", "", 1.0), ("2", "s:1", "t:1", "X", "", 1.0), ("3", "s:1", "s:9", "X", "", 1.0)], EDGES)
    out = induced(edges, spark.createDataFrame([("s:1",), ("s:2",)], "id string"))
    assert [r.edge_id for r in out.collect()] == ["1"]
    assert "substring_index" in plan(out)
    many = spark.range(200).select(F.concat("id", F.lit(":1")).alias("id"))
    assert [r.edge_id for r in induced(edges, many.unionByName(spark.createDataFrame([("s:1",), ("s:2",)], "id string"))).collect()] == ["1"]


def test_readers_and_writers_are_counted_without_copies_of_edges(spark):  # F42
    rows = [("1", "m", "t", "READS", "", 0.5), ("2", "m", "t", "READS", "x", 1.0), ("3", "m", "t", "INSERTS", "", 1.0), ("4", "n", "t", "DELETES", "", 1.0), ("5", None, "t", "READS", "", 0.9), ("6", "n", "u", "CALLS", "", 1.0)]
    out = access_per_table(spark.createDataFrame(rows, EDGES))
    assert [tuple(r) for r in out.select("target", "readers", "writers", "confidence").collect()] == [("t", 1, 2, 0.5)]
    assert "Expand" not in plan(out)


def test_edges_meet_evidence_once(spark):  # F41
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "stable_id string")
    ids = ["0f" * 32, "#" * 32, "e"]
    edges = spark.createDataFrame([(ids[0], "a", "b", "READS", "", 1.0), (ids[1], "b", "a", "DELETES", "", 1.0), (ids[2], "b", "b", "INSERTS", "", 1.0)], EDGES)
    out = detail_counts(nodes, edges, spark.createDataFrame([(ids[0],), (ids[0],), (ids[2],)], "edge_id string"))
    assert sorted(map(tuple, out.collect())) == [("a", 1, 1, 2, 1), ("b", 2, 2, 4, 1), ("c", 0, 0, 0, 0)]
    assert plan(out).count("Join LeftOuter") == 2


def test_short_keys_keep_ids_apart(spark):  # F35 F41
    ids = ["0f" * 32, "0F" * 32, "\x0f" * 32, "0f" * 31, "", "é" * 64, "#" * 33, "0f" * 33]
    rows = spark.createDataFrame([(i,) for i in [*ids, None]], "id string").select("id", short_key(F.col("id")).alias("key")).select("id", "key", long_name(F.col("key")).alias("back")).collect()
    assert all(r.id == r.back for r in rows)
    assert len({bytes(r.key) for r in rows if r.key is not None}) == len(ids)


def test_edges_carry_their_ends_lists_last(spark):  # F35
    nodes = spark.createDataFrame([("a", "METHOD", "A"), ("t", "TABLE", "T")], "stable_id string, node_type string, name string")
    edges = spark.createDataFrame([("e", "a", "t", "READS", "", 1.0)], EDGES)
    issues = spark.createDataFrame([("i", "a", "ERROR", "X"), ("j", "t", "INFO", "X")], "issue_id string, source_node string, severity string, issue_type string")
    out = details.edge_details(nodes, edges, spark.createDataFrame([("p", "e"), ("q", "e")], "evidence_id string, item string"), issues)
    assert [tuple(r) for r in out.collect()] == [("e", "READS", "a", "METHOD", "A", "t", "TABLE", "T", 2, 2, ["i", "j"])]
    assert "unhex" in plan(out)


def test_items_of_bundles_are_read_once(spark):  # F10
    items = spark.range(700).select(F.lit("a").alias("owner"), F.when(F.col("id") < 690, "issues").otherwise("evidence").alias("section"), F.array(F.format_string("%03d", 700 - F.col("id"))).alias("order"), F.format_string("x%03d", "id").alias("item"))
    out = details.bundled(items, {"issues": 5, "evidence": 100})
    row = out.first()
    assert row.counts == {"issues": 690, "evidence": 10}
    assert row.lists == {"issues": [f"x{k}" for k in range(689, 684, -1)], "evidence": [f"x{k}" for k in range(699, 689, -1)]}
    assert plan(out).count("Range") == 1


def test_equal_rows_are_cut_with_their_cells(spark):  # F27
    rows = spark.createDataFrame([("s", f"p{k % 30:02d}") for k in range(300)], "start string, evidence_id string")
    out = first_of(rows, ["start"], "evidence_id", ["evidence_id"], 20, "k", distinct=True)
    assert sorted((r.evidence_id, r.k) for r in out.collect()) == [(f"p{k:02d}", k + 1) for k in range(20)]
    reached, along = spark.createDataFrame([("s", "n")], "start string, node string"), spark.createDataFrame([("s", "e"), ("s", "e")], "start string, edge_id string")
    proofs = spark.createDataFrame([("p1", "e"), ("p0", "e"), ("p0", "n"), ("p1", "e")], "evidence_id string, item string")
    out = details.trace_evidence(reached, along, proofs, 2)
    assert sorted(map(tuple, out.select("start", "kind", "evidence_id", "k").collect())) == [("s", "EDGE", "p0", 2), ("s", "NODE", "p0", 1)]


def test_trees_are_made_from_one_reading_of_the_documents(spark):  # F31
    docs = spark.range(2).select(F.concat(F.lit("d"), "id").alias("id"), F.lit('{"semantic_tree":{"a":[1]}}').alias("doc"))
    out = trees.tree_fingerprints(docs, spark.createDataFrame([("d0", "x")], "id string, line string"))
    assert {r.id for r in out.collect()} == {"d0", "d1"}
    assert "Range" not in plan(out)
