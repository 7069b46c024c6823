"""Readers, writers and the stream over events."""

import pytest
from pyspark.sql import functions as F

from tracelake.operators.listing import normalised_route, route_fits
from tracelake.operators.traverse import adjacency, flows, walk
from tracelake.plans.projection import edges, evidence, nodes
from tracelake.sources import readers, sinks
from tracelake.streaming import usage

SF = "/root/testdata/sf0.001"


def test_files_are_pruned_sized_and_decoded(spark, tmp_path):
    (tmp_path / "src/obj").mkdir(parents=True)
    (tmp_path / "src/a.sql").write_bytes("select 'é' -- c\r\n".encode())
    (tmp_path / "src/b.SQL").write_bytes("日本語テスト".encode("cp932"))
    (tmp_path / "src/c.sql").write_bytes("x".encode("utf-16"))
    (tmp_path / "src/big.sql").write_bytes(b"x" * 200)
    (tmp_path / "src/obj/d.sql").write_bytes(b"no")
    (tmp_path / "src/e.txt").write_bytes(b"no")
    found = readers.files(spark, str(tmp_path), (".sql",), limit=100).select("*", readers.decode("content").alias("d")).select("path", "too_large", "d.*")
    got = {r.path.rsplit("/", 1)[1]: (r.too_large, r.text, r.encoding) for r in found.collect()}
    assert got == {"a.sql": (False, "select 'é' -- c\r\n", "utf-8"), "b.SQL": (False, "日本語テスト", "cp932"), "c.sql": (False, "x", "utf-16"), "big.sql": (True, None, None)}


def test_newlines_and_comments(spark):
    df = spark.createDataFrame([(1, "a\r\nb"), (2, "a\nb"), (3, "a\rb"), (4, "a\nb\r\n"), (5, "")], "k int, t string")
    assert [r.s for r in df.orderBy("k").select(readers.newline_style(F.col("t")).alias("s")).collect()] == ["CRLF", "LF", "CR", "mixed", "none"]
    sql = spark.createDataFrame([(1, "select '-- no' -- yes\n/* b */ x")], "k int, t string")
    assert [(r.kind, r.comment) for r in readers.comments(sql, "k", "t", "sql").collect()] == [("LINE", "-- yes"), ("BLOCK", "/* b */")]


def test_packages_are_read_as_they_were_written(spark, tmp_path):
    e = edges(spark, SF).where("edge_type = 'READS'")
    info = sinks.write_package(e, str(tmp_path), "edges", "edge_id").first()
    back = readers.package(spark, str(tmp_path), "edges")
    assert info.rows == back.count() and back.exceptAll(e).isEmpty()
    sinks.write_serving(e, str(tmp_path / "serving"), "edge_type")
    assert spark.read.parquet(str(tmp_path / "serving")).count() == info.rows
    sinks.write_cards(e.select("source", "target"), str(tmp_path / "cards"))
    cards = spark.read.json(str(tmp_path / "cards"))
    assert cards.count() == info.rows
    assert sinks.integrity(evidence(spark, SF), edges(spark, SF)).isEmpty()
    assert sinks.snapshot(nodes(spark, SF), e).count() == nodes(spark, SF).count() + e.count()


def test_stream_and_table_agree(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = usage.stream(spark, str(tmp_path / "events"), events.schema)
    query = stream.writeStream.format("memory").queryName("usage_stream").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("usage_stream").collect()) == sorted(usage.by_window(events).collect())


ROUTES = [("get https://h.example/a//b/?x=1#y", "GET /a/b"), ("/users/{userId}/", "/users/{id}"), ("POST items/42/:name", "POST /items/{id}/{id}"), ("/", "/")]


@pytest.mark.parametrize("raw,want", ROUTES)
def test_routes(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(normalised_route(F.col("r"))).first()[0] == want


def test_route_templates(spark):
    rows = [("/a/{x}/c", "/a/b/c", True), ("/a/{x}", "/a/b/c", False), ("/a/b", "/a/c", False)]
    got = spark.createDataFrame(rows, "t string, r string, want boolean").select("want", route_fits(F.col("t"), F.col("r")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def graph(spark, links, types):
    e = spark.createDataFrame([(f"e{k}", a, b, t, 1.0 - k / 100) for k, (a, t, b) in enumerate(links)], "edge_id string, source string, target string, edge_type string, confidence double")
    return e, spark.createDataFrame(list(types.items()), "stable_id string, node_type string")


def test_walks_end_on_cycles_and_on_targets(spark):
    types = {"s": "SCREEN", "a": "METHOD", "b": "METHOD", "t": "TABLE", "u": "TABLE"}
    e, n = graph(spark, [("s", "CALLS", "a"), ("a", "CALLS", "b"), ("b", "CALLS", "a"), ("b", "READS", "t"), ("t", "CALLS", "u")], types)
    start = spark.createDataFrame([("s",)], "start string")
    found = {r.node: r.depth for r in walk(start, adjacency(e, n), F.col("to_type") == "TABLE", 8).collect()}
    assert found == {"a": 1, "b": 2, "t": 3}
    flow = flows(start, e, n).first()
    assert (flow.target, flow.path, round(flow.confidence, 2)) == ("t", ["s", "a", "b", "t"], 0.97)


def test_layers_give_one_way_to_each_node(spark):
    links, types = [], {"s": "SCREEN"}
    for k in range(6):
        for j in range(3):
            types[f"n{k}{j}"] = "METHOD"
            links += [("s", "CALLS", f"n0{j}")] if k == 0 else [(f"n{k - 1}{i}", "CALLS", f"n{k}{j}") for i in range(3)]
    e, n = graph(spark, links, types)
    rows = walk(spark.createDataFrame([("s",)], "start string"), adjacency(e, n), F.lit(False), 20).collect()
    assert len(rows) == 18 and all(r.depth == len(r.path) - 1 for r in rows)
