"""Column functions over texts and names, and operators without SQL, against plain versions."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracelake.functions import names, text
from tracelake.operators import merge, paths, search


def values(spark, column, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, v string")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


TEXTS = ["Hủy đơn hàng", "cancelOrderHTTPServer", "ORDER_HEADER", "Straße ﬁn Ｆｕｌｌ", "注文キャンセル", "a注文b", "注", "the OrderIDs of x", "한국어", "İstanbul café", "", None, "snake_case2Camel3"]


def plain_fold(t):
    t = unicodedata.normalize("NFKD", (t or "").replace("đ", "d").replace("Đ", "D"))
    return "".join(c for c in t if not unicodedata.category(c).startswith("M")).lower()


def plain_tokens(t):
    out = []
    apart = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", t or "")
    for word in re.split(r"[\W_]+", plain_fold(apart)):
        for run in re.findall(f"[{text.UNSPACED}]+|[^{text.UNSPACED}]+", word):
            if re.match(f"[{text.UNSPACED}]", run):
                out += [run] if len(run) == 1 else [run[k : k + 2] for k in range(len(run) - 1)]
            elif len(run) >= 2 and run not in text.STOPWORDS:
                out.append(run)
    return out


def test_folding_and_tokens(spark):
    assert values(spark, text.fold, TEXTS) == [plain_fold(t) for t in TEXTS]
    assert values(spark, text.tokens, TEXTS) == [plain_tokens(t) for t in TEXTS]
    assert values(spark, text.compact, TEXTS) == ["".join(c for c in plain_fold(t) if c.isalnum()) for t in TEXTS]
    assert values(spark, text.tokens, ["Hủy đơn", "注文書"]) == [["huy", "don"], ["注文", "文書"]]


def test_names_without_a_canonical_form_are_null(spark):
    assert values(spark, names.path, ["./a\\b//c", "/abs", "C:\\x", "a/../b", "", "."]) == ["a/b/c", None, None, None, None, None]
    assert values(spark, names.sql_name, ['"Own er".tab ', "a.b.c", '"a""b".x', 'a.""', "a..b", '"open', 'x"y']) == ["Own er.TAB", "A.B.C", 'a"b.X', "A.", None, None, None]
    assert values(spark, names.leaf, ["s.t@db", "t", '"a.b"']) == ["T", "T", "a.b"]
    assert values(spark, names.route, ["http://h:1/A//b/", "x/{Id}?q", "/:name/<int:k>", "/", ""]) == ["/A/b", "/x/{id}", "/{id}/{id}", "/", None]
    assert values(spark, lambda v: names.route_key(F.lit(" get"), v), ["/A/{x}"]) == ["GET /a/{id}"]
    assert values(spark, lambda v: names.route_key(F.lit("g3t"), v), ["/A"]) == [None]
    assert values(spark, names.slug, ["a/My File (1).sql", "--", "É x"]) == ["my-file-1-.sql", "source", "é-x"]
    assert values(spark, names.executable, ["C:\\b\\Order-Fulfil_x.EXE", "order fulfil.x"]) == ["orderfulfilx", "orderfulfilx"]
    assert values(spark, lambda v: names.shortened(v, 5), ["ab  cd", "abc", "abcdefg"]) == ["ab cd", "abc", "abcd…"]


def test_query_terms(spark):
    df = spark.createDataFrame([(1, "Cancel orders, ORDER_HEADER?"), (2, ""), (3, " ".join(f"word{k}" for k in range(200)))], "id int, text string")
    got = {r.id: r.terms for r in search.expanded(df).collect()}
    assert got[1] == ["cancel", "orders", "order", "header", "orderheader", "cancelorders", "ordersorderheader", "cancelordersorderheader"]
    assert got[2] == [] and len(got[3]) == search.MOST_QUERY_TERMS


def test_concepts_give_way_to_wider_ones(spark):
    entries = [(1, "order", "đơn hàng", [], "approved"), (2, "cancel", "hủy đơn hàng", ["cancelOrder"], "approved"), (3, "ship", "giao hàng", ["shipOrder"], "approved"), (4, "old", "hủy đơn", [], "deprecated")]
    df = spark.createDataFrame(entries, "concept int, semantic string, label string, aliases array<string>, status string")
    asked = search.expanded(spark.createDataFrame([(1, "hủy đơn hàng"), (2, "cancelOrder now"), (3, "nothing")], "id int, text string")).select("id", F.explode("terms").alias("term"))
    got = {(r.id, r.semantic): r.score for r in search.concepts(df, asked).collect()}
    assert got == {(1, "cancel"): 6.0, (2, "cancel"): 3.0}


def test_paths_that_fit_are_taken_in_order(spark):
    edges = spark.createDataFrame([(f"e{k}", f"n{k}", f"n{k + 1}") for k in range(12)], "edge_id string, source string, target string")
    ways = [["e0"], ["e0", "e1"], ["e4", "e5", "e6"], ["e0", "e1", "e2"]]
    rows = [("n0", len(w), w) for w in ways]
    got = paths.within(spark.createDataFrame(rows, "start string, steps int, way array<string>"), edges, 4).collect()
    assert sorted(tuple(r.way) for r in got) == [("e0",), ("e0", "e1"), ("e0", "e1", "e2")]


@pytest.mark.parametrize("most", [3, 6, 50])
def test_traces_stop_at_their_bounds(spark, most):
    rng = random.Random(1)
    names_ = [f"n{k}" for k in range(30)]
    links = sorted({(a, rng.choice(names_)) for a in names_ for _ in range(3)})
    edges = spark.createDataFrame([(f"e{k}", a, b, "CALLS", 1.0) for k, (a, b) in enumerate(links)], "edge_id string, source string, target string, edge_type string, confidence double")
    nodes = spark.createDataFrame([(n, "METHOD") for n in names_], "stable_id string, node_type string")
    got = paths.bounded_trace(spark.createDataFrame([("n0",)], "start string"), edges, nodes, F.lit(False), 8, most, 10_000).first()
    seen, front = {"n0"}, ["n0"]
    for _ in range(8):
        front = sorted({b for a, b in links if a in front} - seen)
        seen |= set(front)
    assert got.nodes == min(most, len(seen)) and got.truncated == (len(seen) - 1 >= most)
    if most > len(seen):
        assert got.edges == sum(a in seen and b in seen for a, b in links)


def test_compact_ids_have_no_collisions(spark):
    keys = spark.createDataFrame([(f"n{k}",) for k in range(200)], "stable_id string")
    got = {r.stable_id: r.id for r in merge.compact_ids(keys, 9).collect()}
    assert len(got) == 200 and len(set(got.values())) == 200 and all(0 <= v < 512 for v in got.values())
    assert {r.stable_id: r.id for r in merge.compact_ids(keys.orderBy(F.rand(1)), 9).collect()} == got
    edges = spark.createDataFrame([("e", "n1", "n2")], "edge_id string, source string, target string")
    row = merge.with_compact_ends(edges, merge.compact_ids(keys)).first()
    assert (row.source, row.target) == tuple({r.stable_id: r.id for r in merge.compact_ids(keys).collect()}[k] for k in ("n1", "n2"))
