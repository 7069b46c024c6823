"""Documents changed as one text give what the part by part way gives, and are not opened."""

import json

import pytest

from tests.test_trees import documents, frame, got, parts_of
from tracelake.operators import trees

SF = "/root/testdata/sf0.001"
ODD = {
    "signs": {"x": ['n1', 'a "n1" \\', "n1\\", '\\"', ",}", '"line":1', {"n1": "n1", "line": 'a,}"', "k": ":"}], "y": "\x01\n\x7f😀"},
    "digits": [6_000_000_001, "6000000001", "--6000000001", 2**63 - 1, -(2**63), 10**30, "123", -6_000_000_001],
    "positions": {"semantic_tree": {"line": "a", "span": {"offset": [1, {"x": 2}]}, "z": {"source": {}}, "y": [{"column": [1, "]"]}, {"end_line": 1, "q": {"span": {"a": "}"}}}]}},
    "falsy": {"semantic_tree": {"line": 7}},
    "none": {"semantic_tree": None},
    "list": [{"semantic_tree": 1}],
    "empty": {},
}


def frames(spark):
    docs = frame(spark, documents(5) | ODD | {f"t{k}": {"semantic_tree": v, "a": 1} for k, v in documents(6).items()})
    more = [("missing", None), ("bad", "{no"), ("fraction", "[6000000001.0, 6000000001, 6e9, 0.5]"), ("spaced", ' { "n1" :\t"n1" , "a": [ ] } ')]
    return docs.unionByName(spark.createDataFrame(more, docs.schema))


@pytest.fixture(params=[100_000, 40])
def short(request, monkeypatch):
    monkeypatch.setattr(trees, "SHORT", request.param)


def test_numbers_are_restored_as_by_parts(spark, short):
    docs = frames(spark)
    names = spark.createDataFrame([(6_000_000_001, 'node:"a\\'), (-6_000_000_001, "node:b"), (7, "never"), (1234567890123, "node:c"), (2**63 - 1, "max"), (None, "null")], "number long, new string")
    assert got(trees.restored_docs(docs, names)) == got(trees.closed(trees.restored(parts_of(docs), names)))


def test_json_ids_are_restored_without_opening(spark, monkeypatch):
    monkeypatch.delattr(trees, "opened")
    assert all(json.loads(r.doc)["owner"].startswith("screen:") for r in trees.QUERIES["json_ids_restored"](spark, SF).collect())


def test_names_are_rewritten_as_by_parts(spark, short):
    docs = frames(spark)
    names = spark.createDataFrame([("n1", 'new "1"\\'), ("x", "y"), ('a "n1" \\', ","), ("n2", None), (None, "z"), ("", "none")], "old string, new string")
    assert got(trees.rewritten_docs(docs, names)) == got(trees.closed(trees.rewritten(parts_of(docs), names)))


def test_json_is_rewritten_without_opening(spark, monkeypatch):
    monkeypatch.delattr(trees, "opened")
    assert not any("view:" in r.doc for r in trees.QUERIES["json_rewritten"](spark, SF).collect())


def test_fingerprints_as_by_parts(spark, short, monkeypatch):
    docs = frames(spark)
    lines = spark.createDataFrame([("signs", 'READS||"a"'), ("positions", "b"), ("positions", "a")], "id string, line string")
    now = {r.id: r.fingerprint for r in trees.tree_fingerprints(docs, lines).collect()}
    monkeypatch.setattr(trees, "SHORT", -1)
    assert now == {r.id: r.fingerprint for r in trees.tree_fingerprints(docs, lines).collect()} and len(now) == docs.count()


def test_trees_are_fingerprinted_without_opening(spark, monkeypatch):
    monkeypatch.delattr(trees, "opened")
    assert trees.QUERIES["tree_fingerprints"](spark, SF).count() > 100
