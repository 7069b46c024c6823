"""JSON documents opened and closed by parts, against json.loads and plain recursion."""

import hashlib
import json
import random

from tracelake.operators import trees

KEYS = ["a", "b", "line", "span", "ref_node_id", "ref_node_ids", "é\"x", "source"]
LEAVES = ["", "x", "n1", "n2", "-6000000001", "1234567890123", 7, 6_000_000_001, -6_000_000_001, 2.5, True, None, [], {}]


def value(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice(LEAVES)
    if kind < 0.6:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(KEYS): value(rng, depth - 1) for _ in range(rng.randrange(5))}


def dumped(x):
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def documents(seed, n=60):
    rng = random.Random(seed)
    return {f"d{k}": value(rng, 5) for k in range(n)}


def changed(x, leaf):
    if isinstance(x, dict):
        return {k: changed(v, leaf) for k, v in x.items()}
    return [changed(v, leaf) for v in x] if isinstance(x, list) else leaf(x)


def frame(spark, docs):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "id string, doc string")


def got(df):
    return {r.id: r.doc for r in df.collect()}


def parts_of(df):
    parts = trees.opened(df)
    return trees.texts(parts).join(parts.select("id", "path", "value"), ["id", "path"])


def test_opened_and_closed_again(spark):
    docs = documents(1)
    assert got(trees.closed(trees.texts(trees.opened(frame(spark, docs))))) == {k: dumped(v) for k, v in docs.items()}
    odd = spark.createDataFrame([("none", None), ("bad", "{no json"), ("deep", "[" * 40 + "]" * 40)], "id string, doc string")
    assert got(trees.closed(trees.texts(trees.opened(odd)))) == {"none": "null", "bad": "null", "deep": "[" * 40 + "]" * 40}
    assert got(trees.closed(trees.texts(trees.opened(odd.where("false"))))) == {}


def test_names_and_numbers_in_trees(spark):
    docs = documents(2)
    parts = parts_of(frame(spark, docs))
    names = spark.createDataFrame([("n1", 'new "1"'), ("x", "y")], "old string, new string")
    new = {"n1": 'new "1"', "x": "y"}
    assert got(trees.closed(trees.rewritten(parts, names))) == {k: dumped(changed(v, lambda x: new.get(x, x) if isinstance(x, str) else x)) for k, v in docs.items()}
    numbers = {6_000_000_001: "node:a", -6_000_000_001: "node:b", 7: "never", 1234567890123: "node:c"}

    def restore(x):
        if isinstance(x, int) and not isinstance(x, bool) and abs(x) > 2**31:
            return numbers.get(x, x)
        return numbers.get(int(x), x) if isinstance(x, str) and len(x) > 9 and x.lstrip("-").isdigit() else x

    table = spark.createDataFrame(list(numbers.items()), "number long, new string")
    assert got(trees.closed(trees.restored(parts, table))) == {k: dumped(changed(v, restore)) for k, v in docs.items()}


def test_positions_and_references(spark):
    docs = documents(3)

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items() if k not in trees.POSITION_KEYS}
        return [plain(v) for v in x] if isinstance(x, list) else x

    opened = trees.opened(frame(spark, docs))
    assert got(trees.closed(trees.without_keys(trees.texts(opened)))) == {k: dumped(plain(v)) for k, v in docs.items()}

    def refs(x):
        out = set()
        if isinstance(x, dict):
            out |= {x["ref_node_id"]} if isinstance(x.get("ref_node_id"), str) else set()
            out |= {v for v in x["ref_node_ids"] if isinstance(v, str)} if isinstance(x.get("ref_node_ids"), list) else set()
        for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            out |= refs(v)
        return out - {""}

    assert {(r.id, r.node) for r in trees.references(opened).collect()} == {(k, n) for k, v in docs.items() for n in refs(v)}

    nodes = {k: {"semantic_tree": v} for k, v in docs.items()}
    lines = [(k, f"READS||t{j}") for i, k in enumerate(docs) for j in range(i % 4)]
    rows = {r.id: r.fingerprint for r in trees.tree_fingerprints(frame(spark, nodes), spark.createDataFrame(lines, "id string, line string")).collect()}
    for k, v in docs.items():
        tree = plain(v) if v else None
        payload = json.dumps({"tree": tree or None if tree in ({}, [], "") else tree, "edges": sorted(x for i, x in lines if i == k)}, sort_keys=True, ensure_ascii=False)
        assert rows[k] == hashlib.sha256(payload.encode()).hexdigest()[:20], (k, payload)


def test_merged_documents(spark):
    left, right = documents(4), documents(5)
    right = {k: v for k, v in right.items() if k not in ("d1", "d2")} | {"only": {"a": [1]}}

    def merge(a, b):
        if isinstance(a, dict) and isinstance(b, dict):
            return a | {k: merge(a[k], v) if k in a else v for k, v in b.items()}
        if isinstance(a, list) and isinstance(b, list):
            out, seen = list(a), {dumped(x) for x in a}
            for v in b:
                if dumped(v) not in seen:
                    seen.add(dumped(v))
                    out.append(v)
            return out
        return b if a is None or a in ("", [], {}) else a

    want = {k: merge(left[k], right[k]) if k in left and k in right else left.get(k, right.get(k)) for k in {*left, *right}}
    result = got(trees.merged(frame(spark, left), frame(spark, right)))
    assert {k: json.loads(v) for k, v in result.items()} == want
