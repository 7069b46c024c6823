"""Exact search and hard negatives against plain versions and SQL, on odd vectors and on the smallest table."""

import math
import random

import duckdb
import numpy as np
import pytest

pytest.importorskip("tracelake.llm")

from tracelake.llm import hard_negatives, tiles, topk_search  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, row string, stripe int, score double"


def odd_rows():
    rng = random.Random(5)
    rows = []
    for k in range(700):
        v = [rng.choice([-1, 1]) * rng.random() ** (1 + d // 8) for d in range(48)]
        rows.append((k, v, rng.choice([0, 0, 0, 1, 2, 3])))
    hub = rows[100][1]
    rows += [(1000 + k, list(hub), k % 3) for k in range(300)]  # a group of copies that ties everywhere
    rows += [rows[200], rows[200], rows[7], (None, list(hub), 1), (None, list(rows[3][1]), None)]
    rows += [(5000, None, 1), (5100, [0.5, None] * 24, 1), (5200, [math.nan] * 48, 1), (5300, [math.inf] * 48, 1), (5400, [], 1), (5500, [0.25] * 7, 0), (5501, [-0.25] * 60, None)]
    return [(*r, "x", 1, 0.5) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def usable(rows, factor):
    out = []
    for k, (i, v, label, *_) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(float(np.float32(x)) * factor) for x in v], label, k))
    return out


def order(x):
    return (-x[0], x[1] is None, x[1] or 0)


def product(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(2**63)), 2**63 - 1)


def plain_top(rows, k=10, every=100):
    rows, out = usable(rows, 1024), []
    for i, v, _, own in rows:
        if i is not None and i % every == 0:
            best = sorted(((product(v, w), j) for j, w, _, at in rows if at != own), key=order)[:k]
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(best, 1)]
    return out


def plain_mined(rows, every=100):
    rows, out = [r for r in usable(rows, 256) if r[2] is not None], []
    for i, v, label, own in rows:
        if i is not None and i % every == 0:
            scored = sorted(((product(v, w), j, other) for j, w, other, at in rows if at != own), key=order)
            for p, j, _ in [x for x in scored if x[2] == label][:5]:
                found = [(n, c) for n, c, other in scored if other != label and 30 * p <= 100 * n <= 90 * p][:10]
                out += [(i, j, rank, c, p, n) for rank, (n, c) in enumerate(found, 1)]
    return out


def as_sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x or 0) for x in r])


@pytest.fixture(params=["one cell", "many cells"])
def cells(request, monkeypatch):
    if request.param == "many cells":
        monkeypatch.setattr(tiles, "STRIPE_COMPONENTS", 8_000)
        monkeypatch.setattr(tiles, "BLOCK_ROWS", 3)
        for module, names in ((topk_search, ("BATCH", "CHUNK", "DIMENSIONS")), (hard_negatives, ("ANCHORS", "CANDIDATES", "LEAF"))):
            for name, value in zip(names, (2, 37, 4), strict=True):
                monkeypatch.setattr(module, name, value)


def test_search_is_that_of_all_pairs(odd, cells):
    got = topk_search.top_k(odd).select("query_id", "rank", "vec_id", "score").collect()
    assert as_sorted(got) == as_sorted(plain_top(odd_rows()))


def test_negatives_are_those_of_all_pairs(odd, cells):
    got = hard_negatives.mined(odd).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert as_sorted(got) == as_sorted(plain_mined(odd_rows()))


@pytest.mark.parametrize("scale", [1e6, 1e13, 1e30])
def test_large_components(spark, scale):
    rng = random.Random(3)
    rows = [(k, [float(np.float32(scale * rng.uniform(-1, 1))) for _ in range(8)], k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert as_sorted(topk_search.top_k(df, every=10).select("query_id", "rank", "vec_id", "score").collect()) == as_sorted(plain_top(rows, every=10))
    if scale < 1e10:
        got = hard_negatives.mined(df, every=10).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
        assert as_sorted(got) == as_sorted(plain_mined(rows, every=10))
    else:
        hard_negatives.mined(df, every=10).collect()


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 65, 70), (256, 64, 300), (7, 129, 5), (100, 100, 1001)])
def test_strassen(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (n, k)).T
    assert (hard_negatives.strassen(a, b) == a @ b).all()
    big = rng.integers(-(2**28), 2**28, (m, k)) * 2, rng.integers(-(2**28), 2**28, (k, n))
    assert (hard_negatives.strassen(*big) == big[0] @ big[1]).all()


@pytest.mark.parametrize("run", [topk_search.top_k, hard_negatives.mined])
def test_empty_tables_and_no_queries(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []
    assert run(spark.createDataFrame([(3, [1.0], 1, "x", 1, 0.5)], SCHEMA)).collect() == []
    assert run(spark.createDataFrame([(100, [1.0], 1, "x", 1, 0.5), (200, None, 1, "x", 1, 0.5)], SCHEMA)).collect() == []


@pytest.mark.parametrize("module", [topk_search, hard_negatives])
def test_as_sql(spark, module):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    got, want = module.query(spark, SMALL).toPandas(), con.execute(module.SQL).df()
    columns = list(want.columns)
    assert list(got.columns) == columns and len(got) > 40
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
