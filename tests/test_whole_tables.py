"""Queries without SQL take every start: held against a plain search over the smallest tables."""

import pytest

from tracelake.contract import DATA_TARGETS
from tracelake.operators import traverse
from tracelake.plans.projection import edges, nodes

SF = "/root/testdata/sf0.001"
MOST = 100


@pytest.fixture(scope="module")
def targets(spark):
    """Each screen that reaches data: how many data targets, all of them three steps away."""
    kind = {r.stable_id: r.node_type for r in nodes(spark, SF).select("stable_id", "node_type").collect()}
    out = {}
    for r in edges(spark, SF).select("source", "target").collect():
        out.setdefault(r.source, set()).add(r.target)
    found = {}
    for start in (k for k, t in kind.items() if t == "SCREEN"):
        ends = {t for api in out.get(start, ()) for method in out.get(api, ()) for t in out.get(method, ()) if kind.get(t) in DATA_TARGETS}
        if ends:
            found[start] = len(ends)
    return found


def test_flow_steps_of_every_screen(spark, targets):
    got = {(r.start, r.step): r.nodes for r in traverse.QUERIES["flow_steps"](spark, SF).collect()}
    assert len(targets) > 20
    assert {k: n for (k, step), n in got.items() if step == 3} == {k: min(MOST, n) for k, n in targets.items()}
    assert {k for k, step in got if step == 0} == set(targets)


def test_node_flow_index_of_every_screen(spark, targets):
    got = {r.node: r.flows for r in traverse.QUERIES["node_flow_index"](spark, SF).collect()}
    assert {k: n for k, n in got.items() if k.startswith("screen:")} == dict.fromkeys(targets, 1)
    assert sum(n for k, n in got.items() if k.startswith("table:")) == sum(min(MOST, n) for n in targets.values())
