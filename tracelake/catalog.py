"""All lineage queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from tracelake.operators import aggregates, budget, business, catalogue, derive, details, diff, frontier, joins, knowledge, linker, linking, listing, memory, merge, paths, reports, search, traverse, trees
from tracelake.sources import imports, readers
from tracelake.streaming import usage

MODULES: tuple = (listing, aggregates, joins, linking, traverse, frontier, paths, memory, reports, merge, diff, search, derive, knowledge, catalogue, budget, trees, details, business, linker, imports, readers, usage)
FLAGSHIP = "screen_impact"


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
