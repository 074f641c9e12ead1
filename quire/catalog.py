"""Queries of the core engine by name, and the SQL that checks them."""

from __future__ import annotations

from quire.operators import moments, packed
from quire.plans import convert, corpus, inspect, readers


def queries() -> dict:
    return {
        **corpus.QUERIES,
        **inspect.QUERIES,
        **convert.QUERIES,
        **readers.QUERIES,
        "p2_found": moments.p2_found,
        "p2_normalise": moments.p2_normalise,
        "p2_zones": moments.p2_zones,
        "p3_found": packed.p3_found,
        "p3_unpack": packed.p3_unpack,
    }


def oracle_sql() -> dict:
    return {**corpus.ORACLES, **inspect.ORACLES, **convert.ORACLES, **readers.ORACLES}
