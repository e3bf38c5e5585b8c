"""All queries of the core with their SQL, gathered from the modules that hold them."""

from __future__ import annotations

from siftnet.operators import community, detect, devices, identity, management, query, rules, scoring, series, sessions, shred, timestamps
from siftnet.plans.base import Query
from siftnet.sources import feeds, ingest, logs
from siftnet.streaming import queries as streams

MODULES = [sessions, shred, timestamps, detect, query, rules, series, devices, identity, management, community, scoring, ingest, logs, feeds, streams]


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
