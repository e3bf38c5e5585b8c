"""All queries of this subpackage with their SQL."""

from siftnet.llm import distinct, frequent, mixing, nearest, packing, pii, runs

MODULES = [nearest, frequent, distinct, runs, packing, mixing, pii]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
