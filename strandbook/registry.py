"""All queries of the ledger library and their SQL."""

from .plans import catalog, queues, raw, sql, stored

QUERIES = catalog.QUERIES | raw.QUERIES | stored.QUERIES | queues.QUERIES
ORACLES = sql.ORACLES | raw.ORACLES | stored.ORACLES | queues.ORACLES

__all__ = ["ORACLES", "QUERIES"]
