"""All registered queries with their SQL."""

from __future__ import annotations

from . import arbitrage, backtests, extended, further, matching, pricing, probability, relational

QUERIES = {}
for module in (pricing, relational, matching, arbitrage, probability, backtests, extended, further):
    QUERIES |= module.QUERIES


def queries():
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
