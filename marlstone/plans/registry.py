"""Queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Common table expressions of the oracles.
MONTHLY = "monthly AS (SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, c_mktsegment AS g, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
DAILY = "daily AS (SELECT o_orderstatus AS g, o_orderdate::DATE AS d, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY ALL)"
WEEKLY = "weekly AS (SELECT o_orderstatus AS g, date_trunc('week', o_orderdate)::DATE AS d, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY ALL)"
SUPPLIER = "sq AS (SELECT l_suppkey AS g, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INT AS o, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS flow, max(l_extendedprice::DECIMAL(18,2))::DOUBLE AS stock, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty FROM lineitem GROUP BY ALL)"
