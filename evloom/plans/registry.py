"""Named queries and, where one exists, the SQL text that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evloom.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def oracle(body: str) -> str:
    """Prefix ``body`` with the fixture views it mentions."""
    used = [name for name in fixtures.VIEWS if re.search(rf"\b{name}\b", body)]
    prefix = fixtures.ctes(used)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if not prefix:
        return body.strip()
    if head:
        return f"WITH {head.group(1) or ''}{prefix},\n{body[head.end():]}".strip()
    return f"WITH {prefix}\n{body}".strip()


def stable(c, digits: int = 6):
    """Round with a small fixed shift, so that sums taken in another order cannot flip a tie."""
    return F.round(c + F.lit(2.3 * 10 ** -(digits + 2)), digits)


def sql_stable(expr: str, digits: int = 6) -> str:
    return f"round(CAST(({expr}) AS DOUBLE) + {2.3 * 10 ** -(digits + 2):.{digits + 3}f}, {digits})"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return keep
