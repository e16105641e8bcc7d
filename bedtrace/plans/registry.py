"""Registry of the named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql`` is its check on the same tables, or None where SQL cannot express it at full size."""

    def keep(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return keep


# Values that lie exactly between two last digits would round by the order in which they were summed; a nudge far below
# the last digit settles them the same way on both sides.
NUDGE = 1.3e-3


def shown(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """Output columns of a query: keys as they are, values as rounded doubles."""
    return df.select(*keys, *[rounded(F.col(v), digits).alias(v) for v in values])


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double") + F.lit(NUDGE * 10.0**-digits), digits) + F.lit(0.0)


def sql_rounded(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + CAST({NUDGE * 10.0**-digits!r} AS DOUBLE), {digits}) + 0.0"


def sql_shown(keys: list[str], values: list[str], digits: int = 6) -> str:
    """The same select list for the SQL side."""
    return ", ".join([*keys, *[f"{sql_rounded(v, digits)} AS {v}" for v in values]])
