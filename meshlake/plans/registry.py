"""The registry of queries: one function per query, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under a name."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rn(c: Column | str, n: int) -> Column:
    """``n`` decimals. A thousandth of the last place is added first, so that exact halves, whose last bit depends on the engine's order of summing, go up in any case."""
    return F.round((F.col(c) if isinstance(c, str) else c) + float(f"1e-{n + 3}"), n)


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return rn(c, 6) + 0.0


def rounded(df: DataFrame, *names: str, scale: float = 1.0) -> DataFrame:
    """``df`` with the named columns scaled and rounded."""
    return df.withColumns({n: r6(F.col(n) * scale) for n in names})
