"""Named queries, each with its columns and, where SQL can state it, the same query in SQL.

Columns are ``name:kind`` (d date, s text, i whole number, f double at six places, b truth value);
both sides are brought to these kinds, so results compare by value. Places are cut a little off the
half, as quotients like x / 32 lie on it exactly and engines differ in what they do there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_TYPES = {"d": "date", "s": "string", "i": "bigint", "b": "boolean"}
_SQL = {"d": "CAST({0} AS DATE)", "s": "CAST({0} AS VARCHAR)", "i": "CAST({0} AS BIGINT)", "f": "CASE WHEN abs(CAST({0} AS DOUBLE)) < 1e9 THEN floor(CAST({0} AS DOUBLE) * 1e6 + 0.50371) / 1e6 ELSE CAST({0} AS DOUBLE) END", "b": "CAST({0} AS BOOLEAN)"}


#: Beyond this a double's own places are coarser than a millionth's half, so it stays as it is.
_COARSE = 1e9


def _six(c: Column) -> Column:
    """At six places; large values unchanged, as floor() gives whole numbers of 64 bits."""
    return F.when(F.abs(c) < _COARSE, F.floor(c * 1e6 + 0.50371).cast("double") / 1e6).otherwise(c)


def shaped(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in (c.split(":") for c in columns.split()):
        c = F.col(name)
        out.append((_six(c.cast("double")) if kind == "f" else c.cast(_TYPES[kind])).alias(name))
    return df.select(*out)


def query(columns: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under its name."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: shaped(fn(spark, sf_dir), columns)
        QUERIES[name].__doc__ = fn.__doc__
        if sql:
            ORACLES[name] = "SELECT " + ", ".join(f"{_SQL[k].format(n)} AS {n}" for n, k in (c.split(":") for c in columns.split())) + f" FROM ({sql}) AS result"
        return fn

    return register
