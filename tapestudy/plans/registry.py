"""Query registry: each entry pairs a Spark callable with an equivalent SQL text.

The ``cols`` text of an entry names the result columns and how they are made comparable:
``name`` as is, ``name:f`` double rounded to 6 digits, ``name:f4`` to 4 digits, ``name:i`` 64-bit
integer, ``name:b`` boolean as 0/1, ``name:s`` date or timestamp as text.
The same text drives the Spark projection and the outer SELECT of the SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    name: str
    cols: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def _columns(cols: str):
    for item in cols.split():
        name, _, kind = item.partition(":")
        yield name, kind


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind.startswith("f"):
        # adding 0.0 turns a negative zero into a plain zero
        c = F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
    elif kind in ("i", "b"):
        c = c.cast("bigint")
    elif kind == "s":
        c = c.cast("string")
    return c.alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind.startswith("f"):
        return f"round(CAST({name} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0 AS {name}"
    if kind in ("i", "b"):
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    return name


def query(name: str, cols: str, sql: str | None = None, ctes=()):
    """Register the decorated (spark, sf_dir) -> DataFrame function under ``name``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_column(n, k) for n, k in _columns(cols)])

        text = None
        if sql is not None:
            head = ("WITH " + ",\n".join(ctes) + "\n") if ctes else ""
            outer = ", ".join(_sql_column(n, k) for n, k in _columns(cols))
            text = f"{head}SELECT {outer} FROM (\n{sql.strip()}\n) AS result"
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, cols, run, text)
        return fn

    return wrap
