"""Registry of named queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import functools

from pyspark.sql import DataFrame, SparkSession

from riskloom.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def spark_rounding(sql: str) -> str:
    """Rewrite every ``round(x, n)`` so DuckDB rounds like Spark: HALF_UP on the
    shortest decimal form of the double (DuckDB otherwise scales in floating
    point first, e.g. 51.949999999999996 -> 52.0 where Spark and Python give 51.9)."""
    out, i, key = [], 0, "round("
    low = sql.lower()
    while True:
        j = low.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, last_comma = 1, j + len(key), None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                last_comma = k
            elif ch == "'":
                k = sql.index("'", k + 1)
            k += 1
        inner_end = k - 1
        if last_comma is None:
            arg, digits = sql[j + len(key):inner_end], "0"
        else:
            arg, digits = sql[j + len(key):last_comma], sql[last_comma + 1:inner_end].strip()
        out.append(sql[i:j])
        out.append(f"CAST(round(CAST(CAST({spark_rounding(arg)} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)")
        i = k


def register(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB oracle (None when
    the result is not expressible in SQL and only rows are checked)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = spark_rounding(sql)
        return fn

    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from riskloom.plans import (  # noqa: F401
        q_evaluation,
        q_learning,
        q_log,
        q_neighbors,
        q_scoring,
        q_transactions,
    )
