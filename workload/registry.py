"""Collects queries with their oracle SQL and renders the shared table expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import ship_package
from workload import scope
from workload.oracle_tables import TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
# Exact decimal halves are common in means of money amounts and the two engines round
# them differently; a tiny shift on both sides moves them off the boundary.
SHIFT = 3.1415926e-8


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in TABLES:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(TABLES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def render(sql: str, doubles: list[str]) -> str:
    """Put the table expressions a query uses in front of it and round its doubles."""
    ctes = [f"{name} AS MATERIALIZED (\n{TABLES[name].strip()}\n)" for name in _needed(sql, [])]
    ctes.append(f"result AS (\n{sql.strip()}\n)")
    rounded = ", ".join(f"round({c} + {SHIFT:.15f}, {DIGITS}) + 0.0 AS {c}" for c in doubles)
    star = f"* REPLACE ({rounded})" if doubles else "*"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {star} FROM result"


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``fn(spark, sf_dir)``; ``doubles`` lists the columns rounded on both sides."""
    cols = doubles.split()

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            scope.start()
            ship_package(spark)
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c) + SHIFT, DIGITS) for c in cols}) if cols else df

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = render(sql, cols)
        return fn

    return register
