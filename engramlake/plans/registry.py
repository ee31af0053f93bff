"""Name -> query and name -> oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engramlake.functions.answers import WHITESPACE
from engramlake.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[fixtures.Tables], DataFrame]], Query]:
    """Register ``fn(tables)`` under ``name``; ``sql`` may use the fixture names as tables."""

    def wrap(fn: Callable[[fixtures.Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fixtures.Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = stripped(with_fixtures(sql))
        return run

    return wrap


def stripped(sql: str) -> str:
    """Write out ``strip(x)``, which oracle texts use for a trim of all white space."""
    while (m := re.search(r"(?<![\w.])strip\(", sql)) is not None:
        depth, at, quoted = 1, m.end(), False
        while depth:
            c = sql[at]
            quoted ^= c == "'"
            depth += 0 if quoted else {"(": 1, ")": -1}.get(c, 0)
            at += 1
        sql = f"{sql[: m.start()]}trim({sql[m.end() : at - 1]}, '{WHITESPACE}'){sql[at:]}"
    return sql


def with_fixtures(sql: str) -> str:
    """Put the fixtures a query mentions in front of it as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in fixtures.SQL.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({fixtures.SQL[n].strip()})" for n in needed)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{sql[15:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
