"""Registration of queries and of the SQL text that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from probeline.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Common table expressions used by more than one check: name -> (names it needs, body).
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def cte(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    if name in CTES:
        raise ValueError(f"cte {name} defined twice")
    CTES[name] = (tuple(needs), body)


def _collect(name: str, seen: list[str]) -> None:
    for need in CTES[name][0]:
        _collect(need, seen)
    if name not in seen:
        seen.append(name)


def with_ctes(names: str, final: str) -> str:
    """``WITH`` clause of the named expressions and all they need, then the final select."""
    order: list[str] = []
    for name in names.split():
        _collect(name, order)
    parts = ", ".join(f"{name} AS ({CTES[name][1]})" for name in order)
    return f"WITH {parts} {final}"


def r(expression: str, digits: int = 6) -> str:
    """Rounded double in SQL, shifted like ``functions.columns.rounded``; adding zero turns a negative
    zero into zero."""
    return f"(round(({expression})::DOUBLE + 1e-{digits + 3}::DOUBLE, {digits}) + 0.0::DOUBLE)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")
