"""Named queries: a DataFrame plan over the given tables and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql.strip())


def with_ctes(names: tuple[str, ...], body: str) -> str:
    """Prefix a query with the named common table expressions and whatever those need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            add(need)
        ordered.append(name)

    for name in names:
        add(name)
    body = body.strip()
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    recursive = "RECURSIVE " if body.startswith("RECURSIVE ") else ""
    body = body.removeprefix("RECURSIVE ")
    if body.startswith("WITH "):
        return f"WITH {recursive}{head},\n{body.removeprefix('WITH ')}"
    return f"WITH {recursive}{head}\n{body}"


def query(name: str, *ctes: str, sql: str | None = None):
    def register(plan: Callable) -> Callable:
        from kinelake.plans.fixtures import Tables

        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql is not None:
            SQL_PARTS[name] = (ctes, sql)
        return plan

    return register


def oracle() -> dict[str, str]:
    """SQL text of every query that has one; expressions may come from any module, so this runs after all imports."""
    return {name: with_ctes(ctes, sql) for name, (ctes, sql) in SQL_PARTS.items()}
