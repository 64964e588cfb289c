"""Where the registered queries and their SQL meet."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.text import WHITESPACE
from gazette.registry import fixtures
from gazette.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Steps several SQL texts share, by name; each may use the views and the steps before it.
STEPS: dict[str, str] = {}

WS = f"'{WHITESPACE}'"


def query(name: str, sql: str | None = None):
    """Registers a query and, where there is one, the SQL that must give the same rows."""

    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def oracles() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLES.items()}


def with_views(sql: str) -> str:
    """`sql` with a WITH clause for every `v_...` name it uses."""
    known = {f"v_{n}": text for n, text in fixtures.ctes().items()} | {
        f"v_{n}": text for n, text in STEPS.items()
    }
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name not in needed and name in known:
                visit(known[name])
                needed.append(name)

    visit(sql)
    clause = ",\n".join(f"{n} AS (\n{known[n]}\n)" for n in needed)
    return f"WITH {clause}\n{sql}" if needed else sql


def time_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_time(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def sql_strip(c: str) -> str:
    return f"trim({c}, {WS})"


def rows_text(items: Column, *fields: str) -> Column:
    """A list of structs as text, one element per line."""
    return F.array_join(
        F.transform(items, lambda x: F.concat_ws(" | ", *[x[f] for f in fields])), "\n"
    )


def sql_rows_text(items: str, *fields: str) -> str:
    joined = " || ' | ' || ".join(f"x.{f}" for f in fields)
    return f"coalesce(array_to_string(list_transform({items}, lambda x: {joined}), chr(10)), '')"
