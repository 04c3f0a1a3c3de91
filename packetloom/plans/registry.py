"""Registry of runnable queries and of the equivalent SQL text used to check them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """Name a SQL fragment; fragments may refer to one another by name."""
    CTES[name] = sql.strip()


def nudge_rounds(sql: str) -> str:
    """Rewrite ``round(x, d)`` as the tie-safe form used on the Spark side (see ``columns.r``)."""
    out, i = "", 0
    while (at := sql.find("round(", i)) >= 0:
        if at and (sql[at - 1].isalnum() or sql[at - 1] == "_"):
            out, i = out + sql[i:at + 6], at + 6
            continue
        depth, comma, j = 1, -1, at + 6
        while depth:
            ch = sql[j]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = j
            j += 1
        inner = nudge_rounds(sql[at + 6:comma])
        out += sql[i:at] + f"(round(({inner}) + 1e-9, {sql[comma + 1:j - 1].strip()}) + 0.0)"
        i = j
    return out + sql[i:]


def expand(sql: str) -> str:
    """Prefix ``sql`` with the WITH list of all fragments it needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_0-9]+", text):
            if word in CTES and word not in order and CTES[word] != text:
                visit(CTES[word])
                if word not in order:
                    order.append(word)

    visit(sql)
    if not order:
        return sql.strip()
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[14:].strip()}"
    return f"WITH {head},\n{body[4:].strip()}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def oracles() -> dict[str, str]:
    return {n: nudge_rounds(expand(s)) for n, s in ORACLES.items()}
