"""Registry of the runnable queries: each pairs a DataFrame plan with equivalent SQL.

`cols` declares the result once for both sides, e.g. "sample_id:l name:s v:d":
l = bigint, s = string, b = boolean, d[k] = double compared at k decimals (6 by default).
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .fixtures import SQL_VIEWS, Views

REGISTRY: dict[str, "Query"] = {}

# Compared decimals are cut slightly off the half so that exact decimal ties cannot split the sides.
_HALF = 0.50013


class Query:
    def __init__(self, name: str, cols: str, plan: Callable, sql: str | None):
        self.name, self.plan, self.sql = name, plan, sql
        self.cols = []
        for part in cols.split():
            c, t = part.split(":")
            self.cols.append((c, t[0], int(t[1:] or 6) if t[0] == "d" else 0))

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.plan(Views(spark, sf_dir))
        out = []
        for c, t, k in self.cols:
            x = F.col(c)
            if t == "l":
                x = x.cast("bigint")
            elif t == "s":
                x = x.cast("string")
            elif t == "b":
                x = x.cast("boolean")
            else:
                x = F.floor(x.cast("double") * float(10 ** k) + _HALF) / float(10 ** k)
            out.append(x.alias(c))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        types = {"l": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}
        out = []
        for c, t, k in self.cols:
            if t == "d":
                out.append(f"floor(CAST({c} AS DOUBLE) * {10 ** k}.0::DOUBLE + {_HALF}::DOUBLE)"
                           f" / {10 ** k}.0::DOUBLE AS {c}")
            else:
                out.append(f"CAST({c} AS {types[t]}) AS {c}")
        body = self.sql.strip().rstrip(";")
        return f"{with_views(body)}SELECT {', '.join(out)} FROM (\n{body}\n) AS result"


def with_views(body: str) -> str:
    """WITH clause holding the input views `body` mentions, dependencies first."""
    order: list[str] = []

    def need(text: str):
        for v in re.findall(r"\bv_\w+", text):
            if v in SQL_VIEWS and v not in order:
                need(SQL_VIEWS[v])
                order.append(v)
    need(body)
    if not order:
        return ""
    return "WITH " + ",\n".join(f"{v} AS ({SQL_VIEWS[v].strip()})" for v in order) + "\n"


def query(name: str, cols: str, plan: Callable[[Views], DataFrame], sql: str | None = None):
    if name in REGISTRY:
        raise ValueError(f"query {name} registered twice")
    REGISTRY[name] = Query(name, cols, plan, sql)
