"""Registered queries: a Spark callable and, where SQL can state it, an independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitcast.functions.columns import rounded
from pitcast.plans.fixtures import Tables, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 4


def published(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Rounded measures; dates and instants as zone-free timestamps, which both engines print alike."""
    out = rounded(df, digits)
    stamps = {
        f.name: F.col(f.name).cast("timestamp_ntz") for f in out.schema.fields if f.dataType.typeName() in ("timestamp", "date")
    }
    return out.withColumns(stamps) if stamps else out


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register ``fn(tables) -> DataFrame`` under ``name``; measures are published with so many digits."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: published(fn(Tables(spark, sf_dir)), digits)
        if sql is not None:
            ORACLE[name] = with_fixtures(sql)
        return fn

    return wrap


def r(*names: str, digits: int = DIGITS) -> str:
    """SQL select list of rounded columns; ``expr AS name`` keeps its alias."""
    parts = []
    for n in names:
        expr, _, alias = n.rpartition(" AS ")
        parts.append(f"round({expr or n}, {digits}) + 0.0 AS {alias.rpartition('.')[2]}")
    return ", ".join(parts)


def d(*names: str) -> str:
    """SQL select list of dates as timestamps."""
    return ", ".join(f"CAST({n} AS TIMESTAMP) AS {n.rpartition('.')[2]}" for n in names)


def sql_linear(name: str, train: str, keys: list[str], xs: list[str], y: str, alpha: float = 0.0) -> str:
    """CTEs fitting least squares (or ridge on scaled features) per key by Gauss-Jordan elimination.

    ``{name}_b`` holds keys, n, my, m (means), s (deviations) and b (coefficients of scaled features).
    """
    k = len(xs)
    ks = "".join(f"{x}, " for x in keys)
    tks = "".join(f"t.{x}, " for x in keys)
    on = f"USING ({', '.join(keys)})" if keys else "ON true"
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    known = " AND ".join(f"({x}) IS NOT NULL" for x in [*xs, y])
    z = ", ".join(f"(x{i} - s.m[{i}]) / s.s[{i}]" for i in range(1, k + 1))
    return f"""{name}_t AS (SELECT {ks}{', '.join(f'CAST({x} AS DOUBLE) AS x{i}' for i, x in enumerate(xs, 1))}, CAST({y} AS DOUBLE) AS y FROM {train} WHERE {known}),
  {name}_s AS (SELECT {ks}count(*) AS n, avg(y) AS my, [{', '.join(f'avg(x{i})' for i in range(1, k + 1))}] AS m, [{', '.join(f'stddev_pop(x{i})' for i in range(1, k + 1))}] AS s FROM {name}_t {group}),
  {name}_z AS (SELECT {tks}[{z}, y - s.my] AS z FROM {name}_t t JOIN {name}_s s {on}),
  {name}_g AS (SELECT {ks}i, j, sum(z[i] * z[j]) + CASE WHEN i = j THEN {alpha} ELSE 0 END AS v FROM {name}_z, range(1, {k + 1}) a(i), range(1, {k + 2}) b(j) GROUP BY {ks}i, j),
  {name}_m AS (SELECT {ks}list(row ORDER BY i) AS m FROM (SELECT {ks}i, list(v ORDER BY j) AS row FROM {name}_g GROUP BY {ks}i) {group}),
  {name}_r AS (SELECT {ks}1 AS p, m FROM {name}_m UNION ALL SELECT {ks}p + 1, list_transform(m, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda x: x / m[p][p])
    ELSE list_transform(r, lambda x, j: x - r[p] * m[p][j] / m[p][p]) END) FROM {name}_r WHERE p <= {k}),
  {name}_b AS (SELECT {ks}n, my, s.m, s.s, list_transform(r.m, lambda q: q[{k + 1}]) AS b FROM {name}_r r JOIN {name}_s s {on} WHERE p = {k + 1})"""


def sql_pred(b: str, xs: list[str]) -> str:
    """Prediction expression from a row ``b`` of :func:`sql_linear`."""
    return f"{b}.my + " + " + ".join(f"{b}.b[{i}] * (({x}) - {b}.m[{i}]) / {b}.s[{i}]" for i, x in enumerate(xs, 1))
