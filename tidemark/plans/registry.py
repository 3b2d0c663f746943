"""Named queries over the bound relations, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.binding import Bound, relation_ctes

QUERIES: dict[str, Callable[[Bound], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def _once(cte: str) -> str:
    """The CTE computed once, however often it is read; tables of all replicates are streamed instead."""
    return cte if "replicate" in cte else re.sub(r"^(\w+) AS \(", r"\1 AS MATERIALIZED (", cte)


def sql(*ctes: str, select: str) -> str:
    """SQL text over the bound relations: the given CTEs follow those of the relations."""
    return "WITH " + ",\n".join(_once(c) for c in [*relation_ctes(), *ctes]) + "\n" + select


def query(name: str, check: str | None = None) -> Callable:
    """Register ``fn(relations) -> DataFrame`` under a name."""

    def register(fn: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = check
        return fn

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Dates as text and doubles rounded, so that results compare across engines."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DIGITS)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return comparable(QUERIES[name](Bound(spark, folder)))
