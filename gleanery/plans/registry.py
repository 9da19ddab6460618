"""The register of queries: a function each, with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.rstrip("_")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = " ".join(sql.split())
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flat(df: DataFrame) -> DataFrame:
    """Arrays as their elements with commas between, and structs in them with colons, so that results compare as plain values."""

    def said(column: Column, kind) -> Column:
        if isinstance(kind, ArrayType):
            return F.array_join(F.transform(column, lambda x: said(x, kind.elementType)), ",")
        if isinstance(kind, StructType):
            return F.concat_ws(":", *(said(column[f.name], f.dataType) for f in kind))
        return column.cast("string")

    return df.select(*(said(F.col(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema))
