"""Registry of runnable queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Derived tables by name: (names it reads, SQL). Filled by :mod:`inclina.catalog.entities`.
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {}


class Tables:
    """Tables of one data folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def with_derived(body: str, names: Sequence[str]) -> str:
    """SQL text preceded by the derived tables it reads, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in DERIVED[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    heads = [f"{n} AS ({DERIVED[n][1]})" for n in order]
    return (f"WITH {', '.join(heads)} " if heads else "") + body


def query(name: str, sql: str | None = None, reads: Sequence[str] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with the SQL of the same result."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = with_derived(sql, reads)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, columns: Sequence[str] | None = None) -> DataFrame:
    """Doubles rounded, so that summation order does not show."""
    names = columns or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def longs(df: DataFrame) -> DataFrame:
    """Integer columns widened to bigint."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "short", "byte")]
    return df.withColumns({c: F.col(c).cast("bigint") for c in names}) if names else df
