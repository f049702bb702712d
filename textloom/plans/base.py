"""How queries are put down: a table, a key, result columns, and the same columns in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql

    def columns(self, name: str, table: str, key: str, sql: dict[str, str] | None, **made: Callable[[], Column]) -> None:
        """made: thunks, since columns need a session; sql: expressions of the same names over the table."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return read(spark, sf_dir, table).select(key, *(f().alias(k) for k, f in made.items()))

        self.add(name, query, sql and f"select {key}, {', '.join(f'{e} as {k}' for k, e in sql.items())} from {table}")

    def cases(self, name: str, values: list[str | None], sql: dict[str, str] | None, **made: Callable[[], Column]) -> None:
        """The same over literal texts, in the column c."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            schema = T.StructType([T.StructField("case_id", T.IntegerType()), T.StructField("c", T.StringType())])
            rows = spark.createDataFrame(list(enumerate(values)), schema)
            return rows.select("case_id", *(f().alias(k) for k, f in made.items()))

        listed = ", ".join(f"({i}, {quoted(v)})" for i, v in enumerate(values))
        self.add(name, query, sql and f"select case_id, {', '.join(f'{e} as {k}' for k, e in sql.items())} from (values {listed}) v(case_id, c)")


def quoted(text: str | None) -> str:
    """A SQL literal; control characters by chr()."""
    if text is None:
        return "null"
    parts = ["'" + x.replace("'", "''") + "'" if x.isprintable() else f"chr({ord(x)})" for x in text] or ["''"]
    return " || ".join(parts)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
