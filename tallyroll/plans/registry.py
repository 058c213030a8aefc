"""Every query next to the DuckDB text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyroll.session import prepare
from tallyroll.tables import Tables, duckdb_sql

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of the tables; ``oracle`` uses the same table names in braces."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def plain(df: DataFrame) -> DataFrame:
    """Result columns in types every engine shows alike: bigint, double, string, boolean."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif kind.startswith("decimal") or kind == "float":
            c = c.cast("double")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = c.cast("string")
        elif kind == "array<string>":
            c = F.array_join(c, ",")
        out.append(c.alias(name))
    return df.select(*out)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return plain(QUERIES[name](Tables(prepare(spark), folder)))


def oracle_texts() -> dict[str, str]:
    return {name: duckdb_sql(text) for name, text in ORACLES.items()}
