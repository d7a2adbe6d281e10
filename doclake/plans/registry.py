"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doclake.session import partition_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")
#: Tables of short rows, of which documents many times as long are derived.
SHORT = ("customer", "supplier", "part", "orders", "lineitem", "events")
MARK = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def synth(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a derivation written in SQL that Spark and DuckDB both understand; ``{name}`` marks a table.

    Short rows are dealt out to all tasks before they become documents: a file of them is small, or one row group, and so one
    split, while the work goes by the documents' length.
    """
    def rows(name: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return df.repartition(partition_count(spark)) if name in SHORT else df

    names = sorted(set(MARK.findall(sql)))
    escaped = MARK.sub("\0\\1\1", sql).replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")
    return spark.sql(escaped, **{n: rows(n) for n in names})


def duck(sql: str) -> str:
    """The same derivation for DuckDB, where the tables are views of the same name."""
    return MARK.sub(r"\1", sql)
