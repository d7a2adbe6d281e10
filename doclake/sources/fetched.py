"""Pages that were fetched earlier, and the per-row error policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_fetched(df: DataFrame, status: str = "status", content: str = "content", max_bytes: int | None = None) -> DataFrame:
    """Adds ``error_class``: null for usable rows, ``status`` or ``size`` for rejected ones."""
    error = F.when(~F.col(status).between(200, 299), "status")
    if max_bytes is not None:
        error = error.when(F.octet_length(content) > max_bytes, "size")
    return df.withColumn("error_class", error)


def split_errors(df: DataFrame, error: str = "error_class", policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters). ``fail`` turns the first bad row into a job failure instead."""
    bad = df.filter(F.col(error).isNotNull())
    if policy == "fail":
        checked = F.when(F.col(error).isNotNull(), F.raise_error(F.concat(F.lit("bad input: "), F.col(error).cast("string"))).cast("boolean")).otherwise(True)
        return df.filter(checked).drop(error), bad
    return df.filter(F.col(error).isNull()).drop(error), bad
