"""Global positions without a single-task window.

Rows are range-sorted, each partition numbers its own rows, and the per-partition counts become offsets. Sort keys end
in a unique column, so the sampler can split a hot key. The numbered rows are checkpointed first: numbering twice from
two samples would not agree, and a lost executor re-reads the checkpoint instead of re-sampling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclake.rules import rule_table
from doclake.session import cut_lineage, partition_count


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    placed = df.repartitionByRange(partition_count(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut_lineage(placed.withColumn("_id", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_id", 33).cast("int")).withColumn(
        "_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def _offsets(spark, numbered: DataFrame, value: Column) -> DataFrame:
    """One row per partition: bounded by the partition count, whatever the data size."""
    totals = {r[0]: r[1] for r in numbered.groupBy("_part").agg(F.sum(value)).collect()}
    rows, running = [], 0
    for part in sorted(totals):
        rows.append((part, running))
        running += totals[part] or 0
    return F.broadcast(rule_table(spark, rows or [(-1, 0)], "_part, _offset"))


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Adds the zero-based global position in ``order``; end ``order`` with a unique key."""
    numbered = _numbered(df, list(order))
    offsets = _offsets(df.sparkSession, numbered, F.lit(1).cast("bigint"))
    return numbered.join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_row")).drop("_part", "_row", "_offset")


def with_next(df: DataFrame, value: Column, *order: Column, name: str = "next") -> DataFrame:
    """Adds the following row's ``value`` in global order, null for the last row."""
    numbered = _numbered(df.withColumn("_value", value), list(order))
    firsts = sorted((r[0], r[1]) for r in numbered.groupBy("_part").agg(F.min_by("_value", "_row")).collect())
    edges = [(a[0], b[1]) for a, b in zip(firsts, firsts[1:])] or [(-1, 0)]
    edge = F.broadcast(rule_table(df.sparkSession, edges, "_part, _edge"))
    inside = F.lead("_value").over(W.partitionBy("_part").orderBy("_row"))
    return numbered.withColumn("_inside", inside).join(edge, "_part", "left").withColumn(
        name, F.coalesce("_inside", "_edge")).drop("_part", "_row", "_value", "_inside", "_edge")


def with_running_sum(df: DataFrame, value: Column, group: Column, *order: Column, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over the earlier rows of the same group.

    A group that spans several partitions is summed partition by partition; per-group totals of a partition are small
    rows (partitions + groups of them), and their prefix window runs per group over those totals only.
    """
    numbered = _numbered(df.withColumns({"_value": value, "_group": group}), [F.col("_group"), *order])
    totals = numbered.groupBy("_group", "_part").agg(F.sum("_value").alias("_total"))
    earlier = F.coalesce(F.sum("_total").over(W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_group", "_part", earlier.alias("_earlier"))
    inside = F.coalesce(F.sum("_value").over(W.partitionBy("_group", "_part").orderBy("_row").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0))
    return numbered.withColumn("_inside", inside).join(totals, ["_group", "_part"]).withColumn(
        name, F.col("_earlier") + F.col("_inside")).drop("_group", "_part", "_row", "_value", "_inside", "_earlier")
