"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. On each level every child draws ``ln(u) / weight`` with ``u`` in (0, 1] hashed from
the row's key and the child's name; the largest draw wins. A draw does not depend on the siblings, so a changed weight
moves rows only into or out of the child that has it: movement stays inside the subtrees whose weights change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import shuffle_partitions, stored

#: Hash buckets that slots are numbered in; positions need shards x buckets counters.
BUCKETS = 512


@dataclass(frozen=True)
class Tree:
    """Shards as (region, rack, shard number, weight); a rack's and a region's weight is the sum below it."""

    leaves: tuple[tuple[str, str, int, float], ...]

    def __post_init__(self):
        if len({s for _, _, s, _ in self.leaves}) < len(self.leaves) or not self.leaves:
            raise ValueError("shards need distinct numbers, and there must be one")
        if any(w <= 0 for *_, w in self.leaves):
            raise ValueError("weights are positive")

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """Node path -> (child path, weight); the root is the empty path."""
        out: dict[str, dict[str, float]] = {}
        for region, rack, shard, weight in self.leaves:
            for parent, child in (("", region), (region, f"{region}/{rack}"), (f"{region}/{rack}", f"{region}/{rack}/{shard}")):
                out.setdefault(parent, {})
                out[parent][child] = out[parent].get(child, 0.0) + weight
        return {k: sorted(v.items()) for k, v in out.items()}

    def with_weight(self, shard: int, weight: float) -> Tree:
        return Tree(tuple((r, k, s, weight if s == shard else w) for r, k, s, w in self.leaves))


def even_tree(shards: int, racks: int = 2, per_rack: int = 5) -> Tree:
    """``shards`` equal shards in racks of ``per_rack`` and regions of ``racks`` racks."""
    return Tree(tuple((f"r{i // (racks * per_rack)}", f"k{i // per_rack % racks}", i, 1.0) for i in range(shards)))


def grown_tree(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own: no other subtree's weight changes, so rows move only into the new shard."""
    number = max(s for _, _, s, _ in tree.leaves) + 1
    return Tree((*tree.leaves, (f"g{number}", "k0", number, weight)))


def draw(key: Column, node: Column, weight: Column) -> Column:
    """ln(u) / weight; u from the first 52 bits of md5 of key and node, so that any SQL engine can repeat it."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, node).cast("binary")), 1, 13), 16, 10).cast("double")
    return F.log((bits + 1.0) / float(2**52)) / weight


def place(key: Column, tree: Tree) -> Column:
    """Shard number of ``key`` (a text). Ties of draws go to the later name."""
    table = F.create_map(*[x for parent, kids in tree.children().items() for x in (
        F.lit(parent), F.array(*[F.struct(F.lit(c).alias("node"), F.lit(w).alias("weight")) for c, w in kids]))])
    node = F.lit("")
    for _ in range(3):
        kids = F.element_at(table, node)
        node = F.array_max(F.transform(kids, lambda c: F.struct(draw(key, c["node"], c["weight"]).alias("draw"), c["node"].alias("node"))))["node"]
    return F.element_at(F.split(node, "/"), -1).cast("int")


def shard_rows(rows: DataFrame, key: str, text: str, tree: Tree, more: Tree | None = None) -> DataFrame:
    """Columns (key, size, text_crc32, shard, slot, grown_shard): a place for every row, by its key alone.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16. ``slot`` numbers a shard's rows from 0 without gaps: rows are
    numbered inside hash buckets, which start at the counts of the shard's buckets before them. Null keys act as an
    empty text; equal keys share a shard and differ in slot; null texts have crc32 0. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = rows.select(
        F.col(key), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), place(name, tree).alias("shard"),
        (place(name, more) if more else F.lit(None).cast("int")).alias("grown_shard"))
    # by md5, so that any SQL engine can repeat it; rows of one key with other texts go to other buckets
    whole = F.md5(F.concat_ws("|", name, F.col("text_crc32").cast("string"), F.col("size").cast("string")).cast("binary"))
    placed = placed.withColumn("bucket", F.pmod(F.conv(F.substring(whole, 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int"))
    placed = stored(placed, "shards")
    from pyspark.sql import Window

    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket", "shard").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    numbered = placed.repartition(shuffle_partitions(rows.sparkSession), "bucket", "shard").withColumn("at", F.row_number().over(inside) - 1)
    # at most shards x buckets rows, whatever the input
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(
        key, "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")
