"""Near-duplicate vectors by cross-polytope hashing.

A hash rotates the unit vector with three rounds of random signs and a fast Hadamard transform and takes the nearest
signed axis. A table joins several hashes; besides its own bucket a vector probes the buckets of its next nearest axes.
Vectors that share a bucket are compared; every linked pair is counted in the smallest bucket it shares, so that links
are exact counts though no pair ever becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import connected_components, keyed_groups, shuffle_partitions, stored
from doclake.llm.topk import finite
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)

#: Vectors of one bucket that one task compares with each other; larger buckets are compared part against part.
TOGETHER = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x


def codes(unit: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Bucket codes (rows x tables * probes): for each table the vector's own bucket and the next most likely ones.

    A probe replaces one hash by its second axis, those first whose second axis is nearly as near as the first.
    """
    n, d = unit.shape
    size = 1 << max(0, d - 1).bit_length()
    padded = np.zeros((n, size))
    padded[:, :d] = unit
    rng = np.random.default_rng([seed, size])
    out = np.empty((n, tables * probes), dtype=np.int64)
    for t in range(tables):
        axes, gaps = [], []
        for _ in range(hashes):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], size)) / np.sqrt(size)
            near = np.abs(x)
            first = near.argmax(axis=1)
            height = near[np.arange(n), first]
            near[np.arange(n), first] = -1
            second = near.argmax(axis=1)
            gaps.append(height - near[np.arange(n), second])
            axes.append([2 * a + (x[np.arange(n), a] < 0) for a in (first, second)])
        own = np.full(n, t, dtype=np.int64)
        for a in axes:
            own = own * (2 * size) + a[0]
        out[:, t * probes] = own
        order = np.argsort(np.stack(gaps, axis=1), axis=1, kind="stable")
        for p in range(1, probes):
            which = order[:, p - 1]
            code = np.full(n, t, dtype=np.int64)
            for h, a in enumerate(axes):
                code = code * (2 * size) + np.where(which == h, a[1], a[0])
            out[:, t * probes + p] = code
    return out


def hash_rows(batches: Iterator[pa.RecordBatch], tables: int, hashes: int, probes: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d))
            flat = part.column("v").flatten().to_numpy()
            unit = flat.reshape(part.num_rows, int(d))
            found = codes(unit, tables, hashes, probes, seed)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), part.column("copies"), part.column("v"), pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.int64())), part.column("dim")],
                ["node", "copies", "v", "codes", "dim"])


def compare(groups: Iterator[pa.Table], cosine: float) -> Iterator[pa.RecordBatch]:
    """Of each bucket part: links of every vector, and edges that join what its links join."""
    out: list[list] = [[], [], []]
    rows = 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["a", "b", "links"])

    for g in groups:
        n = g.num_rows
        if n < 2:
            continue
        x = g.column("v").combine_chunks().flatten().to_numpy().reshape(n, -1)
        shared = g.column("codes").combine_chunks().flatten().to_numpy().reshape(n, -1)
        node, copies, side = (g.column(c).to_numpy() for c in ("node", "copies", "side"))
        code, left, right = (g.column(c)[0].as_py() for c in ("code", "left", "right"))
        links = np.zeros(n, dtype=np.int64)
        root = np.arange(n)
        for at in range(0, n, 512):
            dots = x[at: at + 512] @ x.T
            i, j = np.nonzero(dots >= cosine)
            i += at
            keep = (i < j) if left == right else (side[i] == left) & (side[j] == right)
            i, j = i[keep], j[keep]
            for k in range(0, len(i), 8192):  # a pair belongs to the smallest bucket that holds both
                a, b = i[k: k + 8192], j[k: k + 8192]
                both = (shared[a][:, :, None] == shared[b][:, None, :]).any(axis=2)
                first = np.where(both, shared[a], np.iinfo(np.int64).max).min(axis=1) == code
                a, b = a[first], b[first]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                while len(a):  # hang larger roots below smaller ones until the pairs agree
                    ra, rb = root[a], root[b]
                    differ = ra != rb
                    a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
                    np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                    while not np.array_equal(root, root[root]):
                        root = root[root]
        got = np.flatnonzero(links)
        if len(got):
            out[0].append(node[got])
            out[1].append(node[root[got]])
            out[2].append(links[got])
            rows += len(got)
        if rows > 50_000:
            yield batch()
            out, rows = [[], [], []], 0
    if rows:
        yield batch()


def near_vectors(vectors: DataFrame, vec_id: str, vector: str, cosine: float = 0.95, tables: int = 8, hashes: int = 2,
                 probes: int = 3, seed: int = 11, together: int = TOGETHER) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for every id.

    ``n_links`` counts the other vectors found with at least ``cosine`` in double precision, ``component_id`` is the
    smallest id reachable by links, ``kept`` marks it. Null or zero vectors and those with null or non-finite components
    link with nothing. Vectors link with those of as many dimensions. Rows that repeat an id are one vector, the
    smallest; a null id is an id of its own that links with nothing. Other columns are not read.

    Equal vectors become one node with a count before anything is hashed, so a third of all rows in one vector costs one
    node. ``hashes`` should grow with the logarithm of the number of distinct vectors; buckets of more than ``together``
    nodes are split in parts that meet pairwise, nothing is capped.
    """
    if probes > hashes + 1:
        raise ValueError("a table has one probe for each hash besides its own bucket")
    spark = vectors.sparkSession
    n = shuffle_partitions(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sound = rows.where(finite("v") & F.col("vec_id").isNotNull() & (F.size("v") > 0)).withColumn("norm", norm).where("norm > 0 and norm < double('inf')")
    # copies share one node, their smallest id
    nodes = sound.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("norm").alias("norm"))
    nodes = stored(nodes.select("node", "copies", F.size("v").alias("dim"), F.transform("v", lambda x: x / F.col("norm")).alias("v")), "nodes")
    hashed = nodes.mapInArrow(lambda b: hash_rows(b, tables, hashes, probes, seed), "node long, copies long, v array<double>, codes array<long>, dim int")
    hashed = stored(hashed, "codes")
    keys = hashed.select("dim", "node", F.explode("codes").alias("code"))
    crowded = keys.groupBy("dim", "code").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(crowded, ["dim", "code"]).withColumn("parts", F.ceil(F.col("n") / together).cast("int"))
    met = met.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "dim", "code", "node", "side", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"))
    met = met.join(hashed.drop("dim"), "node")
    order = ["dim", "code", "left", "right"]
    found = met.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(
        lambda b: compare(keyed_groups(b, order), cosine), "a long, b long, links long")
    found = stored(found, "links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("a != b").select("a", "b"), "vector-components")
    placed = nodes.select("node", "copies").join(links, "node", "left").join(roots, "node", "left")
    smallest = sound.groupBy("v").agg(F.min("vec_id").alias("node"))
    known = sound.select("vec_id", "v").join(smallest, "v").select("vec_id", "node").join(placed, "node")
    known = known.select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    # a null id meets no row of ``known``
    return rows.select("vec_id").join(known, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
