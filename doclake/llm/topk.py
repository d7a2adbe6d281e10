"""Exact top-k inner products by columnar branch and bound.

Vectors lie in blocks of bounded size. For one query and one block, inner products grow dimension block by dimension block
over columns; what the remaining dimensions can still add is at most the product of the two remaining norms. Candidates
whose upper bound falls below the k-th best lower bound are compacted away before the next columns are touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.common import shuffle_partitions
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)

CANDIDATES = 8192
QUERIES = 512
COLUMNS = 8


def finite(vector: str) -> Column:
    """True for arrays without null, NaN or infinite components."""
    c = F.col(vector)
    return c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def remaining_norms(vertical: np.ndarray, width: int) -> np.ndarray:
    """Row j: the norm of every vector's components from column j * width on, rounded up."""
    squares = vertical.astype(np.float64) ** 2
    steps = range(0, len(vertical), width)
    tail = np.zeros((len(steps) + 1, vertical.shape[1]))
    for j, at in reversed(list(enumerate(steps))):
        tail[j] = tail[j + 1] + squares[at: at + width].sum(axis=0)
    return np.sqrt(tail) * (1 + 1e-9) + 1e-9


def best(query: np.ndarray, query_norms: np.ndarray, vertical: np.ndarray, norms: np.ndarray, ids: np.ndarray, own: int | None, k: int, width: int):
    """Positions and exact scores of the k best columns of ``vertical`` (dimensions x candidates), ties to smaller ids."""
    alive = np.flatnonzero(ids != own) if own is not None else np.arange(len(ids))
    score = np.zeros(len(alive), dtype=np.int64)
    for j, at in enumerate(range(0, len(query), width)):
        part = vertical[at: at + width]
        part = part[:, alive] if len(alive) < part.shape[1] else part
        score = score + query[at: at + width] @ part
        if len(alive) > k:
            slack = query_norms[j + 1] * norms[j + 1][alive]
            low = score - slack
            keep = score + slack >= np.partition(low, len(low) - k)[len(low) - k]
            if keep.sum() < 0.9 * len(keep):
                alive, score = alive[keep], score[keep]
    order = np.lexsort((ids[alive], -score))[:k]
    return alive[order], score[order]


def matrix(ids: list, vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """One vector an id, the smallest where an id repeats; as dimensions x vectors."""
    ids = np.asarray(ids, dtype=np.int64)
    table = np.asarray(vectors, dtype=np.int64).reshape(len(ids), -1)
    order = np.lexsort((*table.T[::-1], ids))
    order = order[np.r_[True, np.diff(ids[order]) != 0]] if len(order) else order
    return ids[order], np.ascontiguousarray(table[order].T)


def search_blocks(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    held, block = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            if held != (now := (row["dim"].as_py(), row["block"].as_py())):
                ids, columns = matrix(row["ids"].values.to_numpy(), row["flat"].values.to_numpy())
                held, block = now, (ids, columns, remaining_norms(columns, width))
            queries, values = matrix(row["query_ids"].values.to_numpy(), row["query_flat"].values.to_numpy())
            query_norms = remaining_norms(values, width)
            out: list[list] = [[], [], []]
            for q in range(len(queries)):
                at, score = best(values[:, q], query_norms[:, q], block[1], block[2], block[0], queries[q], k, width)
                out[0].append(np.full(len(at), queries[q]))
                out[1].append(block[0][at])
                out[2].append(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, vec_id: str, vector: str, queries: Column, k: int = 10, scale: float = 1024.0,
          candidates: int = CANDIDATES, queries_at_once: int = QUERIES, columns: int = COLUMNS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row for which ``queries`` holds, its ``k`` best other rows.

    Components become ``floor(scale * x)`` in double precision; scores are exact inner products in 64-bit integers.
    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Vectors are
    compared with those of as many dimensions. Rows that repeat an id are one vector, the smallest; ties of scores go
    to the smaller id. An empty table gives no rows; other columns are not read.

    Every query meets every candidate, in blocks: queries travel in packs of about ``queries_at_once`` to each block of
    about ``candidates`` vectors, whose rows move once. Both sizes are fixed, their number grows with the table.
    """
    spark = vectors.sparkSession
    rows = vectors.where(finite(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("is_query"), F.size(vector).alias("dim"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")).where("dim > 0")
    total, asked = rows.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, packs = -(-total // candidates) or 1, -(-asked // queries_at_once) or 1

    def packed(df: DataFrame, key: str, n: int, salt: int, ids: str, flat: str) -> DataFrame:
        df = df.withColumn(key, F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int"))
        return df.groupBy("dim", key).agg(F.collect_list(F.struct("vec_id", "v")).alias("all")).select(
            "dim", key, F.col("all.vec_id").alias(ids), F.flatten("all.v").alias(flat))

    cand = packed(rows, "block", blocks, 1, "ids", "flat")
    asks = packed(rows.where("is_query"), "pack", packs, 2, "query_ids", "query_flat")
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("pack")
    met = cand.repartition(shuffle_partitions(spark), "dim", "block").join(asks, ["dim", "block"])
    found = met.mapInArrow(lambda b: search_blocks(b, k, columns), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
