"""Helpers shared by the operators of this subpackage: stored steps, batches of words as numbers, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.session import ship_with_tasks, work_dir

ship_with_tasks(__name__)

#: Bytes of text that one pass of array work starts from; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def stored(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: a lost executor never changes or repeats it.

    Writers and readers hold a row group of a file at once, which by itself ends at no fewer than 100 rows. Rows with large cells are
    written with ``group_bytes``: a row group ends there, after any row, however many of them a task makes.
    """
    folder = work_dir(df.sparkSession, name)
    after_any_row = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    (df.write.options(**after_any_row) if group_bytes else df.write).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def most_frequent(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows reach. Different counts are few: at most the root of twice the tokens."""
    rows = counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n"))
    least, taken = None, 0
    for row in rows.toLocalIterator():
        taken += row["k"]
        if taken > most:
            break
        least = row["n"]
    return least if least is not None else 1 << 62


def columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a result of bounded size."""
    got = df.select(*names).toArrow()
    return [got.column(n).to_numpy() for n in names]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has a column of that name in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(column: str) -> Column:
    """crc32 of the id as text; an id that is null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------------------------------------- words as numbers

_RANDOM = np.random.default_rng(20240607)
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of ``values``, which depend on their content alone.

    A span's polynomial is a difference of running sums, brought back to power zero by the inverse base.
    """
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(BASE, len(values)), out=total[1:])
        key = (total[ends] - total[starts]) * powers(BASE_INVERSE, len(values) + 1)[starts]
        return mix(key ^ mix((ends - starts).astype(np.uint64)))


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets into them) of whole texts, about ``most`` bytes at a time.

    Null texts have no bytes.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte, byte after the last) of every word, in order.

    Words are runs of bytes other than 20 and 09 to 0D, cut at row ends, with A-Z in lower case. Equal words have equal
    hashes; different ones differ but for a chance of about 2^-64 a pair.
    """
    n = len(data)
    low = LOWER[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets[(offsets < n)]] = True
    solid = ~SPACE[data]
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    with np.errstate(over="ignore"):
        key = span_hashes(BYTE_VALUES[low], starts, ends)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return key, rows, starts, ends


def keyed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``keys`` in rows that come sorted by them, whole across batch borders.

    Only for groups of bounded size.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        same = bool(waiting)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
            same = same and waiting[-1].column(k)[-1].as_py() == column[0]
        at = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for i, (a, b) in enumerate(zip(at, at[1:])):
            if i or not same:
                if waiting:
                    yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


# ------------------------------------------------------------------------------------------ connected components


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has an edge in ``edges`` (a, b).

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step hangs neighbours below a smaller
    node, a logarithmic number of rounds ends in stars. Minima are combined before they are shuffled; each step is a
    table in the shared folder. Only the number and the sum of edges reach the driver.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct(), name)

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    was = state(now)
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        # large star: neighbours above a node hang below the node's smallest neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: a node and its neighbours below it hang below the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(b.alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = stored(small.where("a != b").distinct(), name)
        new = state(now)
        if new == was:
            break
        was = new
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(a.alias("node"), b.alias("root")).union(now.select(b, b).distinct())
