"""N-gram Jaccard join by count vectors in R-trees.

A document is its set of distinct word shingles, hashed to numbers; equal sets are one class. Shingles are also hashed into
groups: the counts of a class's groups are a point, and two sets share at most the sum of the smaller coordinates. Points
lie in R-trees, one for each group of classes that share a shingle early in hash order; pairs that pass the bound are verified
on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import columns, connected_components, keyed_groups, mix, most_frequent, shuffle_partitions, stored, text_slices, word_hashes
from doclake.llm.pieces import gather
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)

#: Most classes and shingles of one bucket that a task compares with each other; larger buckets meet part by part.
TOGETHER = 1024
SHINGLES_TOGETHER = 6_000_000
LEAST_GROUPS, MOST_GROUPS = 64, 4096
#: Shingles counted together in a task; how many classes make a shingle a common one; most common ones that all tasks know.
COUNTED_TOGETHER, COMMON_FROM, COMMON = 4_000_000, 8, 1 << 18
#: 64-bit words of the filter that goes to all tasks.
FILTER_WORDS = 1 << 17
FANOUT = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct shingles of every row in rising order, row i's at ends[i]:ends[i + 1]."""
    keys, rows, _, _ = word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    rng = np.random.default_rng(71)
    odd = rng.integers(1, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        m = max(0, len(keys) - words + 1)
        total = np.zeros(m, dtype=np.uint64)
        for k in range(words):
            total += keys[k: k + m] * odd[k]
        whole = rows[:m] == rows[words - 1: words - 1 + m] if m else np.zeros(0, bool)
        hashes, of = mix(total[whole]), rows[:m][whole]
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):  # too few words: the whole sequence
            sums = np.array([(keys[first[r]: first[r] + count[r]] * odd[:count[r]]).sum() + np.uint64(count[r]) for r in short], dtype=np.uint64)
            hashes, of = np.concatenate([hashes, mix(sums ^ np.uint64(0xABCDEF))]), np.concatenate([of, short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(n + 1))


def class_keys(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number for a set, from a sum over its members."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5DEECE66D)))])
        return mix((total[ends[1:]] - total[ends[:-1]]) ^ mix(np.diff(ends).astype(np.uint64))).view(np.int64)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Two sets that link share a member among so many of the first of each, in any one order of all members."""
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


def first_here(key: np.ndarray, size: np.ndarray, seen: set[int]) -> np.ndarray:
    """True for classes that this task meets for the first time; empty sets are none."""
    out = np.zeros(len(key), dtype=bool)
    for i in np.flatnonzero(size):
        out[i] = (c := int(key[i])) not in seen
        seen.add(c)
    return out


def group_count(sizes: np.ndarray) -> np.ndarray:
    """Groups for sets of these sizes: about one for eight members, in powers of two.

    Fewer would bound the overlap of long unrelated texts too loosely. Sets that can link differ by one power at most.
    """
    return np.minimum(np.maximum(2 ** np.ceil(np.log2(np.maximum(sizes, 1) / 8)), LEAST_GROUPS), MOST_GROUPS).astype(np.int64)


def count_vectors(hashes: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> list[bytes | None]:
    """How many members of each set fall in each of its groups, as 32-bit numbers."""
    spread = mix(hashes ^ np.uint64(99)).astype(np.int64) & (MOST_GROUPS - 1)
    groups = group_count(np.diff(ends))
    return [np.bincount(spread[a:b] & (g - 1), minlength=g).astype("<u4").tobytes() if k else None
            for a, b, g, k in zip(ends[:-1].tolist(), ends[1:].tolist(), groups.tolist(), keep)]


def fold(points: np.ndarray) -> np.ndarray:
    """The same counts in half as many groups."""
    half = points.shape[-1] // 2
    return points[..., :half] + points[..., half:]


def describe(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Size and class of every row; the count vector where the class is new to this task."""
    seen: set[int] = set()
    for batch in batches:
        for a, b, data, offsets in text_slices(batch.column("text")):
            hashes, ends = shingle_sets(data, offsets, words)
            size, key = np.diff(ends), class_keys(hashes, ends)
            new = first_here(key, size, seen)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(a, b - a), pa.array(size, pa.int64()), pa.array(key, pa.int64(), mask=size == 0),
                 pa.array(count_vectors(hashes, ends, new), pa.binary())], ["id", "n", "cls", "counts"])


def repeated_shingles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(h, n): shingles that several classes of this task have, counted among a bounded number of them at a time."""
    seen: set[int] = set()
    waiting: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], ["h", "n"])

    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column("text")):
            hashes, ends = shingle_sets(data, offsets, words)
            size, key = np.diff(ends), class_keys(hashes, ends)
            waiting.append(hashes[np.repeat(first_here(key, size, seen), size)])
            if sum(map(len, waiting)) > COUNTED_TOGETHER:
                yield counted()
                waiting = []
    if waiting:
        yield counted()


def common_shingles(texts: DataFrame, words: int, most: int = COMMON) -> np.ndarray:
    """The shingles that most classes have, at most ``most``, sorted. They come last in the order of shingles.

    Any order gives the same links; with passages that many texts share at its end, texts meet by what is their own.
    """
    counts = stored(texts.mapInArrow(lambda b: repeated_shingles(b, words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_FROM), "repeated-shingles")
    least = most_frequent(counts, most)
    return np.sort(columns(counts.where(F.col("n") >= least), "h")[0].view(np.uint64))


def early_shingles(batches: Iterator[pa.RecordBatch], words: int, percent: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h, cls) for the prefix of every class that is new to this task: ``common`` shingles last, else in hash order."""
    seen: set[int] = set()
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column("text")):
            hashes, ends = shingle_sets(data, offsets, words)
            size, key = np.diff(ends), class_keys(hashes, ends)
            length = np.where(first_here(key, size, seen), prefix_length(size, percent), 0)
            if len(common):
                last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
                hashes = hashes[np.argsort(np.repeat(np.arange(len(size)), size) * 2 + last, kind="stable")]
            yield pa.RecordBatch.from_arrays([pa.array(gather(hashes, ends[:-1], length).view(np.int64)), pa.array(np.repeat(key, length))], ["h", "cls"])


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, cls), those whose h has different classes, once each. Holds one row between batches."""
    last, last_shared = None, False  # the last distinct row, and whether it was already given out

    for batch in batches:
        h, c = batch.column("h").to_numpy(), batch.column("cls").to_numpy()
        if last is not None:
            h, c = np.concatenate([[last[0]], h]), np.concatenate([[last[1]], c])
        if not len(h):
            continue
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, c = h[new], c[new]
        same = h[1:] == h[:-1]
        keep = np.zeros(len(h), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        out = keep.copy()
        if last is not None and last_shared:
            out[0] = False
        last, last_shared = (h[-1], c[-1]), bool(keep[-1] or (len(h) == 1 and last_shared))
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[out], pa.int64()), pa.array(c[out], pa.int64())], ["h", "cls"])


def set_rows(batches: Iterator[pa.RecordBatch], words: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole sets of the classes that ``wanted`` may hold, once a task."""
    seen: set[int] = set()
    for batch in batches:
        for a, b, data, offsets in text_slices(batch.column("text")):
            hashes, ends = shingle_sets(data, offsets, words)
            size, key = np.diff(ends), class_keys(hashes, ends)
            keep = may_hold(wanted, key)
            keep[keep] = first_here(key[keep], size[keep], seen)
            length = np.where(keep, size, 0)
            at = np.concatenate([[0], np.cumsum(length)])[np.append(keep, True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[keep]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(gather(hashes, ends[:-1], length).view(np.int64)))], ["cls", "members"])


def may_hold(wanted: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = mix(key.view(np.uint64)) % np.uint64(len(wanted) * 64)
    return (wanted[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def bits_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(mix(batch.column("cls").to_numpy().view(np.uint64)) % np.uint64(words * 64))
        yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])


def wanted_filter(classes: DataFrame, words: int = FILTER_WORDS) -> np.ndarray:
    """A Bloom filter of fixed size that keeps other classes' sets from being shuffled.

    When it fills up more sets are shuffled than needed; the join with the classes decides in any case.
    """
    found = classes.select("cls").mapInArrow(lambda b: bits_of(b, words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(words, dtype=np.int64)
    for row in found.toLocalIterator():
        out[row["word"]] = row["bits"]
    return out.view(np.uint64)


class CountTree:
    """R-tree over count vectors, packed by size and then by the coordinate that varies most."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slab = FANOUT * FANOUT
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), slab):
            part = order[at: at + slab]
            order[at: at + slab] = part[np.argsort(points[part, points[part].var(axis=0).argmax()], kind="stable")]
        self.order = order
        # level 0 holds the points, each level above the upper corners and size ranges of its boxes
        self.levels = [(points[order], sizes[order], sizes[order])]
        while len(self.levels[-1][0]) > FANOUT:
            high, small, large = self.levels[-1]
            at = np.arange(0, len(high), FANOUT)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points that may share enough with ``point``: 100 * shared >= percent * (both sizes - shared)."""
        at = np.arange(len(self.levels[-1][0]))
        for level, (high, small, large) in reversed(list(enumerate(self.levels))):
            fits = (100 * large[at] >= percent * size) & (percent * small[at] <= 100 * size)
            at = at[fits]
            shared = np.minimum(high[at], point).sum(axis=1)
            at = at[(100 + percent) * shared >= percent * (size + small[at])]
            if level:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[level - 1][0])]
        return self.order[at]


def partners(g: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows that may link with it) of a bucket part; each pair once."""
    side, left, right = g.column("side").to_numpy(), g.column("left")[0].as_py(), g.column("right")[0].as_py()
    sizes = g.column("n").to_numpy()
    rows = [np.frombuffer(c, "<u4").astype(np.int64) for c in g.column("counts").to_pylist()]
    groups = np.array([len(r) for r in rows])
    trees = {}
    for n in np.unique(groups).tolist():
        of = np.flatnonzero(groups == n)
        trees[n] = (of, CountTree(np.stack([rows[i] for i in of]), sizes[of]))
    for i, point in enumerate(rows):
        found = []
        if left == right or side[i] == left:
            of, tree = trees[len(point)]
            near = of[tree.search(point, int(sizes[i]), percent)]
            found.append(near[near < i] if left == right else near[side[near] == right])
        if len(point) // 2 in trees:
            of, tree = trees[len(point) // 2]
            near = of[tree.search(fold(point), int(sizes[i]), percent)]
            found.append(near if left == right else near[side[near] != side[i]])
        near = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(near):
            yield i, near


def bucket_forest(groups: Iterator[pa.Table], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges that join the classes of each bucket part that may link."""
    out: tuple[list, list] = ([], [])
    for g in groups:
        if g.num_rows < 2:
            continue
        cls = g.column("cls").to_numpy()
        roots = Roots(cls)
        for i, near in partners(g, percent):
            for j in near[np.unique(roots.root[near], return_index=True)[1]]:
                if roots.join(i, int(j)):
                    out[0].append(cls[i])
                    out[1].append(cls[j])
        if len(out[0]) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
            out = ([], [])
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on rising arrays of distinct members."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class Roots:
    """Union-find over numbers 0 to n - 1; labels that are equal at the start are joined."""

    def __init__(self, labels: np.ndarray):
        _, first, where = np.unique(labels, return_index=True, return_inverse=True)
        self.root = first[where]

    def join(self, i: int, j: int) -> bool:
        a, b = self.root[i], self.root[j]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)
        return a != b


def bucket_edges(groups: Iterator[pa.Table], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges that join all linked classes of each bucket part; pairs that are joined already are not verified."""
    out: tuple[list, list] = ([], [])
    for g in groups:
        if g.num_rows < 2:
            continue
        cls = g.column("cls").to_numpy()
        members = [m.values.to_numpy().view(np.uint64) for c in g.column("members").chunks for m in c]
        roots = Roots(cls)
        for i, near in partners(g, percent):
            near = near[roots.root[near] != roots.root[i]]
            while len(near):
                j = int(near[0])
                if links(members[i], members[j], percent):
                    roots.join(i, j)
                    out[0].append(cls[i])
                    out[1].append(cls[j])
                    near = near[roots.root[near] != roots.root[i]]
                else:
                    near = near[1:]
        if len(out[0]) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
            out = ([], [])
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def in_parts(rows: DataFrame, together: int, most: int | None = None) -> DataFrame:
    """Rows (h, cls, ...) once for each part of their bucket h that they meet; buckets of one row go.

    A part has about ``together`` rows and, where rows have sizes n, ``most`` members.
    """
    parts = F.ceil(F.count("*") / together)
    if most:
        parts = F.greatest(parts, F.least(F.count("*"), F.ceil(F.sum("n") / most)))
    size = rows.groupBy("h").agg(F.count("*").alias("m"), parts.cast("int").alias("parts")).where("m > 1").drop("m")
    met = rows.join(size, "h").withColumn("side", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    return met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn(
        "left", F.least("side", "other")).withColumn("right", F.greatest("side", "other")).drop("parts", "other")


def jaccard_components(docs: DataFrame, id: str, text: str, percent: int = 80, words: int = 5,
                       together: int = TOGETHER, shingles_together: int = SHINGLES_TOGETHER) -> DataFrame:
    """(id, n_shingles, component_id): one row for every row of ``docs``.

    Rows link when ``100 * shared >= percent * union`` of their distinct ``words``-word shingles (A-Z in lower case; words
    are runs of characters other than space and 09 to 0D); fewer words are one shingle, none link with nothing.
    ``component_id`` is the smallest id reachable, nulls last. Repeated rows and equal texts are one class and never
    become pairs. Rows without words keep their own id. Other columns are not read; an empty table gives no rows.

    Every linked pair shares a shingle among the first of both in one order of all shingles: the buckets. Those with the same classes are
    one. In the tree of each bucket those pairs are found that may link; what such pairs connect is a cluster, to which
    every class takes its whole set once. There, again by a tree, pairs that are not yet connected by links are
    verified. Buckets and clusters above ``together`` meet in parts, so that no link is lost.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    texts = source.select("text")
    order = ["h", "left", "right"]

    def grouped(met: DataFrame) -> DataFrame:
        return met.repartition(n, *order).sortWithinPartitions(*order)

    def sets_of(classes: DataFrame) -> DataFrame:
        wanted = wanted_filter(classes)
        return texts.mapInArrow(lambda b: set_rows(b, words, wanted), "cls long, members array<long>").dropDuplicates(["cls"])

    rows = stored(source.mapInArrow(lambda b: describe(b, words), "id long, n long, cls long, counts binary"), "shingle-rows")
    common = common_shingles(texts, words)
    postings = texts.mapInArrow(lambda b: early_shingles(b, words, percent, common), "h long, cls long")
    shared = stored(postings.repartition(n, "h").sortWithinPartitions("h", "cls").mapInArrow(shared_only, "h long, cls long"), "shared-shingles")
    # of shingles with the same classes the first will do
    alike = shared.groupBy("h").agg(F.count("*").alias("m"), *[F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"x{i}") for i in (1, 2)])
    shared = shared.join(alike.groupBy("m", "x1", "x2").agg(F.min("h").alias("h")).select("h"), "h")
    vectors = rows.where("counts is not null").select("cls", "n", "counts").dropDuplicates(["cls"])
    met = grouped(in_parts(shared, together).join(vectors, "cls"))
    close = stored(met.mapInArrow(lambda b: bucket_forest(keyed_groups(b, order), percent), "a long, b long"), "close-classes")
    clusters = stored(connected_components(close, "clusters").select(F.col("node").alias("cls"), F.col("root").alias("h")), "clusters")
    met = in_parts(clusters.join(vectors, "cls"), together, shingles_together).join(sets_of(clusters), "cls")
    edges = stored(grouped(met).mapInArrow(lambda b: bucket_edges(keyed_groups(b, order), percent), "a long, b long"), "shingle-edges")
    linked = connected_components(edges, "components")
    # the smallest id of a component, by way of its classes
    ids = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"))
    of = ids.join(linked.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    known = of.join(least, "root").select("cls", "component_id")
    return rows.select("id", "n", "cls").join(known, "cls", "left").select(
        F.col("id"), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
