"""Best-fit packing into sequences of a fixed length, online and in bounded space.

Documents become token ids and are cut into pieces of at most one sequence. Each partition packs its pieces as they come: a
piece goes to the open sequence with the least free space that holds it; a fixed number of sequences stays open, found through
a bitset keyed by free space, and the fullest closes first.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import stored
from doclake.llm.pieces import SPACE_CLASS, PieceTable, classes, piece_texts, pieces, slices_of_points, worker_state
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)

LENGTH = 2048
OPEN = 1024
#: Code points that are cut into words at a time: arrays of several times that many numbers live meanwhile.
SLICE = 1 << 19
#: Tokens that one task packs; a partition wastes at most what its last open sequences have free.
TOKENS_A_TASK = 8_000_000
#: Tokens that a task hands on at a time.
TOKENS_TOGETHER = 1 << 20
#: Below it composition changes nothing and every letter but U+0130 has one lower-case letter.
SIMPLE = 0x300


def tokenizer_of(content: bytes):
    """(tokenizer, piece table) of a vocabulary, once a worker."""
    kept = worker_state()
    key = ("ids", hashlib.sha256(content).hexdigest())
    if key not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_buffer(content)
        made.encode_special_tokens = True  # their strings in a text are ordinary text
        kept[key] = (made, PieceTable())
    return kept[key]


def lower_table() -> np.ndarray:
    kept = worker_state()
    if "lower" not in kept:
        kept["lower"] = np.array([ord(chr(i).lower()) if i != 0x130 else i for i in range(SIMPLE)], dtype=np.uint32)
    return kept["lower"]


def word_ids(made, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    found = [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)]
    return [(np.array([len(x) for x in found], dtype=np.int64), np.array([i for x in found for i in x], dtype=np.uint32))]


def ids_of(texts: pa.Array, content: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of every text as the tokenizer gives them, null ones as empty.

    The tokenizer sees each different word once. Texts with characters from U+0300 on, where composing and lower-casing
    need more than a table, go to it as a whole.
    """
    made, table = tokenizer_of(content)
    lower = lower_table()
    for a, b, points, offsets in slices_of_points(texts, SLICE):
        hard = np.zeros(b - a, dtype=bool)
        odd = np.flatnonzero((points >= SIMPLE) | (points == 0x130))
        hard[np.searchsorted(offsets, odd, side="right") - 1] = True
        plain = lower[np.minimum(points, SIMPLE - 1)]
        keys, starts, ends, rows = pieces(plain, offsets, spaces_join=False, single_numbers=True)
        words = (classes()[plain[starts]] != SPACE_CLASS) & ~hard[rows]
        keys, starts, ends, rows = keys[words], starts[words], ends[words], rows[words]
        at = table.places(keys, lambda new: word_ids(made, piece_texts(plain, starts[new], ends[new])))
        counts, ids = table.take(0, at)
        first = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(rows, np.arange(b - a + 1))]
        for i in range(b - a):
            if hard[i]:
                yield a + i, np.array(made.encode(texts[a + i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            else:
                yield a + i, ids[first[i]: first[i + 1]]


def cut_rows(batches: Iterator[pa.RecordBatch], content: bytes, length: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of pieces, handed on whenever they hold ``TOKENS_TOGETHER``; ids stay arrays, never lists of objects."""
    names, kinds = ["piece", "start", "length", "ids_crc32"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def rows(batch: pa.RecordBatch, out: list[list], parts: list[np.ndarray]) -> pa.RecordBatch:
        columns = [batch.column("id").take(pa.array(out[0], pa.int64())), *[pa.array(x, t) for x, t in zip(out[1:], kinds)]]
        if with_ids:
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int64))))
        return pa.RecordBatch.from_arrays(columns, ["id", *names, *(["ids"] if with_ids else [])])

    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        parts, held = [], 0
        for row, ids in ids_of(batch.column("text"), content):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for k, at in enumerate(range(0, len(ids), length)):
                part = ids[at: at + length]
                for column, value in zip(out, (row, k, at, len(part), zlib.crc32(part.tobytes()))):
                    column.append(value)
                if with_ids:
                    parts.append(part)
                held += len(part)
                if held >= TOKENS_TOGETHER:
                    yield rows(batch, out, parts)
                    out, parts, held = [[], [], [], [], []], [], 0
        if held:
            yield rows(batch, out, parts)


class OpenBins:
    """At most ``most`` open bins of ``size``, found by free space through a bitset."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.bits, self.count, self.made = size, most, 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def take(self, free: int) -> int:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return got

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_, offset = self.take(free), self.size - free
        else:
            bin_, offset = self.made, 0
            free = self.size
            self.made += 1
        free -= length
        if free:
            if self.count == self.most:  # the fullest closes
                self.take((self.bits & -self.bits).bit_length() - 1)
            self.by_free.setdefault(free, []).append(bin_)
            self.bits |= 1 << free
            self.count += 1
        return bin_, offset


def pack_partition(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 40
    bins = OpenBins(length, most)
    for batch in batches:
        placed = [bins.put(n) for n in batch.column("length").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
            [*batch.schema.names, "sequence_id", "offset"])


def pack(docs: DataFrame, id: str, text: str, content: bytes, length: int = LENGTH, open_bins: int = OPEN, end_id: int = 0,
         tokens_a_task: int = TOKENS_A_TASK, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row a piece; ``with_ids`` adds ids.

    A document is its token ids and ``end_id``; null texts are empty and still have that one. Only documents longer than
    ``length`` are cut, into pieces of that length and a last shorter one. Pieces of a sequence fill it from 0 without
    gaps. Repeated rows are packed each; other columns are not read; an empty table gives no rows.

    ``content`` is a tokenizer file, which travels with the tasks. Tokenizing runs where the texts are read; only the
    rows of pieces are dealt out, to as many tasks as their tokens need, in an order that a repeated task meets again.
    """
    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    cut = stored(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        lambda b: cut_rows(b, content, length, end_id, with_ids), schema), "pieces")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, min(-(-total // tokens_a_task), total // (length * 4) or 1))
    dealt = cut.withColumn("_deal", F.xxhash64("id", "piece", "ids_crc32")).repartition(int(tasks), "_deal").sortWithinPartitions("_deal", "id", "piece")
    return dealt.drop("_deal").mapInArrow(lambda b: pack_partition(b, length, open_bins), schema + ", sequence_id long, offset long")
