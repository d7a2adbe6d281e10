"""Language-model scores by Katz backoff of order three over all words.

A token after two others (texts start with two START) has its Good-Turing discounted share where the three were seen in
training; else the backoff weight of its context times its share after one token, found in the same way; else that of its
add-one share without context. No word or n-gram is left out.

N-grams travel in packs: all different n-grams of many texts that belong to one part, sorted, as compressed columns. The part
is that of the middle word, so a part holds every n-gram of three and of two that a token's recursion needs. A word that very many
tokens have is split over parts by the word after it, and a pair that very many have by the word before it as well; what is known of
such contexts and pairs is put together in tables. Frequent words stand in packs as small numbers, all others as 64-bit hashes. Packs are
dealt out twice: for the counts of counts that the discounts need, and to be scored; a part answers with one sum for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclake.llm.common import columns, mix, most_frequent, stored
from doclake.llm.katz import END_KEY, TEXTS_TOGETHER, TRUSTED, discounts, token_batches
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)

#: Words that have small numbers in packs: the most frequent ones, 1 MB of hashes for each 131,072. Decides sizes, no counts.
NUMBERED = 1 << 20
#: Tokens that a part is made for. Words and pairs with more, or with this part of all tokens, are split; pairs are looked for in a
#: sample of the texts. This decides where rows meet, not what they count.
TOKENS_A_PART, HEAVY, SAMPLE = 1_500_000, 8, 0.02
#: N-grams of a part that are scored together; decides memory only.
GRAMS_TOGETHER = 1 << 18
#: Different words that a task counts together.
WORDS_TOGETHER = 1_000_000
START = 0
TEXT, SUMS, WORD = 0, 1, 2
MIDDLE, FOLLOWER, HISTOGRAM, CONTEXT = 0, 1, 2, 3


@dataclass(frozen=True)
class Words:
    """What goes to all tasks: hashes, sorted, and counts of the numbered words; the heavy words and pairs with the parts they are split over.

    Sizes are bounded by ``NUMBERED`` and, for pairs, by twice the number of parts and ``HEAVY``.
    """

    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    heavy: np.ndarray
    splits: np.ndarray
    parts: int
    every: float
    pair_keys: np.ndarray
    pair_splits: np.ndarray
    pair_counts: np.ndarray

    def codes(self, keys: np.ndarray, find=None) -> np.ndarray:
        """Numbers from 1 on of frequent words, negative hashes of others; ``find`` is ``finder(hashes)`` where there are many to come."""
        at, found = find(keys) if find else lookup(self.hashes, keys)
        return np.where(found, self.numbers[at].astype(np.int64) if len(self.numbers) else 0, rare_codes(keys))

    def part(self, one: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Where the n-grams x, one, w meet."""
        place = mix(one.view(np.uint64))
        with np.errstate(over="ignore"):
            at, heavy = lookup(self.heavy, one)
            if heavy.any():
                place[heavy] += mix(w[heavy].view(np.uint64)) % self.splits[at[heavy]].astype(np.uint64) + np.uint64(1)
            at, heavy = lookup(self.pair_keys, pair_key(one, w)) if len(self.pair_keys) else (None, np.zeros(0, bool))
            if heavy.any():
                place[heavy] += (mix(x[heavy].view(np.uint64)) % self.pair_splits[at[heavy]].astype(np.uint64) + np.uint64(1)) << np.uint64(32)
            return (mix(place) % np.uint64(self.parts)).astype(np.int64)


def lookup(values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) in sorted values."""
    at = np.minimum(np.searchsorted(values, asked), max(0, len(values) - 1))
    return at, (values[at] == asked if len(values) else np.zeros(len(asked), bool))


def finder(values: np.ndarray):
    """``lookup`` in sorted hashes by a table of their leading bits: hashes are even, so a search ends after a few steps."""
    if not len(values):
        return lambda asked: lookup(values, asked)
    shift, last = np.uint64(64 - len(values).bit_length()), len(values) - 1
    starts = np.searchsorted(values, np.arange(1 << len(values).bit_length(), dtype=np.uint64) << shift)

    def find(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(starts[(asked >> shift).astype(np.int64)], last)
        low = np.flatnonzero(values[at] < asked)
        while len(low):
            low = low[at[low] < last]
            at[low] += 1
            low = low[values[at[low]] < asked[low]]
        return at, values[at] == asked

    return find


def pair_key(one: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(one.view(np.uint64) ^ np.uint64(0x50414952)) + w.view(np.uint64))


def rare_codes(keys: np.ndarray) -> np.ndarray:
    return (keys | np.uint64(1 << 63)).view(np.int64)


# ---------------------------------------------------------------------------------------------- packs


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2^32 by byte place, and negative ones apart."""
    out = [np.array([len(columns[0])], "<i8").tobytes()]
    for c in columns:
        big = c[c < 0]
        small = np.where(c < 0, 0xFFFFFFFF, c).astype("<u4")
        out += [np.array([len(big)], "<i8").tobytes(), big.astype("<i8").tobytes(), *((small >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(4))]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for _ in range(columns):
        more = int(np.frombuffer(data, "<i8", 1, at)[0])
        big = np.frombuffer(data, "<i8", more, at + 8)
        at += 8 + 8 * more
        c = np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)
        at += 4 * n
        c[c == 0xFFFFFFFF] = big
        out.append(c)
    return out


def before(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The token before each one in its text, or START."""
    out = np.full_like(x, START)
    same = rows[1:] == rows[:-1]
    out[1:][same] = x[:-1][same]
    return out


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def spread(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """One value a run, for every row of it."""
    return np.repeat(values, np.diff(np.append(first, n)))


BITS = 21


def joint(small: int, *columns: np.ndarray) -> np.ndarray | None:
    """Up to three columns of codes as one column in the same order: numbers as they are, hashes by their rank among those here; None if they are too many.

    ``small`` is above all numbers.
    """
    some = np.unique(np.concatenate([c[c < 0] for c in columns]).view(np.uint64)) if any((c < 0).any() for c in columns) else np.zeros(0, np.uint64)
    if small + len(some) >= 1 << BITS:
        return None
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        k, rare = c.copy(), c < 0
        k[rare] = small + np.searchsorted(some, c[rare].view(np.uint64))
        out = out << BITS | k
    return out


def in_order(small: int, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where runs of equal rows begin in it); rows that are equal keep their order, and codes that are hashes come last."""
    key = joint(small, *columns)
    if key is None:
        order = np.lexsort([c.view(np.uint64) for c in columns[::-1]])
        return order, runs(*(c[order] for c in columns))
    order = np.argsort(key, kind="stable")
    return order, runs(key[order])


def gram_packs(code: np.ndarray, rows: np.ndarray, train: np.ndarray, words: Words, places: bool) -> Iterator[tuple[int, bytes]]:
    """(part, pack) of all n-grams of three: columns one, x, w, training count, with ``places`` how many texts, which and how often."""
    one = before(code, rows)
    x = before(one, rows)
    part = words.part(one, x, code)
    order, first = in_order(len(words.counts), one, x, code)
    # runs of equal n-grams, dealt to their parts
    size = np.diff(np.append(first, len(order)))
    by_part = np.argsort(part[order[first]].astype(np.uint16 if words.parts < 1 << 16 else np.int64), kind="stable")
    first, size = first[by_part], size[by_part]
    order = order[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(order))]
    first = np.cumsum(size) - size
    at, rows = order[first], rows[order]  # texts come in order inside a run
    one, x, code, part = one[at], x[at], code[at], part[at]
    n = totals(train[rows].astype(np.int64), first)
    edges = np.searchsorted(part, np.arange(words.parts + 1))
    if places:
        spot = np.ones(len(rows), bool)  # a text once for each n-gram
        spot[1:] = rows[1:] != rows[:-1]
        spot[first] = True
        spot = np.flatnonzero(spot)
        times = np.diff(np.append(spot, len(rows)))
        of = np.searchsorted(spot, np.append(first, len(rows)))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[p], edges[p + 1]
        data = packed(one[a:b], x[a:b], code[a:b], n[a:b])
        if places:
            s, e = of[a], of[b]
            data = b"".join(len(y).to_bytes(4, "little") + y for y in (data, packed(np.diff(of[a: b + 1])), packed(rows[spot[s:e]], times[s:e])))
        yield p, data


def word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n): training counts of the different words of many texts at a time; without a word all tokens."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    tokens = 0

    def out():
        every, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        n = np.bincount(back, np.concatenate([h[1] for h in held]), len(every)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(every.view(np.int64)), pa.nulls(1, pa.int64())]), pa.array(np.append(n, tokens), pa.int64())], ["w", "n"])

    for table, keys, rows in token_batches(batches, False):
        train = table.column("train").to_numpy(zero_copy_only=False)
        held.append(np.unique(keys[train[rows]], return_counts=True))
        tokens += len(keys)
        if sum(len(h[0]) for h in held) > WORDS_TOGETHER:
            yield out()
            held, tokens = [], 0
    if held:
        yield out()


def sampled_pairs(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
    """(one, w, n) of pairs that begin with a heavy word."""
    for _, keys, rows in token_batches(batches, False):
        w = words.codes(keys)
        one = before(w, rows)
        heavy = lookup(words.heavy, one)[1]
        one, w = one[heavy], w[heavy]
        order = np.lexsort((w, one))
        first = runs(one[order], w[order])
        yield pa.RecordBatch.from_arrays([pa.array(one[order][first]), pa.array(w[order][first]), pa.array(np.diff(np.append(first, len(one))), pa.int64())], ["one", "w", "n"])


def counted_pairs(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
    """(place, n): training counts of the heavy pairs."""
    for table, keys, rows in token_batches(batches, False):
        train = table.column("train").to_numpy(zero_copy_only=False)[rows]
        w = words.codes(keys)
        at, found = lookup(words.pair_keys, pair_key(before(w, rows), w))
        place, n = np.unique(at[found & train], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(n, pa.int64())], ["place", "n"])


def deal_types(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
    find = finder(words.hashes)
    for table, keys, rows in token_batches(batches, False):
        train = table.column("train").to_numpy(zero_copy_only=False)
        for part, data in gram_packs(words.codes(keys, find), rows, train, words, False):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([data], pa.binary())], ["part", "pack"])


def deal_scored(batches: Iterator[pa.RecordBatch], words: Words, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Packs with places, and one row for every batch with its texts and what the words alone say of them."""
    task, find = TaskContext.get().partitionId(), finder(words.hashes)

    def row(**given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(1, f.type) if given.get(f.name) is None else given[f.name] if isinstance(given[f.name], pa.Array) else pa.array([given[f.name]], f.type) for f in schema], schema=schema)

    for number, (table, keys, rows) in enumerate(token_batches(batches, False)):
        batch, n = task << 32 | number, table.num_rows
        train = table.column("train").to_numpy(zero_copy_only=False)
        code = words.codes(keys, find)
        numbered = code > 0
        count = words.counts[code[numbered]]
        ids = table.column("id").combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
        yield row(part=int(mix(np.array([batch], np.uint64))[0] % np.uint64(words.parts)), kind=TEXT, batch=batch, ids=one(ids), train=one(train), n_tokens=one(np.bincount(rows, minlength=n).astype(np.int64)),
                  place=one(np.arange(n, dtype=np.int32)), base=one(np.bincount(rows[numbered], np.log10((count + 1) / words.every), n).astype(np.float64)),
                  known=one(np.bincount(rows[numbered], count > 0, n).astype(np.int64)))
        # other words travel with the texts that they are in, to a part of their own choice
        w, r = code[~numbered], rows[~numbered]
        part = (mix(w.view(np.uint64)) % np.uint64(words.parts)).astype(np.int64)
        order = np.lexsort((r, w, part))
        w, r, part = w[order], r[order], part[order]
        edges = np.searchsorted(part, np.arange(words.parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[p], edges[p + 1]
            first = runs(w[a:b], r[a:b])
            yield row(part=p, kind=WORD, batch=batch, pack=packed(w[a:b][first], r[a:b][first], np.diff(np.append(first, b - a)), train[r[a:b][first]].astype(np.int64)))
        for part_, data in gram_packs(code, rows, train, words, True):
            yield row(part=part_, kind=SUMS, batch=batch, pack=data)


# ---------------------------------------------------------------------------------------------- parts


def merged(one: np.ndarray, x: np.ndarray, w: np.ndarray, n: np.ndarray, small: int) -> tuple[np.ndarray, ...]:
    """N-grams of three of several packs as one sorted table; and where each row of the packs went."""
    order, first = in_order(small, one, x, w)
    where = np.empty(len(order), np.int32)
    where[order] = spread(np.arange(len(first), dtype=np.int32), first, len(order))
    at = order[first]
    return one[at], x[at], w[at], totals(n[order], first), where


def pairs_of(one: np.ndarray, w: np.ndarray, n: np.ndarray, small: int) -> tuple[np.ndarray, ...]:
    """Pairs of a part's n-grams with their counts, sorted; and the pair of every n-gram."""
    order, first = in_order(small, one, w)
    where = np.empty(len(order), np.int32)
    where[order] = spread(np.arange(len(first), dtype=np.int32), first, len(order))
    at = order[first]
    return one[at], w[at], totals(n[order], first), where


def columns_of(packs: list[bytes], number: int) -> list[np.ndarray]:
    """Columns of packs one after the other; each pack is unpacked once and let go."""
    parts = [[] for _ in range(number)]
    for data in packs:
        for column, values in zip(parts, unpacked(data, number)):
            column.append(values)
    return [np.concatenate(parts.pop(0)) for _ in range(number)]


TYPES = "kind byte, part long, one long, x long, " + ", ".join(f"v{k} long" for k in range(12))


def pair_counts(one: np.ndarray, w: np.ndarray, n: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a part's pairs, those of heavy ones from all parts; and which are heavy."""
    if not len(words.pair_keys):
        return n, np.zeros(len(n), bool)
    at, heavy = lookup(words.pair_keys, pair_key(one, w))
    return np.where(heavy, words.pair_counts[at], n), heavy


def by_count(n: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of every run how many of its counts are 1, 2, …"""
    return [totals((n == r).astype(np.int64), first) for r in range(1, TRUSTED + 1)]


def count_types(key, packs: pa.Table, words: Words) -> pa.Table:
    """Of one part: how many n-grams have each small count; what it has of heavy words and of the contexts that end with them; followers without numbers."""
    small = len(words.counts)
    one, x, w, n, _ = merged(*columns_of(packs.column("pack").to_pylist(), 4), small)
    p1, pw, pn, pair = pairs_of(one, w, n, small)
    pn, pair_heavy = pair_counts(p1, pw, pn, words)
    out = []

    def rows(kind: int, one, x=None, *values):
        zero = np.zeros(len(one), np.int64)
        given = [np.full(len(one), key[0].as_py(), np.int64), one, zero if x is None else x, *values, *[zero] * (12 - len(values))]
        out.append(pa.table([pa.array(np.full(len(one), kind), pa.int8()), *[pa.array(v, pa.int64()) for v in given]], ["kind", "part", "one", "x", *[f"v{k}" for k in range(12)]]))

    rows(HISTOGRAM, np.arange(1, TRUSTED + 2), None, *(np.bincount(c[(c > 0) & (c <= TRUSTED + 1)], minlength=TRUSTED + 2)[1:] for c in (n, pn[~pair_heavy])))
    seen = pn > 0
    rare = seen & (pw < 0)
    rows(FOLLOWER, p1[rare], pw[rare])
    # heavy words: their pairs but for the heavy ones, which are counted apart
    some = seen & lookup(words.heavy, p1)[1] & ~pair_heavy
    f = runs(p1[some])
    count1 = np.where(pw[some] > 0, words.counts[np.maximum(pw[some], 0)] + 1, 0)
    rows(MIDDLE, p1[some][f], None, totals(pn[some], f), *by_count(pn[some], f), totals(count1, f))
    # contexts that end with a heavy word: what this part has of them
    some = lookup(words.heavy, one)[1]
    one, x, n, follows = one[some], x[some], n[some], np.where(n[some] > 0, pn[pair[some]], 0)
    f = runs(one, x)
    rows(CONTEXT, one[f], x[f], totals(n, f), *by_count(n, f), totals(np.where(follows > TRUSTED, follows, 0), f), *by_count(follows, f))
    return pa.concat_tables(out)


@dataclass(frozen=True)
class Discounts:
    """Factors by count, of pairs and of n-grams of three; base and weight of the heavy words, in their order."""

    two: np.ndarray
    three: np.ndarray
    heavy_base: np.ndarray
    heavy_weight: np.ndarray


def kept(n: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Discounted counts; 0 for 0."""
    return n * factor[np.minimum(n, TRUSTED + 1)]


def based(c: np.ndarray, k: np.ndarray) -> np.ndarray:
    """What shares are parts of: a context without small counts keeps one more count for what did not follow it."""
    return np.where(c - k < 1e-9 * c, c + 1.0, c.astype(np.float64))


def score_part(key, asked: pa.Table, known: pa.Table, words: Words, d: Discounts, schema: pa.Schema) -> pa.Table:
    """Of one part: for every batch the sums over its texts of what this part knows; rows of texts go through.

    ``known`` has, for words in the middle, the sum of shares of followers without numbers, and base and weight of contexts that end with heavy ones.
    """
    kind = asked.column("kind").to_numpy()
    through = asked.filter(pa.array(kind == TEXT)).drop(["pack", "part"])
    out = [through.select([f.name for f in schema])] if len(through) else []

    def answer(batch: int, place: np.ndarray, score=None, base=None, seen=None, w=None):
        if len(place):
            one = lambda v, t: pa.nulls(1, pa.list_(t)) if v is None else pa.array([v], pa.list_(t))
            given = {"kind": pa.array([SUMS if w is None else WORD], pa.int8()), "batch": pa.array([batch], pa.int64()), "place": one(place.astype(np.int32), pa.int32()),
                     "score": one(score, pa.float64()), "base": one(base, pa.float64()),
                     "known": one(None if seen is None else seen.astype(np.int64), pa.int64()), "w": one(w, pa.int64())}
            out.append(pa.table([given.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema))

    def sums(place: np.ndarray, *values: np.ndarray):
        every, back = np.unique(place, return_inverse=True)
        return every, *(np.bincount(back, v, len(every)).astype(np.float64) for v in values)

    batches = asked.column("batch").to_numpy()
    # words without numbers: their training counts meet here
    rows = np.flatnonzero(kind == WORD)
    lists = [unpacked(asked.column("pack")[i].as_py(), 4) for i in rows.tolist()]
    if lists:
        w, place, times, train = (np.concatenate(c) for c in zip(*lists))
        every, back = np.unique(w, return_inverse=True)
        count = np.bincount(back, times * train, len(every))[back]
        ends = np.cumsum([len(x[0]) for x in lists])
        for i, e, x in zip(rows.tolist(), ends.tolist(), lists):
            c = count[e - len(x[0]): e]
            p, base, seen = sums(x[1], x[2] * np.log10((c + 1) / words.every), x[2] * (c > 0))
            answer(int(batches[i]), p, base=base, seen=seen)
    rows = np.flatnonzero(kind == SUMS)
    grams, places = [], []
    for i in rows.tolist():
        data, at = asked.column("pack")[i].as_py(), 0
        parts = []
        while at < len(data):
            size = int.from_bytes(data[at: at + 4], "little")
            parts.append(data[at + 4: at + 4 + size])
            at += 4 + size
        grams.append(parts[0])
        places.append(parts[1:])
    del asked, lists
    if not grams:
        return pa.concat_tables(out) if out else schema.empty_table()
    one, x, w, n = columns_of(grams, 4)
    del grams
    value, rare = score_slices(one, x, w, n, known, words, d)
    del one, x, n
    first = 0
    for i, (inner, text) in zip(rows.tolist(), places):
        (size,), (place, times) = unpacked(inner, 1), unpacked(text, 2)
        last = first + len(size)
        p, score = sums(place, times * np.repeat(value[first:last], size))
        answer(int(batches[i]), p, score=score)
        # the last step of a token whose word has no number: its count is in the table of words
        r = np.repeat(rare[first:last], size)
        if r.any():
            answer(int(batches[i]), place[r], score=times[r].astype(np.float64), w=np.repeat(w[first:last], size)[r])
        first = last
    return pa.concat_tables(out)


def score_slices(one: np.ndarray, x: np.ndarray, w: np.ndarray, n: np.ndarray, known: pa.Table, words: Words, d: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """``score_grams`` for some of a part's n-grams at a time: those of a word in the middle together, of a heavy one those of a pair.

    What they need of each other is as in parts, and rows keep their order, so all values are the same.
    """
    count = -(-len(one) // GRAMS_TOGETHER)
    if count < 2:
        return score_grams(one, x, w, n, known, words, d)
    place = mix(one.view(np.uint64))
    heavy = lookup(words.heavy, one)[1]
    with np.errstate(over="ignore"):
        place[heavy] += mix(w[heavy].view(np.uint64))
    place = ((mix(place) >> np.uint64(32)) % np.uint64(count)).astype(np.int32)
    value, rare = np.empty(len(one)), np.empty(len(one), bool)
    for k in range(count):
        at = np.flatnonzero(place == k)
        value[at], rare[at] = score_grams(one[at], x[at], w[at], n[at], known, words, d)
    return value, rare


def score_grams(one: np.ndarray, x: np.ndarray, w: np.ndarray, n: np.ndarray, known: pa.Table, words: Words, d: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the share of every n-gram, by Katz's recursion; and whether the add-one share of its word is still to be added."""
    small = len(words.counts)
    one, x, w, n, where = merged(one, x, w, n, small)
    p1, pw, pn, pair = pairs_of(one, w, n, small)
    pn, _ = pair_counts(p1, pw, pn, words)
    aux = {c: known.column(c).to_numpy() for c in ("one", "x", "base", "value")}
    context = aux["base"] > 0
    # one word before
    pk = kept(pn, d.two)
    m = runs(p1)
    c2, k2 = totals(pn, m), totals(pk, m)
    numbered, seen2 = pw > 0, pn > 0
    share1 = np.where(numbered, (words.counts[np.maximum(pw, 0)] + 1) / words.every, 1.0)
    s2 = totals(np.where(seen2 & numbered, share1, 0.0), m)
    followers = np.argsort(aux["one"][~context])
    at, found = lookup(aux["one"][~context][followers], p1[m])
    s2[found] += aux["value"][~context][followers][at[found]]
    base2, weight2 = based(c2, k2), np.ones(len(m))
    heavy_at, heavy = lookup(words.heavy, p1[m])
    some = (c2 > 0) & ~heavy
    weight2[some] = (1 - k2[some] / base2[some]) / (1 - s2[some])
    base2[heavy], weight2[heavy] = d.heavy_base[heavy_at[heavy]], d.heavy_weight[heavy_at[heavy]]
    base2, weight2 = spread(base2, m, len(p1)), spread(weight2, m, len(p1))
    share2 = np.where(seen2, pk / base2, 1.0)
    lower = np.where(seen2, np.log10(share2), np.log10(weight2) + np.log10(share1))
    rare = ~seen2 & ~numbered
    # two words before
    k3, seen3 = kept(n, d.three), n > 0
    f = runs(one, x)
    c, k, s = totals(n, f), totals(k3, f), totals(np.where(seen3, share2[pair], 0.0), f)
    base3, weight3 = based(c, k), np.zeros(len(f))
    heavy = lookup(words.heavy, one[f])[1]
    some = (c > 0) & ~heavy
    weight3[some] = np.log10((1 - k[some] / base3[some]) / (1 - s[some]))
    if heavy.any():
        keys = pair_key(aux["one"][context], aux["x"][context])
        order = np.argsort(keys)
        at = order[lookup(keys[order], pair_key(one[f][heavy], x[f][heavy]))[0]]
        base3[heavy], weight3[heavy] = aux["base"][context][at], aux["value"][context][at]
    base3, weight3 = spread(base3, f, len(n)), spread(weight3, f, len(n))
    value = np.where(seen3, np.log10(np.where(seen3, k3 / base3, 1.0)), weight3 + lower[pair])
    return value[where], (~seen3 & rare[pair])[where]


def texts_of_batch(key, rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """Rows of one batch's texts from the sums of all parts."""
    kind = rows.column("kind").to_numpy()
    text = rows.filter(pa.array(kind == TEXT))
    n = len(text.column("ids").chunk(0).flatten())
    total = []
    for c in ("known", "base", "score"):  # a row says nothing of what it has no list for
        some = rows.filter(rows.column(c).is_valid())
        place, values = (some.column(k).combine_chunks().flatten().to_numpy() for k in ("place", c))
        total.append(np.bincount(place, values, n))
    given = {"id": text.column("ids").chunk(0).flatten(), "train": text.column("train").chunk(0).flatten(), "n_tokens": text.column("n_tokens").chunk(0).flatten(),
             "n_known": pa.array(total[0].astype(np.int64)), "base_score": pa.array(total[1].astype(np.float64)), "score": pa.array(total[2].astype(np.float64))}
    return pa.table([given[f.name] for f in schema], schema=schema)


# ---------------------------------------------------------------------------------------------- the model


def words_to_ship(words: DataFrame, total: int, distinct: int, tokens: int, texts: int) -> Words:
    """Numbers for the most frequent words, and how many parts the heavy ones are split over. START is in the middle once a text."""
    least = most_frequent(words, NUMBERED)
    keys, n = columns(words.where(F.col("n") >= least).select("w", "n"), "w", "n")
    keys = keys.astype(np.int64).view(np.uint64)
    order = np.lexsort((keys, -n.astype(np.int64)))
    numbers = np.empty(len(keys), np.int32)
    numbers[order] = np.arange(1, len(keys) + 1)
    by_hash = np.argsort(keys)
    counts = np.concatenate([[texts], n[order]]).astype(np.int64)
    split = splits(counts, max(total, 1))
    heavy = np.flatnonzero(split > 1)
    none = np.zeros(0, np.int64)
    return Words(keys[by_hash], numbers[by_hash], counts, heavy, split[heavy], max(1, -(-tokens // TOKENS_A_PART)), float(total + distinct + 1), none.view(np.uint64), none, none)


def splits(n: np.ndarray, total: float) -> np.ndarray:
    """Over how many parts something with ``n`` of ``total`` tokens is split."""
    return np.maximum(-(-n // TOKENS_A_PART), np.where(n * HEAVY >= total, 2, 1)).astype(np.int64)


def with_heavy_pairs(source: DataFrame, words: Words, tokens: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """``words`` with the pairs that a sample shows to be heavy, counted in all texts; and both words of each."""
    none = np.zeros(0, np.int64)
    if not len(words.heavy):
        return words, none, none
    seen = source.sample(SAMPLE, 7).select("train", "text").mapInArrow(lambda b: sampled_pairs(b, words), "one long, w long, n long").groupBy("one", "w").agg(F.sum("n").alias("n"))
    least = max(1.0, min(TOKENS_A_PART, tokens / HEAVY) * SAMPLE)
    one, w, n = (c.astype(np.int64) for c in columns(seen.where(F.col("n") >= least), "one", "w", "n"))
    keys = pair_key(one, w)
    order = np.argsort(keys)
    found = replace(words, pair_keys=keys[order], pair_splits=np.maximum(splits((n[order] / SAMPLE).astype(np.int64), max(tokens, 1)), 2), pair_counts=np.zeros(len(keys), np.int64))
    if len(keys):
        counted = source.select("train", "text").mapInArrow(lambda b: counted_pairs(b, found), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
        place, n = columns(counted, "place", "n")
        found.pair_counts[place.astype(np.int64)] = n
    return found, one[order], w[order]


def katz_scores(texts: DataFrame, id: str, text: str, train: Column) -> tuple[DataFrame, int]:
    """(id, train, n_tokens, n_known, base_score, score), one row for every row of ``texts``; and the training tokens.

    The model is that of the rows for which ``train`` holds. ``score`` is its log10 probability of the text, ``base_score``
    the sum of log10((c + 1) / (N + V + 1)) over its tokens. Null texts are an end alone; repeated rows have rows of their
    own; other columns are not read; no rows give none.
    """
    assert TEXTS_TOGETHER < 1 << 15 and NUMBERED < 1 << 31
    spark = texts.sparkSession
    source = texts.select(F.col(id).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    counted = source.select("train", "text").mapInArrow(word_batches, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counted = stored(counted, "word-counts")
    words = counted.where("w is not null")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens = counted.where("w is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ends = words.where(F.col("w") == int(END_KEY)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ship, heavy_one, heavy_w = with_heavy_pairs(source, words_to_ship(words, int(total), int(distinct), int(tokens), int(ends)), int(tokens))
    every, parts = ship.every, ship.parts
    none = np.zeros(0, np.int64)
    held_by_parts = replace(ship, hashes=none.view(np.uint64), numbers=none)

    types = source.select("train", "text").mapInArrow(lambda b: deal_types(b, ship), "part long, pack binary").groupBy("part").applyInArrow(lambda key, packs: count_types(key, packs, held_by_parts), TYPES)
    types = stored(types, "ngram-types")
    kind, values = F.col("kind"), [f"v{k}" for k in range(12)]
    histogram = types.where(kind == HISTOGRAM).groupBy("one").agg(F.sum("v0").alias("three"), F.sum("v1").alias("two")).collect()
    factor = {c: np.array([0.0, *discounts({r["one"]: r[c] + (int((ship.pair_counts == r["one"]).sum()) if c == "two" else 0) for r in histogram}), 1.0]) for c in ("two", "three")}
    # followers without numbers with their counts
    coded = words.select(F.col("w").bitwiseOR(F.lit(-(1 << 63))).alias("w"), (F.col("n") + 1).alias("n1"))  # one row a word
    followers = types.where(kind == FOLLOWER).select("one", F.col("x").alias("w")).distinct().join(coded, "w").groupBy("one").agg(F.sum("n1").alias("n1"))
    followers = stored(followers, "rare-followers")
    # base and weight of the heavy words: not more rows than numbered words
    middle = types.where(kind == MIDDLE).groupBy("one").agg(*[F.sum(v).alias(v) for v in values])
    heavy_list = spark.createDataFrame(pa.table({"one": pa.array(ship.heavy, pa.int64())}))
    middle = heavy_list.join(middle, "one", "left").join(followers, "one", "left").na.fill(0)
    got = columns(middle, "one", "n1", *values[:7])
    at = np.searchsorted(ship.heavy, got[0])
    c, s, small = (np.zeros(len(ship.heavy), np.int64) for _ in range(3))
    small = np.zeros((TRUSTED, len(ship.heavy)), np.int64)
    c[at], s[at] = got[2], got[1] + got[8]
    for r in range(TRUSTED):
        small[r, at] = got[3 + r]
    mine = np.searchsorted(ship.heavy, heavy_one)
    n = ship.pair_counts
    np.add.at(c, mine, n)
    np.add.at(s, mine, np.where((n > 0) & (heavy_w > 0), ship.counts[np.maximum(heavy_w, 0)] + 1, 0))
    for r in range(TRUSTED):
        np.add.at(small[r], mine, n == r + 1)
    k = c + sum((small[r] * (r + 1) * (factor["two"][r + 1] - 1) for r in range(TRUSTED)), np.zeros(len(c)))
    base = based(c, k)
    with np.errstate(invalid="ignore", divide="ignore"):  # of words that nothing follows in training
        weight = np.where(c > 0, (1 - k / base) / (1 - s / every), 1.0)
    d = Discounts(factor["two"], factor["three"], base, weight)

    # what parts need beside their packs
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one = b.column("one").to_numpy()
            heavy = lookup(ship.heavy, one)[1]
            one = one[~heavy].astype(np.int64)
            zero = np.zeros(len(one), np.int64)
            home = ship.part(one, zero, zero)
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(one), pa.array(zero), pa.array(zero.astype(np.float64)), pa.array(b.column("n1").to_numpy()[~heavy] / every)], ["home", "one", "x", "base", "value"])

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, x, *v = (b.column(i).to_numpy().astype(np.int64) for i in ("one", "x", *values))
            k3 = v[0] + sum(v[1 + r] * (r + 1) * (factor["three"][r + 1] - 1) for r in range(TRUSTED))
            base3 = based(v[0], k3)
            shares = (v[6] + sum(v[7 + r] * (r + 1) * factor["two"][r + 1] for r in range(TRUSTED))) / d.heavy_base[lookup(ship.heavy, one)[0]]
            weight3 = np.zeros(len(one))
            seen = v[0] > 0
            weight3[seen] = np.log10((1 - k3[seen] / base3[seen]) / (1 - shares[seen]))
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(x), pa.array(np.maximum(base3, 1.0)), pa.array(weight3)], ["one", "x", "base", "value"])

    held = types.where(kind == CONTEXT)
    contexts = held.groupBy("one", "x").agg(*[F.sum(v).alias(v) for v in values]).mapInArrow(weights, "one long, x long, base double, value double")
    contexts = held.select(F.col("part").alias("home"), "one", "x").join(contexts, ["one", "x"]).select("home", "one", "x", "base", "value")
    aux = contexts.union(followers.mapInArrow(homes, "home long, one long, x long, base double, value double"))
    id_field = source.schema["id"]
    fields = [("part", T.LongType()), ("kind", T.ByteType()), ("batch", T.LongType()), ("pack", T.BinaryType()), ("ids", T.ArrayType(id_field.dataType)), ("train", T.ArrayType(T.BooleanType())),
              ("n_tokens", T.ArrayType(T.LongType())), ("place", T.ArrayType(T.IntegerType())), ("known", T.ArrayType(T.LongType())), ("base", T.ArrayType(T.DoubleType())),
              ("score", T.ArrayType(T.DoubleType())), ("w", T.ArrayType(T.LongType()))]
    dealt = T.StructType([T.StructField(n_, t) for n_, t in fields])
    answers = T.StructType([f for f in dealt if f.name not in ("part", "pack")])
    result = T.StructType([id_field, T.StructField("train", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])

    def arrow(schema: T.StructType, id_type: pa.DataType) -> pa.Schema:
        kinds = {"part": pa.int64(), "kind": pa.int8(), "batch": pa.int64(), "pack": pa.binary(), "ids": pa.list_(id_type), "id": id_type, "n_tokens": pa.list_(pa.int64()), "place": pa.list_(pa.int32()),
                 "known": pa.list_(pa.int64()), "base": pa.list_(pa.float64()), "score": pa.list_(pa.float64()), "w": pa.list_(pa.int64()), "train": pa.list_(pa.bool_())}
        flat = {"train": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.schema([(f.name, flat[f.name] if schema is result and f.name in flat else kinds[f.name]) for f in schema])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from deal_scored((b for some in ([first], batches) for b in some), ship, arrow(dealt, first.schema.field("id").type))

    def answer(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        return score_part(key, asked, known, held_by_parts, d, arrow(answers, asked.schema.field("ids").type.value_type)) if len(asked) else None

    sums = source.mapInArrow(deal, dealt).groupBy("part").cogroup(aux.groupBy("home")).applyInArrow(answer, answers)
    sums = stored(sums, "ngram-sums")
    # the add-one shares that are still to be added
    last = sums.where(F.col("kind") == WORD).select("batch", F.explode(F.arrays_zip("place", "score", "w")).alias("r")).select("batch", "r.place", F.col("r.score").alias("times"), "r.w")
    last = last.join(coded, "w", "left").groupBy("batch", "place").agg(F.sum(F.col("times") * F.log10(F.coalesce("n1", F.lit(1)) / every)).alias("score"))
    nulls = {f.name: F.lit(None).cast(f.dataType) for f in answers}
    last = last.groupBy("batch").agg(F.collect_list("place").alias("place"), F.collect_list("score").alias("score"))
    last = last.select(*[F.lit(SUMS).cast("byte").alias("kind") if f.name == "kind" else F.col(f.name) if f.name in last.columns else nulls[f.name].alias(f.name) for f in answers])
    every_sum = sums.where(F.col("kind") != WORD).unionByName(last)
    scores = every_sum.groupBy("batch").applyInArrow(lambda key, rows: texts_of_batch(key, rows, arrow(result, rows.schema.field("ids").type.value_type)), result)
    return scores.select("id", "train", "n_tokens", "n_known", "base_score", "score"), int(total)
