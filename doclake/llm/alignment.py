"""Alignment of two tokenizers: where tokens of both end, their ids fall into groups, and ids of a group are linked.

A text's tokens are looked up by their cumulative ends; ends that both have, in order, slice both lists of ids into groups. A
blank or a line end behind another character always begins a token of both, so a text is aligned word by word and every
different word once. How many documents link two ids is counted over the corpus: a task hands on the different pairs of many texts
at a time, and gets their counts back in the same way.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclake.llm.common import mix, span_hashes, stored
from doclake.llm.pieces import SPACE_CLASS, PieceTable, classes, slices_of_points, worker_state
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)

SLICE = 1 << 20
#: Pairs of (document, ids) and texts that a task hands on together. This decides what meets where, not what it counts.
PAIRS_TOGETHER, TEXTS_TOGETHER = 1_000_000, 30_000
#: Bytes of packs that are written and read at once.
GROUP_BYTES = 4 << 20
#: Words that are longer, in code points, are aligned where they occur and not remembered.
REMEMBERED, MOST_WORDS = 256, 1_000_000
#: Words that the first tokenizer takes at once.
TOGETHER = 200
#: Groups with more links than this are linked by their different ids.
SHORT = 64
#: A pair of ids is one number: the first times this, plus the second.
SECOND = 1 << 31


class Tokenizers:
    """Both tokenizers of a worker, the bytes of their entries, and what is known of words."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_buffer(first)
        self.first.encode_special_tokens = True  # their strings in a text are ordinary text
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        plain = byte_characters()
        entries = self.first.get_vocab(with_added_tokens=True)
        self.first_bytes = {i: bytes(plain[c] for c in entry) if all(c in plain for c in entry) else entry.encode() for entry, i in entries.items()}
        sp = self.second
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # blanks and line ends part words for both: no piece of the second goes on behind a character with a blank or holds a line
        # end, and the first one cuts at white space itself
        given = json.loads(first)
        cuts = given.get("pre_tokenizer") or {}
        self.by_words = (given.get("normalizer") is None and cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True)
                         and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and "▁" in pieces)
        self.blank = [sp.piece_to_id("▁")]  # a blank at the end of a text is a word; the model gives nothing for an empty text
        self.first_sizes = np.zeros(max(self.first_bytes) + 1, np.int64)
        for i, x in self.first_bytes.items():
            self.first_sizes[i] = len(x)
        self.second_sizes = np.array([len(x) for x in self.second_bytes], np.int64)
        most = max(len(self.first_sizes), len(pieces))
        self.digits = np.array([list(f"{i:<8}".encode()) for i in range(most)], np.uint8), np.array([len(str(i)) for i in range(most)], np.int64)
        self.table = PieceTable(MOST_WORDS)

    def encode(self, texts: list[str], words: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """(number, ids) of both tokenizers, and whether their bytes are not the text's, for texts that start with a blank or a line end.

        The first one takes many ``words`` at once, which changes nothing: what ends a word ends a token.
        """
        whole = [x.encode() for x in texts]
        sizes = np.array([len(x) for x in whole], np.int64)
        joined = [False, *(words and i % TOGETHER != 0 and not x[-1].isspace() for i, x in enumerate(texts[:-1], 1))]
        starts = [i for i, j in enumerate(joined) if not j]
        parts = ["".join(texts[i:j]) for i, j in zip(starts, [*starts[1:], len(texts)])]
        first = [e.ids for e in self.first.encode_batch_fast(parts, add_special_tokens=False)]
        a = np.array([i for x in first for i in x], np.int32)
        # the model puts a blank before what it is given: a text's own first blank stands for it, before a line end it is a token of its own
        second = self.second.encode([x[1:] if x[0] == " " else x for x in texts], num_threads=1)
        second = [y[1:] if x[0] != " " else self.blank if x == " " else y for x, y in zip(texts, second)]
        b_count, b = np.array([len(y) for y in second], np.int64), np.array([i for y in second for i in y], np.int32)
        ends = np.cumsum(sizes)
        a_end = np.searchsorted(np.cumsum(self.first_sizes[a]), ends, side="left") + 1
        b_sizes = np.concatenate([[0], np.cumsum(self.second_sizes[b])])
        b_last = np.cumsum(b_count)
        everything = b"".join(whole)
        wrong = b_sizes[b_last] - b_sizes[b_last - b_count] != sizes
        if wrong.any() or b"".join(map(self.second_bytes.__getitem__, b.tolist())) != everything:
            wrong = np.array([b"".join([self.second_bytes[i] for i in y]) != x for x, y in zip(whole, second)])
        a_count = np.diff(a_end, prepend=0)
        if b"".join(map(self.first_bytes.__getitem__, a.tolist())) != everything:
            if words:
                return self.encode(texts, False)
            a_count = np.array([len(x) for x in first], np.int64)
            wrong |= np.array([b"".join([self.first_bytes[i] for i in x]) != y for x, y in zip(first, whole)])
        return [(a_count, a), (b_count, b), (np.ones(len(texts), np.int64), wrong.astype(np.int64))]


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level entries: itself where it can be printed, else the next from U+0100 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printed)]
    return {**{chr(b): b for b in printed}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def tokenizers_of(first: bytes, second: bytes) -> Tokenizers:
    """Once a worker."""
    kept = worker_state()
    key = ("alignment", hashlib.sha256(first).hexdigest(), hashlib.sha256(second).hexdigest())
    if key not in kept:
        kept[key] = Tokenizers(first, second)
    return kept[key]


def common_ends(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of each list end at or before every place where tokens of both end, in order."""
    a_at, b_at = dict(zip(a_ends, range(1, len(a_ends) + 1))), dict(zip(b_ends, range(1, len(b_ends) + 1)))
    both = sorted(a_at.keys() & b_at.keys())
    return [a_at[end] for end in both], [b_at[end] for end in both]


def links_of(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, how often its ids are linked) of groups that end at ``a_cut`` and ``b_cut``; rows of a pair are to be added up.

    In long groups equal ids are linked once and counted, so such a group costs its different ids.
    """
    a_size, b_size = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
    short = np.flatnonzero(a_size * b_size <= SHORT)
    links = a_size[short] * b_size[short]
    each = np.repeat(short, links)
    k = np.arange(len(each)) - np.repeat(np.cumsum(links) - links, links)
    x, y = (a_cut - a_size)[each] + k // b_size[each], (b_cut - b_size)[each] + k % b_size[each]
    group, pairs, times = [each], [a[x] * SECOND + b[y]], [np.ones(len(each), np.int64)]
    for g in np.flatnonzero(a_size * b_size > SHORT).tolist():
        x, n = np.unique(a[a_cut[g] - a_size[g]: a_cut[g]], return_counts=True)
        y, m = np.unique(b[b_cut[g] - b_size[g]: b_cut[g]], return_counts=True)
        pairs.append((x[:, None] * SECOND + y).ravel())
        times.append((n[:, None] * m).ravel())
        group.append(np.full(len(pairs[-1]), g))
    return np.concatenate(group), np.concatenate(pairs), np.concatenate(times)


class Slice:
    """Alignment of the texts of one slice: facts by text, groups as text, and (text, pair, links) sorted by text and pair."""

    def __init__(self, t: Tokenizers, points: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        a, a_of, b, b_of, wrong = self.tokens(t, points, offsets)
        good = np.diff(offsets) > 0
        good[wrong] = False
        keep_a, keep_b = good[a_of], good[b_of]
        a, a_of, b, b_of = a[keep_a].astype(np.int64), a_of[keep_a], b[keep_b].astype(np.int64), b_of[keep_b]
        a_first, b_first = (np.searchsorted(of, np.arange(n + 1)) for of in (a_of, b_of))
        a_end, b_end = np.cumsum(t.first_sizes[a]), np.cumsum(t.second_sizes[b])
        a_cut, b_cut, n_groups = [], [], np.zeros(n, np.int64)
        for i in np.flatnonzero(good).tolist():
            x, y = common_ends(a_end[a_first[i]: a_first[i + 1]].tolist(), b_end[b_first[i]: b_first[i + 1]].tolist())
            n_groups[i] = len(x)
            a_cut += x
            b_cut += y
        text_of = np.repeat(np.arange(n), n_groups)
        a_cut, b_cut = np.array(a_cut, np.int64) + a_first[text_of], np.array(b_cut, np.int64) + b_first[text_of]
        group, pairs, times = links_of(a, b, a_cut, b_cut)
        of = text_of[group]
        self.facts = np.stack([np.diff(a_first), np.diff(b_first), n_groups, np.bincount(of, times, n).astype(np.int64)], axis=1)
        self.groups = self.written(t, a, b, a_cut, b_cut, text_of, n)
        order = np.lexsort((pairs, of))
        of, pairs, times = of[order], pairs[order], times[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (pairs[1:] != pairs[:-1])
        at = np.flatnonzero(new)
        self.of, self.pairs = of[at], pairs[at]
        self.times = np.add.reduceat(times, at) if len(at) else times

    @staticmethod
    def tokens(t: Tokenizers, points: np.ndarray, offsets: np.ndarray):
        """Ids of both tokenizers with the text of each, in order of texts; and the texts whose bytes they do not give back."""
        n = len(offsets) - 1
        kind = classes()[points]
        row_start = np.zeros(len(points) + 1, bool)
        row_start[offsets] = True
        cut = row_start[:-1].copy()
        cut[1:] |= ((points[1:] == 32) | (points[1:] == 10)) & (kind[:-1] != SPACE_CLASS)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(points))
        rows = np.searchsorted(offsets, starts, side="right") - 1
        alone = np.zeros(n, bool)  # texts that are encoded as a whole
        alone[rows[ends - starts > REMEMBERED]] = True
        if not t.by_words:
            alone[rows] = True
        words = ~alone[rows]
        starts, ends, rows = starts[words], ends[words], rows[words]
        text = points.tobytes().decode("utf-32-le")

        def words_at(first: np.ndarray, last: np.ndarray) -> list[str]:
            return [text[i:j] for i, j in zip(first.tolist(), last.tolist())]

        keys = span_hashes(mix(points.astype(np.uint64) + np.uint64(0x1234567)), starts, ends)
        at = t.table.places(keys, lambda new: t.encode(words_at(starts[new], ends[new]), True))
        (a_size, a), (b_size, b), (_, bad) = (t.table.take(c, at) for c in range(3))
        a_of, b_of, wrong = np.repeat(rows, a_size), np.repeat(rows, b_size), rows[bad > 0]
        whole = np.flatnonzero(alone)
        if len(whole):
            (x_size, x), (y_size, y), (_, bad) = t.encode([points[offsets[i]: offsets[i + 1]].tobytes().decode("utf-32-le") for i in whole.tolist()], False)
            a, b, a_of, b_of = np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([a_of, np.repeat(whole, x_size)]), np.concatenate([b_of, np.repeat(whole, y_size)])
            wrong = np.concatenate([wrong, whole[bad > 0]])
            first, second = np.argsort(a_of, kind="stable"), np.argsort(b_of, kind="stable")
            a, a_of, b, b_of = a[first], a_of[first], b[second], b_of[second]
        return a, a_of, b, b_of, wrong

    @staticmethod
    def written(t: Tokenizers, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, text_of: np.ndarray, n: int) -> list[np.ndarray]:
        """``a1,a2|b1;a3|b2,b3`` of every text, as bytes: ids with what follows each, those of the first before those of the second in every group."""
        a_group, b_group = (np.repeat(np.arange(len(cut)), np.diff(cut, prepend=0)) for cut in (a_cut, b_cut))
        ids, after, of = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8), np.empty(len(a) + len(b), np.int64)
        before_a = np.concatenate([[0], b_cut])[a_group] if len(a) else np.zeros(0, np.int64)
        a_at, b_at = np.arange(len(a)) + before_a, np.arange(len(b)) + (a_cut[b_group] if len(b) else 0)
        ids[a_at], ids[b_at] = a, b
        of[a_at], of[b_at] = text_of[a_group], text_of[b_group]
        after[a_at[a_cut - 1]] = ord("|")
        after[b_at[b_cut - 1]] = ord(";")
        size = t.digits[1][ids]
        end = np.cumsum(size + 1)
        flat = np.empty(end[-1] if len(end) else 0, np.uint8)
        flat[end - 1] = after
        for k in range(int(size.max()) if len(size) else 0):  # digits by place
            here = size > k
            flat[end[here] - 1 - size[here] + k] = t.digits[0][ids[here], k]
        first = np.searchsorted(of, np.arange(n + 1))
        edge = np.concatenate([[0], end])[first]
        return [flat[edge[i]: max(edge[i], edge[i + 1] - 1)] for i in range(n)]


def pack_schema(id: T.DataType, with_groups: bool) -> T.StructType:
    """A pack: its texts, how many pairs each of them has (``sizes``), their places in ``pairs`` and links; and how many of its texts have each pair.

    Places and links are numbers of as few bytes as the largest takes.
    """
    kinds = [("pack", T.LongType()), ("ids", T.ArrayType(id)), *[(c, T.ArrayType(T.LongType())) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", T.ArrayType(T.StringType())),
             ("groups", T.ArrayType(T.StringType())), ("sizes", T.ArrayType(T.LongType())), ("at", T.BinaryType()), ("times", T.BinaryType()),
             ("pairs", T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("docs", T.LongType())])))]
    return T.StructType([T.StructField(n, k) for n, k in kinds if with_groups or n != "groups"])


def narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on, each in as few bytes as the largest takes."""
    return x.astype(np.min_scalar_type(x.max(initial=0))).tobytes()


def widened(data: memoryview, n: int) -> np.ndarray:
    """``n`` numbers that ``narrow`` wrote."""
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def packs(batches: Iterator[pa.RecordBatch], first: bytes, second: bytes, with_groups: bool) -> Iterator[pa.RecordBatch]:
    t = tokenizers_of(first, second)
    task, number = TaskContext.get().partitionId(), 0
    waiting: list[tuple[pa.Array, Slice, list[str], list[str]]] = []

    def out():
        nonlocal number, waiting
        sizes = np.concatenate([np.bincount(s.of, minlength=len(s.facts)) for _, s, *_ in waiting])
        every = np.concatenate([s.pairs for _, s, *_ in waiting])
        pairs, at, docs = np.unique(every, return_inverse=True, return_counts=True)
        facts = np.concatenate([s.facts for _, s, *_ in waiting])
        ids = pa.concat_arrays([i for i, *_ in waiting])
        values = [pa.array([x], pa.list_(kind)) for x, kind in (
            *[(facts[:, k], pa.int64()) for k in range(4)], ([d for w in waiting for d in w[2]], pa.string()), *([([g for w in waiting for g in w[3]], pa.string())] if with_groups else []), (sizes, pa.int64()))]
        values += [pa.array([narrow(at)], pa.binary()), pa.array([narrow(np.concatenate([s.times for _, s, *_ in waiting]))], pa.binary())]
        counts = pa.StructArray.from_arrays([pa.array(pairs, pa.int64()), pa.array(docs, pa.int64())], ["pair", "docs"])
        values.append(pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), counts))
        names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else []), "sizes", "at", "times", "pairs"]
        made = pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *values], ["pack", "ids", *names])
        number, waiting = number + 1, []
        return made

    held = texts = 0
    for batch in batches:
        source = batch.column("text")
        blank = pc.binary_join_element_wise(" ", source, "")  # null texts stay null and are empty
        blank = pc.if_else(pc.equal(pc.binary_length(blank), 1), "", blank)
        for a, b, points, offsets in slices_of_points(blank, SLICE):
            s = Slice(t, points, offsets)
            digests = [hashlib.sha256(g).hexdigest() if f else "" for g, f in zip(s.groups, s.facts[:, 0].tolist())]
            if waiting and (held + len(s.of) > PAIRS_TOGETHER or texts + b - a > TEXTS_TOGETHER):
                yield out()
                held = texts = 0
            waiting.append((batch.column("id").slice(a, b - a), s, digests, [g.tobytes().decode() for g in s.groups] if with_groups else []))
            held, texts = held + len(s.of), texts + b - a
            s.groups = []
    if waiting:
        yield out()


def answered(key, pack: pa.Table, counts: pa.Table, schema: pa.Schema) -> pa.Table:
    """Rows of the texts of one pack from the counts of its pairs."""
    flat = {c: pack.column(c).chunk(0).flatten() for c in pack.column_names if c not in ("pack", "at", "times")}
    place = counts.column("place").to_numpy()
    n, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    n[place], best[place] = counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    sizes = flat["sizes"].to_numpy(zero_copy_only=False)
    at, times = (widened(pack.column(c)[0].as_buffer(), int(sizes.sum())) for c in ("at", "times"))
    sums = []
    for weight in (times * best[at], times * n[at]):
        total = np.concatenate([[0], np.cumsum(weight)])
        edge = np.concatenate([[0], np.cumsum(sizes)])
        sums.append(total[edge[1:]] - total[edge[:-1]])
    given = {**flat, "id": flat["ids"], "n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64())}
    return pa.Table.from_arrays([given[f.name].cast(f.type) for f in schema], schema=schema)


def align(docs: DataFrame, id: str, text: str, first: bytes, second: bytes, with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for every row of ``docs``; ``with_groups`` adds groups.

    ``first`` is a byte-level tokenizer's file (tokenizers), ``second`` a model with byte fallback (sentencepiece); a blank is
    put before each text. ``groups`` are ``a1,a2|b1;a3|b2,b3``. ``n_best`` counts links whose pair has the most documents of all pairs of its
    first id, ``count_sum`` adds the documents of every link's pair. Texts that are null, empty or not given back byte by byte
    by both tokenizers have no tokens: zeros, and an empty digest. Repeated rows count each; other columns are not read;
    no rows give none. Files of tokenizers travel with the tasks.

    Packs are bounded by ``PAIRS_TOGETHER`` and the longest text, what tasks hold of their tables by ``GROUP_BYTES`` and a pack. A common pair travels once a pack, so no key holds more
    rows than there are packs.
    """
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType
    made = stored(source.mapInArrow(lambda b: packs(b, first, second, with_groups), pack_schema(kind, with_groups)), "alignment-packs", GROUP_BYTES)
    counted = made.select(F.inline("pairs")).groupBy("pair").agg(F.sum("docs").alias("n"))
    counted = stored(counted, "alignment-pairs")
    a = F.shiftright("pair", 31)
    most = counted.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # one row for an entry of the first vocabulary
    marked = counted.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = made.select(F.col("pack").alias("of"), F.posexplode("pairs.pair").alias("place", "pair")).join(marked, "pair").select("of", "place", "n", "best")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    longs = {"n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"}
    out = T.StructType([T.StructField(n, kind if n == "id" else T.LongType() if n in longs else T.StringType()) for n in names])

    def answer(key, pack, counts):
        schema = pa.schema([(n, pack.schema.field("ids").type.value_type if n == "id" else pa.int64() if n in longs else pa.string()) for n in names])
        return answered(key, pack, counts, schema)

    return made.drop("pairs").groupBy("pack").cogroup(asked.groupBy("of")).applyInArrow(answer, out)
