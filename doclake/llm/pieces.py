"""Texts cut into the pieces that byte-pair merges stay inside, as arrays; and tables of what is known of a piece."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

from doclake.llm.common import mix, span_hashes, text_slices
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)

OTHER, LETTER, NUMBER, SPACE_CLASS = 0, 1, 2, 3


def worker_state() -> dict:
    """What a Python worker keeps from task to task; functions that travel with a task have fresh globals each time."""
    module = sys.modules.setdefault("doclake_worker_state", types.ModuleType("doclake_worker_state"))
    return module.__dict__.setdefault("kept", {})


def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kept = worker_state()
    if "classes" not in kept:
        table = np.zeros(0x110000, dtype=np.uint8)
        text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for number, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE_CLASS, r"\s+")):
            for m in regex.finditer(pattern, text):
                for a, b in ((ord(m[0][0]), ord(m[0][-1]) + 1),):
                    table[a:b] = number
        table[0xD800:0xE000] = OTHER
        kept["classes"] = table
    return kept["classes"]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets as code points and row offsets into them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, before[offsets]


def piece_starts(points: np.ndarray, offsets: np.ndarray, spaces_join: bool, single_numbers: bool) -> np.ndarray:
    """Where pieces start. They tile the rows.

    Pieces are runs of letters, of numbers, of white space and of others; an apostrophe alone takes s, t, re, ve, m, ll or d
    from the letters after it. With ``spaces_join`` one space joins the run after it (the apostrophe then takes nothing)
    and another white space before a run stands alone; with ``single_numbers`` every number does.
    """
    n = len(points)
    kind = classes()[points]
    row_start = np.zeros(n + 1, dtype=bool)
    row_start[offsets] = True
    start = row_start[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    s = np.flatnonzero(start)
    e = np.append(s[1:], n)
    k = kind[s]
    cut = start.copy()
    if single_numbers:
        cut[kind == NUMBER] = True
    joined = np.zeros(len(s), dtype=bool)
    if spaces_join:
        follows = np.zeros(len(s), dtype=bool)  # a run after white space of the same row
        follows[1:] = (k[:-1] == SPACE_CLASS) & ~row_start[s[1:]]
        last = points[s - 1]
        joined = follows & (last == 32)
        cut[s[joined]] = False
        cut[s[follows] - 1] = True
    lone = np.flatnonzero((k[:-1] == OTHER) & (e[:-1] - s[:-1] == 1) & (points[s[:-1]] == 39) & (k[1:] == LETTER) & ~row_start[s[1:]] & ~joined[:-1])
    if len(lone):
        at, end = s[lone + 1], e[lone + 1]
        a, b = points[at], np.where(at + 1 < end, points[np.minimum(at + 1, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        took = np.where(one, 1, np.where(two, 2, 0))
        at, end, took = at[took > 0], end[took > 0], took[took > 0]
        cut[at] = False
        more = at + took < end
        cut[(at + took)[more]] = True
    return np.flatnonzero(cut)


def pieces(points: np.ndarray, offsets: np.ndarray, spaces_join: bool, single_numbers: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, after last, row) of all pieces in order; equal pieces have equal hashes."""
    starts = piece_starts(points, offsets, spaces_join, single_numbers)
    ends = np.append(starts[1:], len(points))
    keys = span_hashes(mix(points.astype(np.uint64) + np.uint64(0x1234567)), starts, ends)
    return keys, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def gather(flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Spans of ``flat`` one after the other."""
    after = np.cumsum(length)
    if not len(after):
        return flat[:0]
    return flat[np.arange(after[-1]) + np.repeat(first - (after - length), length)]


class PieceTable:
    """Values of different pieces, found by hash; forgets all of them when there are too many."""

    def __init__(self, most: int = 3_000_000):
        self.most = most
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.columns: list[list] = []

    def places(self, keys: np.ndarray, first: Callable[[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
        """Place of every key; ``first`` gives (lengths, flat values) columns for the pieces at given positions, once each."""
        known, where, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, known)
        fresh = (at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != known) if len(self.keys) else np.ones(len(known), bool)
        if fresh.any():
            if len(self.keys) and len(self.keys) + fresh.sum() > self.most:
                self.clear()
                return self.places(keys, first)
            new = first(where[fresh])
            if not self.columns:
                self.columns = [[np.zeros(0, np.int64), np.zeros(0, np.int64), flat[:0]] for _, flat in new]
            for column, (lengths, flat) in zip(self.columns, new):
                ends = len(column[2]) + np.cumsum(lengths)
                column[0] = np.concatenate([column[0], ends - lengths])
                column[1] = np.concatenate([column[1], lengths])
                column[2] = np.concatenate([column[2], flat])
            self.at = np.insert(self.at, at[fresh], len(self.at) + np.arange(fresh.sum()))
            self.keys = np.insert(self.keys, at[fresh], known[fresh])
            at = np.searchsorted(self.keys, known)
        return self.at[at][back] if len(keys) else np.zeros(0, np.int64)

    def take(self, column: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, values one after the other)."""
        first, length, flat = self.columns[column] if self.columns else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return length[places], gather(flat, first[places], length[places])


def piece_texts(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    return [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts.tolist(), ends.tolist())]


def slices_of_points(texts: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in text_slices(texts, most):
        yield a, b, *code_points(data, offsets)
