"""Spelling variants against their definition on dictionaries."""

import random
import re
import zlib
from collections import Counter

import pytest

from doclake.llm import variants
from doclake.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, word string, id int, n int, key string, root string"


def words_by_definition(rows, every=97):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def near_by_pairs(words):
    return {w: [v for v in words if one_apart(w, v)] for w in words}


def near_by_neighbourhood(words):
    """The same over many words: words that share a text with one character dropped at one place, or are that text."""
    by_key, out = {}, {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            by_key.setdefault((w[:k], w[k + 1:]), []).append(w)
            if (short := w[:k] + w[k + 1:]) in out:
                out[w].add(short)
                out[short].add(w)
    for same in by_key.values():
        for w in same:
            out[w].update(v for v in same if v != w)
    return out


def definition(words, near):
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def rows_of(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in frame.collect())


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "k", "r") for i, t in rows], DOCS).repartition(4)


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abÀÿz×", k=rng.randrange(4, 9))) for _ in range(60)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "abababa", "babab", "aabaa", "Ünder", "STRASSE", "straße", "İstanbul", "naïve"]
    rows = []
    for i in range(300):
        words = [w if rng.random() < 0.7 else w[:(k := rng.randrange(len(w)))] + rng.choice("abz") * rng.randrange(3) + w[k + 1:] for w in rng.choices(base, [1 / (j + 1) for j in range(len(base))], k=40)]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words)))
    return rows + [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (900, None), (901, ""), (902, "…, 12 — ω кот"), (None, None)]


@pytest.mark.parametrize("seed, every, together", [(1, 97, 300_000), (2, 3, 5), (3, 1, 300_000)])
def test_against_the_definition(spark, monkeypatch, seed, every, together):
    monkeypatch.setattr(variants, "WORDS_TOGETHER", together)
    rows = corpus(seed)
    words = words_by_definition(rows, every)
    near = near_by_pairs(words)
    assert {w: set(v) for w, v in near.items()} == near_by_neighbourhood(words)
    got = rows_of(variants.spelling_variants(frame_of(spark, rows), "doc_id", "text", every=every))
    assert got == definition(words, near)
    assert sum(r[1] is not None for r in got) > 20


def test_chains_of_forms(spark):
    """A word's root is at the end of a chain of forms, each at least twice as frequent."""
    chain = ["z" * k + "abcdefgh"[k:] for k in range(8)]
    rows = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(3 << k)))]
    got = {r[0]: r for r in rows_of(variants.spelling_variants(frame_of(spark, rows), "doc_id", "text", every=1 << 40))}
    assert [got[w][1] for w in chain] == [*chain[1:], None]
    assert {got[w][2] for w in chain} == {chain[-1]}


def test_ties_go_to_the_smallest_word(spark):
    rows = [(1, "hause " * 3 + "house " * 6 + "hbuse " * 6 + "ßause " * 6)]
    got = {r[0]: r for r in rows_of(variants.spelling_variants(frame_of(spark, rows), "doc_id", "text", every=1 << 40))}
    assert got["hause"][1:] == ("hbuse", "hbuse", 3, 3, 6) and got["hbuse"][1] is None


@pytest.mark.parametrize("literal", [64, 6, 0])
def test_long_words(spark, monkeypatch, literal):
    """Words around and beyond the length from which rotations are digests."""
    monkeypatch.setattr(variants, "LITERAL", literal)
    rng = random.Random(7)
    long = ["".join(rng.choices("ab", k=k)) for k in (63, 64, 65, 66, 67, 200, 5000)]
    edits = [w[:k] + c + w[k + d:] for w in long for k in (0, 1, 30, len(w) - 1) for c, d in (("", 1), ("c", 1), ("c", 0), (w[k], 0))]
    words = [*long * 4, *edits * 3, "short", "shirt", "short", "short", "shirt", "shirt"]
    rows = [(1, " ".join(words)), (2, "x" * 30_000), (3, "X" * 30_000), (4, "x" * 30_000 + "."), (5, "x" * 29_999), (6, "x" * 29_999 + " " + "x" * 29_999)]
    words = words_by_definition(rows, 1 << 40)
    got = rows_of(variants.spelling_variants(frame_of(spark, rows), "doc_id", "text", every=1 << 40))
    assert got == definition(words, near_by_pairs(words))


def test_texts_are_cut_between_words():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices("abÀ .,\n", k=rng.randrange(60)))
        parts = list(variants.chunks(text, rng.randrange(1, 20)))
        assert "".join(parts) == text
        assert [w for p in parts for w in RUN.findall(p)] == RUN.findall(text)


def test_of_nothing(spark):
    assert rows_of(variants.spelling_variants(frame_of(spark, []), "doc_id", "text")) == []
    assert rows_of(variants.spelling_variants(frame_of(spark, [(1, None), (2, "")]), "doc_id", "text")) == []


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    words = words_by_definition([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert rows_of(QUERIES["op12_spelling_variants"](spark, sf)) == definition(words, near_by_neighbourhood(words))
