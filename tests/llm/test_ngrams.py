"""Katz backoff of order three against the definition on dictionaries."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from doclake.llm import katz, ngrams
from doclake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randrange(0, 80))) for _ in range(400)]
    return [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "never seen words"), (3, texts[3]), (None, "w1 W1"), (503, "w1 " * 5000)]


def is_train(i):
    return i is not None and i % 5 != 2


def brute(rows, is_train):
    """(id, n_tokens, n_known, base_score, score) of all rows."""
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    grams = [Counter(), Counter(), Counter()]
    for i, t in tokens:
        if is_train(i):
            padded = ["<s>", "<s>", *t]
            for k in range(2, len(padded)):
                for order in range(3):
                    grams[order][tuple(padded[k - order: k + 1])] += 1
    total, distinct = sum(grams[0].values()), len(grams[0])
    alone = lambda w: (grams[0][w,] + 1) / (total + distinct + 1)
    levels = [None]
    for order in (1, 2):
        factor = dict(enumerate(katz.discounts(Counter(grams[order].values())), 1))
        follow: dict = {}
        for g, n in grams[order].items():
            follow.setdefault(g[:-1], {})[g[-1]] = n
        lower = (lambda h, w: alone(w)) if order == 1 else share_of(levels[1])
        level = {}
        for h, f in follow.items():
            kept = {w: n * factor.get(n, 1.0) for w, n in f.items()}
            size = sum(f.values())
            if size - sum(kept.values()) < 1e-9 * size:
                size += 1
            level[h] = {w: k / size for w, k in kept.items()}, (1 - sum(kept.values()) / size) / (1 - sum(lower(h[1:], w) for w in f))
        levels.append((level, lower))
    score = share_of(levels[2])
    for h in list(levels[2][0])[:20]:  # every seen word, and what was not seen
        assert sum(score(h, w) for w, in grams[0]) + score(h, "never") == pytest.approx(1, abs=1e-9)
    out = []
    for i, t in tokens:
        padded = ["<s>", "<s>", *t]
        out.append((i, len(t), sum(grams[0][w,] > 0 for w in t), sum(math.log10(alone(w)) for w in t),
                    sum(math.log10(score(tuple(padded[k - 2: k]), padded[k])) for k in range(2, len(padded)))))
    return out


def share_of(level):
    table, lower = level

    def share(h, w):
        seen, weight = table.get(h, ({}, 1.0))
        return seen[w] if w in seen else weight * lower(h[1:], w)

    return share


@pytest.mark.parametrize("sample, heavy", [(0.02, 4096), (1.0, 100)])
def test_against_the_definition(spark, monkeypatch, sample, heavy):
    monkeypatch.setattr(ngrams, "SAMPLE", sample)
    monkeypatch.setattr(ngrams, "HEAVY", heavy)
    frame = spark.createDataFrame([(*r, 1, True) for r in corpus()], "doc_id long, text string, batch int, train boolean").repartition(3)
    scores, total = ngrams.katz_scores(frame, "doc_id", "text", F.coalesce(F.col("doc_id") % 5 != 2, F.lit(False)))
    order = lambda r: (r[0] is None, r)
    got = sorted(((r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in scores.collect()), key=order)
    want = sorted(brute(corpus(), is_train), key=order)
    assert total == sum(n for i, n, *_ in want if is_train(i))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3]
        assert g[3:] == pytest.approx(w[3:], rel=1e-9)


def test_of_nothing(spark):
    frame = spark.createDataFrame(corpus()[:5], "doc_id long, text string")
    assert ngrams.katz_scores(frame.limit(0), "doc_id", "text", F.lit(True))[0].collect() == []
    scores, total = ngrams.katz_scores(frame, "doc_id", "text", F.lit(False))
    rows = scores.collect()
    assert len(rows) == 5 and total == 0
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in rows)


def test_query_counts_words_beyond_the_frequent_ones(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    import zlib

    want = {i: s for i, _, _, _, s in brute(texts, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)}
    got = {r.doc_id: r.score for r in QUERIES["op2_katz_scores"](spark, sf).collect()}
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("tokens, numbered, together, heavy, sample", [(400, 1 << 20, 700_000, 8, 0.5), (300, 12, 900, 30, 1.0), (2000, 0, 500, 8, 0.02), (150, 40, 700_000, 1 << 40, 1.0)])
def test_where_ngrams_meet_changes_nothing(spark, monkeypatch, tokens, numbered, together, heavy, sample):
    """Many parts, words and pairs split over several of them, words without numbers, many batches; short texts make START frequent."""
    for name, value in (("TOKENS_A_PART", tokens), ("NUMBERED", numbered), ("HEAVY", heavy), ("SAMPLE", sample), ("WORDS_TOGETHER", 50)):
        monkeypatch.setattr(ngrams, name, value)
    monkeypatch.setattr(katz, "TOKENS_TOGETHER", together)
    rng = random.Random(8)
    rows = corpus() + [(1000 + i, rng.choice(["w1 w2", "w1", "w2 w1 w1 w3", f"only{i} w1"])) for i in range(300)]
    frame = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, batch int, train boolean").repartition(3)
    scores, total = ngrams.katz_scores(frame, "doc_id", "text", F.coalesce(F.col("doc_id") % 5 != 2, F.lit(False)))
    order = lambda r: (r[0] is None, r)
    got = sorted(((r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in scores.collect()), key=order)
    want = sorted(brute(rows, is_train), key=order)
    assert total == sum(n for i, n, *_ in want if is_train(i)) and len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3]
        assert g[3:] == pytest.approx(w[3:], rel=1e-9)


@pytest.mark.parametrize("bits", [21, 6])
def test_joint_order_is_that_of_the_columns(monkeypatch, bits):
    import numpy as np

    monkeypatch.setattr(ngrams, "BITS", bits)
    rng = np.random.default_rng(5)
    columns = [np.where(rng.random(500) < 0.3, -rng.choice([3, 7 << 40, 1 << 62], 500), rng.integers(0, 40, 500)) for _ in range(3)]
    order, first = ngrams.in_order(40, *columns)
    rows = [tuple(int(c[i]) & (1 << 64) - 1 for c in columns) for i in range(500)]
    assert order.tolist() == sorted(range(500), key=lambda i: (rows[i], i))
    assert [rows[order[i]] for i in first.tolist()] == sorted(set(rows))


@pytest.mark.parametrize("size", [0, 1, 2, 1000])
def test_finder_finds_what_lookup_finds(size):
    import numpy as np

    rng = np.random.default_rng(size)
    for values in (rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2), np.arange(size, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(size, dtype=np.uint64)):
        values = np.unique(values)
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << 63, 50, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        (at, found), (want_at, want) = ngrams.finder(values)(asked), ngrams.lookup(values, asked)
        assert found.tolist() == want.tolist() and at[found].tolist() == want_at[want].tolist()


def test_packs_give_back_their_columns():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        given = rng.integers(0, 1 << 32, n) - 1, np.where(rng.random(n) < 0.3, -rng.integers(1, 1 << 62, n), rng.integers(0, 1 << 20, n)), np.arange(n)
        given = np.where(given[0] == 0xFFFFFFFF, 0, given[0]), *given[1:]
        for a, b in zip(ngrams.unpacked(ngrams.packed(*given), 3), given):
            assert a.tolist() == b.tolist()


def test_ngrams_of_a_part_are_scored_some_at_a_time(monkeypatch):
    """Memory beyond the columns does not grow with a part, values are the same; words and pairs may be heavy."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows, small, none = 300_000, 2_000, np.zeros(0, np.int64)
    code = lambda: np.where(rng.random(rows) < 0.2, -rng.integers(1, 1 << 40, rows), (small * rng.random(rows) ** 2).astype(np.int64) + 1)
    one, x, w, n = code(), code(), code(), rng.integers(0, 4, rows)
    one[: rows // 10], w[: rows // 20] = 7, 9  # a heavy word and a heavy pair
    heavy, keys = np.array([7]), ngrams.pair_key(np.array([7]), np.array([9]))
    words = ngrams.Words(none.view(np.uint64), none, rng.integers(1, 9, small + 2), heavy, np.array([4]), 40, 1e6, keys, np.array([2]), np.array([5_000]))
    d = ngrams.Discounts(np.array([0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), np.array([0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0]), np.array([9e4]), np.array([0.1]))
    contexts = np.unique(x[one == 7])
    known = pa.table({"one": np.full(len(contexts), 7), "x": contexts, "base": rng.uniform(5, 9, len(contexts)), "value": rng.uniform(-2, -1, len(contexts))})

    def peak(score):
        tracemalloc.start()
        out = score(one, x, w, n, known, words, d)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    monkeypatch.setattr(ngrams, "GRAMS_TOGETHER", 30_000)
    (whole, rare), at_once = peak(ngrams.score_grams)
    (value, still), some = peak(ngrams.score_slices)
    assert value.tolist() == whole.tolist() and still.tolist() == rare.tolist()
    assert some < at_once / 2
    assert some < 100 * rows
