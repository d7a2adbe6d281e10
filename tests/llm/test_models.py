"""Learnt and tokenizing operators: held-out accuracy, brute force, exact round trips."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doclake.llm import bpe, katz, packing, quality
from doclake.llm.queries import QUERIES
from doclake.llm.queries_models import vocabulary

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# ---------------------------------------------------------------------------------------------------------- quality


def test_quality_of_held_out_documents(spark):
    got = QUERIES["op6_subword_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert ((got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3) == 1) == got.held_out).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert got.score.between(0, 1).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good text here", 7, "a"), (2, None, 7, "b"), (3, "", 7, "c"), (None, "x " * 100_000, 7, "d"), (1, "good text here", 7, "a")], "doc_id long, text string, score int, y string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 5), (9, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels, "doc_id", "text", "quality")
    got = quality.score_quality(docs, "text", model)
    assert got.columns == ["doc_id", "text", "y", "score"]
    rows = got.collect()
    assert len(rows) == 5
    assert len({r.score for r in rows if not r.text}) == 1
    none = quality.learn(docs, labels.limit(0), "doc_id", "text", "quality")
    assert {r.score for r in quality.score_quality(docs, "text", none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), "text", model).collect() == []


def test_quality_holds_some_texts_at_a_time():
    import tracemalloc

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(200)) for _ in range(1200)]
    n, s = len(texts), quality.Settings(epochs=1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([i % 2 for i in range(n)], pa.int32()), pa.array(texts)], ["order", "y", "text"])
    line = np.random.default_rng(3).normal(size=1 << s.bits)
    tracemalloc.start()
    try:
        found = list(quality.featurize(iter([batch]), s))
        scores = [x for b in quality.score_batches(iter([batch]), "text", ["order"], line, 0.5, s) for x in b.column("score").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20
    for i in (0, 700, n - 1):  # one text by itself
        (_, _, data, offsets), = quality.text_slices(batch.column("text").slice(i, 1))
        f = quality.features(data, offsets, s.bits, s.grams)[0]
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-(line[f].mean() + 0.5))), abs=1e-12)
    cells = [c.as_py() for b in found for c in b.column("cell")]
    ids, share = quality.unfolded(cells[700])
    (_, _, data, offsets), = quality.text_slices(batch.column("text").slice(700, 1))
    want, counts = np.unique(quality.features(data, offsets, s.bits, s.grams)[0], return_counts=True)
    assert ids.tolist() == want.tolist() and share == pytest.approx(counts / counts.sum(), rel=1e-6)


def test_features_depend_on_the_text_alone():
    a = pa.array(["Ein Text | mit é und und", "noch einer"])
    (_, _, data, offsets), = quality.text_slices(a)
    f, rows = quality.features(data, offsets, 17, (3, 4))
    (_, _, data, offsets), = quality.text_slices(a.slice(1))
    g, _ = quality.features(data, offsets, 17, (3, 4))
    assert sorted(f[rows == 1].tolist()) == sorted(g.tolist())


# ------------------------------------------------------------------------------------------------------------- Katz


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randrange(0, 80))) for _ in range(400)]
    return [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "never seen words"), (3, texts[3]), (None, "w1 W1"), (503, "w1 " * 5000)]


@pytest.fixture(scope="module")
def fitted(spark):
    frame = spark.createDataFrame([(*r, 1, True) for r in corpus()], "doc_id long, text string, row int, train boolean").repartition(3)
    train = F.coalesce(F.col("doc_id") % 5 != 2, F.lit(False))
    return frame, train, katz.fit(frame, "text", train, classes=20, pairs_at_hand=15)


def brute(model_classes):
    """Katz by the definition, on dictionaries."""
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in corpus()]
    train = [t for i, t in tokens if i is not None and i % 5 != 2]
    count = Counter(w for t in train for w in t)
    total, distinct = sum(count.values()), len(count)
    least = min(n for n in set(count.values()) if sum(c >= n for w, c in count.items() if w is not None) <= model_classes)
    known = {w for w, c in count.items() if w is None or c >= least}
    cls = lambda w: w if w in known else "<rare>"
    classes = [*known, "<rare>"]
    one = Counter(cls(w) for t in train for w in t)
    share = {c: (one[c] + 1) / (total + len(classes)) for c in classes}
    pair = Counter((h, c) for t in train for h, c in zip(["<start>", *map(cls, t)], map(cls, t)))
    of = Counter(pair.values())
    factor = dict(enumerate(katz.discounts(of), 1))
    context: dict = {}
    for (h, c), n in pair.items():
        context.setdefault(h, {})[c] = n
    table = {}
    for h, follow in context.items():
        kept = {c: n * factor.get(n, 1.0) for c, n in follow.items()}
        size = sum(follow.values())
        if len(follow) == len(classes):
            size, weight = sum(kept.values()), 0.0
        else:
            if size - sum(kept.values()) < 1e-9 * size:
                size += 1
            weight = (1 - sum(kept.values()) / size) / (1 - sum(share[c] for c in follow))
        table[h] = {c: kept[c] / size if c in kept else weight * share[c] for c in classes}
    rare_total = one["<rare>"]
    rare_distinct = distinct - len(known)

    def score(t):
        out = 0.0
        for h, w in zip(["<start>", *map(cls, t)], t):
            out += math.log10(table.get(h, share)[cls(w)])
            if cls(w) == "<rare>":
                out += math.log10((count[w] + 1) / (rare_total + rare_distinct + 1))
        return out

    return tokens, count, total, distinct, table, score


def test_katz(spark, fitted):
    frame, train, model = fitted
    tokens, count, total, distinct, table, score = brute(20)
    assert (model.n_tokens, model.n_distinct) == (total, distinct)
    for h, shares in table.items():
        assert sum(shares.values()) == pytest.approx(1, abs=1e-12)
    got = sorted(((r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in katz.score_texts(frame, "doc_id", "text", train, model).collect()), key=lambda r: (r[0] is None, r))
    want = sorted(((i, len(t), sum(count[w] > 0 for w in t), sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t), score(t)) for i, t in tokens), key=lambda r: (r[0] is None, r))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3]
        assert g[3:] == pytest.approx(w[3:], rel=1e-9)


def test_model_sums_to_one(spark, fitted):
    _, _, model = fitted
    pairs = spark.read.parquet(model.table).toPandas()
    h, x, p = pairs.key.values >> katz.SHIFT, pairs.key.values & ((1 << katz.SHIFT) - 1), 10 ** pairs.log.values
    share = 10 ** model.share
    share[katz.START] = 0
    for c in np.unique(h):
        seen = x[h == c]
        rest = np.delete(share, seen).sum()
        assert p[h == c].sum() + 10 ** model.backoff[c] * rest == pytest.approx(1, abs=1e-12)


def test_katz_of_nothing(spark, fitted):
    frame, train, model = fitted
    assert katz.score_texts(frame.limit(0), "doc_id", "text", train, model).collect() == []
    empty = katz.fit(frame.limit(0), "text", train)
    rows = katz.score_texts(frame.limit(5), "doc_id", "text", F.lit(False), empty).collect()
    assert len(rows) == 5
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in rows)


# -------------------------------------------------------------------------------------------------------------- BPE


def odd_texts(seed=3, n=600):
    rng = random.Random(seed)
    bits = ["a", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "!", "..", "'s", "'ve", "\x1c", "😀", "中", "文", "́", "A", "THE", "²", "İ", "É", "<|endoftext|>", "\x85", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [*texts, "", None, "a" * 3000, "=" * 4000, "ab" * 900, "".join(rng.choice("abcdefghij") for _ in range(900)), " " * 70, "x" + " " * 50 + "y", *texts[:3]]


def reference_encoding(name):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary(name)), special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_round_trip(name):
    want, texts = reference_encoding(name), odd_texts()
    for i, ids, raw in bpe.encode_texts(pa.array(texts), vocabulary(name)):
        assert ids.tolist() == want.encode_ordinary(texts[i] or "")
        assert raw == (texts[i] or "").encode()


def test_bpe_goes_on_after_the_rounds_of_one_query(monkeypatch):
    monkeypatch.setattr(bpe, "ROUNDS", 2)
    codec = bpe.Codec(vocabulary("byte_bpe_50k.tiktoken"))
    want = reference_encoding("byte_bpe_50k.tiktoken")
    words = ["internationalization", "aaaaaaaaaaaaaaaaa", "x", "Donaudampfschiff"]
    tokens = codec.encode([w.encode() for w in words]).to_pandas()
    assert [tokens[tokens.piece == i].tok.tolist() for i in range(4)] == [want.encode_ordinary(w) for w in words]
    assert codec.decode() == [w.encode() for w in words]


def test_bpe_rows(spark):
    texts = odd_texts(n=50)
    frame = spark.createDataFrame([(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens string, id int").repartition(3)
    want = reference_encoding("byte_bpe_multi_50k.tiktoken")
    got = bpe.tokens_of(frame, "doc_id", "text", vocabulary("byte_bpe_multi_50k.tiktoken")).collect()
    assert Counter((r.id, tuple(r.tokens)) for r in got) == Counter((i if i % 9 else None, tuple(want.encode_ordinary(t or ""))) for i, t in enumerate(texts))
    assert bpe.tokens_of(frame.limit(0), "doc_id", "text", vocabulary("byte_bpe_multi_50k.tiktoken")).collect() == []


def test_bpe_query(spark):
    import hashlib

    want = reference_encoding("byte_bpe_multi_50k.tiktoken")
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op8_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = want.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# ---------------------------------------------------------------------------------------------------------- packing


def reference_ids():
    from tokenizers import Tokenizer

    made = Tokenizer.from_buffer(vocabulary("word_bpe_49k.json"))
    made.encode_special_tokens = True
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    want, rng = reference_ids(), random.Random(8)
    texts = odd_texts() + ["".join(chr(rng.randrange(packing.SIMPLE)) for _ in range(50)) for _ in range(300)]
    for i, ids in packing.ids_of(pa.array(texts), vocabulary("word_bpe_49k.json")):
        assert ids.tolist() == want(texts[i])


def check_pack(rows, docs, length):
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    want = reference_ids()
    for i, t in docs.items():
        ids = [*want(t), 0]
        own = sorted(pieces.pop(i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, a, min(length, len(ids) - a)) for k, a in enumerate(range(0, len(ids), length))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[r.start: r.start + r.length], "<u4").tobytes()) for r in own]
    assert not pieces
    filled: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= length
    return len(filled), sum(filled.values())


def test_packing(spark):
    docs = dict(enumerate(odd_texts(n=200)))
    docs[10_000] = "word " * 30_000
    frame = spark.createDataFrame([(i, t, 5, "x") for i, t in docs.items()], "doc_id long, text string, length int, piece string").repartition(3)
    rows = packing.pack(frame, "doc_id", "text", vocabulary("word_bpe_49k.json"), length=256, with_ids=True).withColumnRenamed("id", "doc_id").collect()
    used, tokens = check_pack(rows, docs, 256)
    assert used <= 1.1 * tokens / 256 + 2
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    again = packing.pack(frame.union(frame), "doc_id", "text", vocabulary("word_bpe_49k.json"), length=256).count()
    assert again == 2 * len(rows)
    assert packing.pack(frame.limit(0), "doc_id", "text", vocabulary("word_bpe_49k.json")).collect() == []


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    used, tokens = check_pack(QUERIES["op10_best_fit_packing"](spark, "/root/testdata/sf0.001").collect(), docs, 2048)
    assert used <= 1.03 * tokens / 2048 + 2


@pytest.mark.parametrize("most", [1, 3, 64])
def test_open_bins(most):
    rng, bins = random.Random(most), packing.OpenBins(100, most)
    open_: dict[int, int] = {}
    for _ in range(3000):
        n = rng.randrange(1, 101)
        fits = [free for free in open_.values() if free >= n]
        bin_, offset = bins.put(n)
        if fits:  # the least free space that holds it
            assert open_[bin_] == min(fits) and offset == 100 - min(fits)
            free = open_.pop(bin_) - n
        else:
            assert bin_ not in open_ and offset == 0
            free = 100 - n
        if free:
            if len(open_) == most:  # one of the fullest closed
                full = min(open_.values())
                closed, = {b for b, f in open_.items() if f == full} - {b for b in bins.by_free.get(full, ()) if b != bin_}
                del open_[closed]
            open_[bin_] = free
        assert len(open_) <= most
