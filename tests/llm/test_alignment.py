"""Alignment of two tokenizers against its definition on whole texts."""

import glob
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from doclake.llm import alignment, common
from doclake.llm.queries import QUERIES
from doclake.llm.queries_models import vocabulary

DOCS = "doc_id long, text string, id int, pack int, pair string, ids string, n int"
FIRST = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def first_bytes(entry):
    table, more = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[chr(b)] = b
        else:
            table[chr(256 + more)] = b
            more += 1
    return bytes(table[c] for c in entry)


def second_bytes(i):
    piece = SECOND.id_to_piece(i)
    return bytes([int(piece[1:-1], 16)]) if SECOND.is_byte(i) else piece.replace("▁", " ").encode()


def groups_by_offsets(text):
    """Groups of (A ids, B ids), by walking both lists byte by byte; None for a text without tokens."""
    if not text:
        return None
    a, b = FIRST.encode(" " + text, add_special_tokens=False).ids, SECOND.encode(text)
    a_parts, b_parts = [first_bytes(FIRST.id_to_token(i)) for i in a], [second_bytes(i) for i in b]
    whole = (" " + text).encode()
    if b"".join(a_parts) != whole or b"".join(b_parts) != whole:
        return None
    out, i, j = [], 0, 0
    while i < len(a):
        x, y = [a[i]], [b[j]]
        m, n = len(a_parts[i]), len(b_parts[j])
        i, j = i + 1, j + 1
        while m != n:
            if m < n:
                x.append(a[i])
                m, i = m + len(a_parts[i]), i + 1
            else:
                y.append(b[j])
                n, j = n + len(b_parts[j]), j + 1
        out.append((x, y))
    return out


def definition(rows):
    docs = []
    for i, text in rows:
        groups = groups_by_offsets(text) or []
        docs.append((i, groups, Counter((x, y) for a, b in groups for x in a for y in b)))
    count = Counter(p for *_, links in docs for p in links)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups, links in docs:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == most[p[0]]),
                    sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "", text))
    return sorted(out, key=str)


def rows_of(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, 1, 2, "p", "i", 3) for i, t in rows], DOCS).repartition(3)
    got = alignment.align(frame, "doc_id", "text", vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), **options)
    assert got.columns[:8] == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


EDGES = [
    None, "", " ", "  ", "\n", "\t x", "a", " a", "a ", "a  b", "a\n b", "a \n b \n\n c", "I'll we've it's 'tis 12345 1,000.50", "naïve café Übermaß", "日本語のテキスト、漢字", "कखग घ", "😀😀 a😀b", "👩‍👩‍👧 x",
    "<|endoftext|> <s> </s> <unk> <0x41>", "x▁y", "▁", "a ▁ b", "a▁ b", " a  b　c", "\x00 \x01a", "é éx", "ﬁ ﬂ", "a" * 3000, " " * 700 + "x", ("ab" * 300 + " ") * 2, "zz " * 2000,
    "x" * 255, "x" * 256, "x" * 257, "foo_bar(baz) -> {qux: 'quux'};\r\n\tif (a != b) return;", "a\x85 b  c​ d",
]


def test_against_the_definition(spark):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(3, "a"), (None, "the house of the rising sun"), (100, "the house"), (100, "the house"), (101, "The House the")]
    assert rows_of(spark, rows, with_groups=True) == definition(rows)
    assert rows_of(spark, rows) == [r[:8] for r in definition(rows)]


@pytest.mark.parametrize("pairs, texts, words, remembered", [(10, 30_000, 400_000, 256), (1_500_000, 2, 5, 256), (1_500_000, 30_000, 400_000, 0)])
def test_where_things_meet_changes_nothing(spark, monkeypatch, pairs, texts, words, remembered):
    monkeypatch.setattr(alignment, "PAIRS_TOGETHER", pairs)
    monkeypatch.setattr(alignment, "TEXTS_TOGETHER", texts)
    monkeypatch.setattr(alignment, "MOST_WORDS", words)
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    monkeypatch.setattr(alignment, "SLICE", 500)
    from doclake.llm import pieces

    monkeypatch.setattr(pieces, "worker_state", dict)  # no table from other tests
    monkeypatch.setattr(alignment, "worker_state", dict)
    rows = [(i, t) for i, t in enumerate(EDGES)] * 2
    assert rows_of(spark, rows, with_groups=True) == definition(rows)


def test_rows_held_at_once_do_not_grow_with_the_packs_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(alignment, "TEXTS_TOGETHER", 2)
    monkeypatch.setattr(alignment, "SLICE", 10)
    monkeypatch.setattr(alignment, "GROUP_BYTES", 1000, raising=False)
    folders, work_dir = [], common.work_dir
    monkeypatch.setattr(common, "work_dir", lambda *a: folders.append(work_dir(*a)) or folders[-1])
    rows = [(i, f"some words of text {i}") for i in range(60)]
    frame = spark.createDataFrame([(i, t, 1, 2, "p", "i", 3) for i, t in rows], DOCS).coalesce(1)
    got = alignment.align(frame, "doc_id", "text", vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == [r[:8] for r in definition(rows)]
    [file] = glob.glob(next(f for f in folders if "packs" in f) + "/*.parquet")
    written = pq.ParquetFile(file).metadata
    assert written.num_rows == 30 and max(written.row_group(i).num_rows for i in range(written.num_row_groups)) <= 3


def test_narrow_numbers():
    for x in ([], [0], [255, 0], [256], [1 << 16, 3], [10**10, 1], [0] * 5):
        assert alignment.widened(memoryview(alignment.narrow(np.array(x, np.int64))), len(x)).tolist() == x


def test_of_nothing(spark):
    assert rows_of(spark, []) == []
    assert rows_of(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_bytes_stand_for_themselves():
    table = alignment.byte_characters()
    assert sorted(table.values()) == list(range(256))
    assert all(first_bytes(c) == bytes([b]) for c, b in table.items())


def test_long_group_costs_its_different_ids():
    a, b = np.array([1] * 100_000 + [2]), np.array([3] * 100_000)
    group, pairs, times = alignment.links_of(a, b, np.array([100_001]), np.array([100_000]))
    assert dict(zip(pairs.tolist(), times.tolist())) == {1 * alignment.SECOND + 3: 10**10, 2 * alignment.SECOND + 3: 10**5} and len(pairs) == 2


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op11_tokenizer_alignment"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == [r[:8] for r in definition(rows)]
