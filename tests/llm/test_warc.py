"""WARC archives: round trips, the normaliser against the standard library, damage and edges."""

import gzip
import hashlib
import io
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from doclake.llm import warc
from doclake.session import work_dir

PAGES = "page_id long, url string, html string, record binary, kind int, _first int, payload string, archive string"


def path_of(folder):
    return folder.removeprefix("file://")


def archives(folder):
    """{archive: (records file, index file)} of normalised archives."""
    found = {}
    for base, _, names in os.walk(path_of(folder)):
        for name in names:
            if name.startswith("part-"):
                archive, kind = re.search(r"archive=([^/]+)/kind=([^/]+)", base).groups()
                assert kind not in found.setdefault(archive, {}), "one file a kind"
                found[archive][kind] = open(os.path.join(base, name), "rb").read()
    return found


def members(data):
    """(offset, length, bytes) of every gzip member."""
    at, out = 0, []
    while at < len(data):
        d = zlib.decompressobj(31)
        got = d.decompress(data[at:]) + d.flush()
        assert d.eof
        size = len(data) - at - len(d.unused_data)
        out.append((at, size, got))
        at += size
    return out


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, b"x", 7, 1, "p", "a") for r in rows], PAGES).repartition(3)
    streams, out = work_dir(spark, "streams"), work_dir(spark, "archives")
    warc.write_monolithic(warc.warc_records(frame, "page_id", "url", "html"), streams)
    warc.normalize(spark, streams, out, **options)
    return streams, out


def want_of(rows):
    held = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and i is not None:
            held[data] = max(i, held.get(data, i))
    out = []
    for i, u, h in rows:
        data = (h or "").encode()
        to = held.get(data)
        to = None if to == i else to
        out.append((i, u, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def got_of(spark, out):
    got = warc.resolve_revisits(warc.read_records(spark, out)).collect()
    number = lambda s: int(s[10:-1]) if s and len(s) > 11 else None
    for r in got:
        assert r.payload_digest == "sha1:" + r.sha1 == "sha1:" + hashlib.sha1(r.payload).hexdigest()
        assert r.payload_bytes == len(r.payload)
    return sorted(((number(r.record_id), r.uri, r.payload_bytes, r.sha1, r.record_type, number(r.refers_to)) for r in got), key=str)


BIG = "ü" * 500  # 1,000 bytes
ROWS = [
    (1, "http://a/", "short"), (2, "http://b/", "short"), (3, "http://c/", BIG), (9, "http://d/", BIG), (5, None, BIG), (None, "http://e/", BIG), (9, "http://d/", BIG),
    (6, "http://f/", None), (7, "http://g/", ""), (8, "http://h/", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\n\n"), (10, "http://i/ x", "\r\n\r\n" * 400), (11, "http://j/", "\0\n" * 600),
    (12, "", BIG[:-1]), (None, None, "x" * 2000), (-4, "http://k/", BIG + "\n"), (13, "http://l/", "\n" + BIG), (14, "http://m/", "y" * (3 << 20)), (15, "http://n/", "y" * (3 << 20)), (2, "http://o/", BIG),
]


def test_round_trip(spark):
    streams, out = run(spark, ROWS)
    assert got_of(spark, out) == want_of(ROWS)
    facts = warc.record_facts(spark, out)
    assert sorted(map(str, facts.collect())) == sorted(map(str, warc.read_records(spark, out).drop("payload").collect()))


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(warc, "BITMAP", 1)
    _, out = run(spark, ROWS)
    assert got_of(spark, out) == want_of(ROWS)


def test_copies_refer_to_the_greatest_id(spark):
    rows = [(i, "u", f"{i % 990} " * 500) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id long, u string, html string")
    held = warc.with_revisits(frame, "id", "html").where("_first is not null").collect()
    assert sorted((r.id, r["_first"]) for r in held) == [(i, i + 990) for i in range(10)]


def test_streams_are_one_member_and_archives_one_a_record(spark):
    streams, out = run(spark, ROWS)
    files = [os.path.join(path_of(streams), n) for n in os.listdir(path_of(streams)) if n.endswith(".gz")]
    plain = [members(open(f, "rb").read()) for f in files]
    assert all(len(m) == 1 for m in plain)
    found = archives(out)
    entries = {(r.archive, r.offset): r for r in warc.read_index(spark, out).collect()}
    seen = 0
    for archive, kinds in found.items():
        for offset, length, record in members(kinds["records"]):
            e = entries[archive, offset]
            assert e.length == length
            head, _, rest = record.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
            assert int(re.search(rb"\nContent-Length: (\d+)", head)[1]) == len(rest) - 4
            assert f"WARC-Type: {e.record_type}".encode() in head and e.record_id.encode() in head
            seen += 1
    assert seen == len(entries) == len(ROWS)
    # the records' bytes are those of the streams
    assert sorted(gzip.decompress(k["records"]) for k in found.values()) == sorted(m[0][2] for m in plain if m[0][2])


def test_archives_begin_anew_after_some_bytes(spark):
    rows = [(i, f"http://{i}/", hashlib.sha512(str(i).encode()).hexdigest() * 20) for i in range(300)]
    _, out = run(spark, rows, most_bytes=20_000)
    found = archives(out)
    assert len(found) > 3 and all(len(k["records"]) <= 20_000 for k in found.values())
    assert got_of(spark, out) == want_of(rows)


def test_wanted_records_alone(spark):
    _, out = run(spark, ROWS)
    index = warc.read_index(spark, out).where(F.col("record_id").isin("<urn:page:8>", "<urn:page:14>"))
    got = {r.record_id: r.payload for r in warc.read_records(spark, out, index).collect()}
    assert set(got) == {"<urn:page:8>", "<urn:page:14>"}
    assert bytes(got["<urn:page:8>"]).decode() == ROWS[9][2]


def test_of_nothing(spark):
    _, out = run(spark, [])
    assert warc.read_records(spark, out).collect() == [] == warc.record_facts(spark, out).collect()


def record(kind, id, block, *more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{id}>", *more, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def foreign(spark, *files):
    folder, out = work_dir(spark, "foreign"), work_dir(spark, "archives")
    os.makedirs(path_of(folder))
    for i, data in enumerate(files):
        with open(f"{path_of(folder)}/f{i}.warc.gz", "wb") as f:
            f.write(data)
    warc.normalize(spark, folder, out)
    return out, {(r.record_id or str(n)): r for n, r in enumerate(warc.read_records(spark, out).collect())}


def test_foreign_archives(spark):
    """Members of any cut, folded headers, other record types, binary blocks, no line ends at the end."""
    blob = bytes(range(256)) * 9
    parts = [record("warcinfo", "i", b"software: x\r\n"), record("resource", "b", blob, "WARC-Target-URI: http://x/\r\n y"), record("request", "e", b""), record("metadata", "m", b"last")]
    whole = b"".join(parts)
    big = record("resource", "x", b"x" * (17 << 20))
    out, got = foreign(spark, gzip.compress(big, 1) + gzip.compress(record("resource", "y", b"y")), gzip.compress(big, 1))
    assert [r.payload_bytes for r in warc.record_facts(spark, out).orderBy("payload_bytes").collect()] == [1, 17 << 20, 17 << 20]
    out, got = foreign(spark, gzip.compress(whole[:100]) + gzip.compress(whole[100:]), gzip.compress(record("resource", "z", b"\n\n\nx\n")[:-4]))
    assert {k: bytes(r.payload) for k, r in got.items()} == {"<i>": b"software: x\r\n", "<b>": blob, "<e>": b"", "<m>": b"last", "<z>": b"\n\n\nx\n"}
    assert got["<b>"].uri == "http://x/ y" and got["<z>"].record_type == "resource"
    assert sorted(len(members(k["records"])) for k in archives(out).values()) == [1, 4]


def test_damaged_records_are_kept_as_they_are(spark):
    good = record("resource", "g", b"good")
    wrong = record("resource", "w", b"too long").replace(b"Content-Length: 8", b"Content-Length: 5")
    none = record("resource", "n", b"none").replace(b"Content-Length", b"Content-Size")
    short = record("resource", "s", b"short").replace(b"Content-Length: 5", b"Content-Length: 500")
    out, got = foreign(spark, gzip.compress(b"junk\r\nmore\r\n" + good + wrong + good.replace(b"<g>", b"<h>") + none + good.replace(b"<g>", b"<k>") + short))
    assert sorted(map(str, warc.record_facts(spark, out).collect())) == sorted(map(str, warc.read_records(spark, out).drop("payload").collect()))
    assert {k for k, r in got.items() if r.record_type != "damaged"} == {"<g>", "<h>", "<k>"}
    assert sorted(bytes(r.payload)[:8] for r in got.values() if r.record_type == "damaged") == [b"WARC/1.0", b"WARC/1.0", b"WARC/1.0", b"junk\r\nmo"]
    assert {bytes(r.payload) for r in got.values() if r.record_type == "damaged"} >= {wrong, none}


def test_member_of_sixteen_megabytes_ends_with_zero():
    big = warc.member(b"x" * (17 << 20), 1)
    assert big[-1] == 0 and big.endswith(warc.EMPTY_MEMBER)
    assert gzip.GzipFile(fileobj=io.BytesIO(big)).read() == b"x" * (17 << 20)
    assert zlib.decompress(big, 31) == b"x" * (17 << 20)


def test_revisit_without_its_record(spark):
    rows = [("revisit", "<a>", None, "<gone>", "sha1:x", 0, "s", None), (None, "<b>", None, None, None, 3, "t", None)]
    frame = spark.createDataFrame(rows, "record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, sha1 string, payload binary")
    got = {r.record_id: r for r in warc.resolve_revisits(frame).collect()}
    assert got["<a>"].sha1 is None and got["<b>"].payload_bytes == 3


@pytest.mark.parametrize("order", [1, 2])
def test_cutting_does_not_depend_on_neighbours(order):
    """Records cut from lines against records cut by their lengths."""
    blocks = [b"", b"\n", b"\r\n\r\n", b"a", b"a\n", b"\na", b"WARC/1.0\r\n\r\n", b"x\r\n" * 5]
    wanted = [record("resource", str(i), b) for i, b in enumerate(blocks * order)]
    reader, got = warc.Records(), []
    for line in b"".join(wanted).split(b"\n")[:-1]:
        if found := reader.feed(line + b"\n"):
            got.append(found)
    got.append(reader.finish())
    assert [w for _, w in got] == [w[:-4] for w in wanted]
    assert all(h for h, _ in got)
