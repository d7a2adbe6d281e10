"""Operators against brute force, skewed groups, damaged input, and error policies."""

import gzip
import io
import os
import random
import re
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from doclake.functions import detect as DT
from doclake.functions import text as TX
from doclake.functions import urls as U
from doclake.operators import containers as C
from doclake.operators import html as H
from doclake.operators import listing as L
from doclake.operators import markdown as M
from doclake.operators import media as ME
from doclake.operators import office
from doclake.operators import ordering as O
from doclake.operators import tables as T
from doclake.operators.convert import convert_all
from doclake.sources import fetched, files


def test_positions_are_dense_on_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k string").repartition(7)
    got = {r["id"]: r["position"] for r in O.with_position(df, F.col("k"), F.col("id")).collect()}
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want


def test_concat_raw_splits_a_hot_group(spark):
    random.seed(3)
    rows = [("hot" if i % 3 == 0 else f"g{i % 40}", i, "x" * random.randint(0, 50) + str(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, n int, t string").repartition(5)
    out = L.concat_raw(df, "g", F.col("n"), "t")
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["g"], r["start"])):
        assert r["start"] == len(got.get(r["g"], ""))
        got[r["g"]] = got.get(r["g"], "") + r["content"]
    assert {r["g"]: r["content"] for r in L.join_rows(out, "g").collect()} == got
    want = {}
    for g, _, t in sorted(rows, key=lambda r: (r[0], r[1])):
        want[g] = want.get(g, "") + t
    assert got == want


def draw(paths):
    root = {}
    for p in sorted(paths):
        node = root
        for part in [p] if "://" in p else p.split("/"):
            node = node.setdefault(part, {})
    files_ = {tuple([p] if "://" in p else p.split("/")) for p in paths}
    out = []

    def walk(node, prefix, path):
        for i, name in enumerate(sorted(node)):
            last = i == len(node) - 1
            out.append(prefix + ("└── " if last else "├── ") + name + ("" if path + (name,) in files_ else "/"))
            walk(node[name], prefix + ("    " if last else "│   "), path + (name,))

    walk(root, "", ())
    return out


def test_file_tree_against_a_recursive_drawer(spark):
    random.seed(5)
    paths = {"/".join(random.choice("abcd") + str(random.randint(0, 3)) for _ in range(random.randint(1, 6))) for _ in range(300)} | {"http://x/y", "top"}
    df = spark.createDataFrame([("g", p) for p in paths], "g string, p string")
    lines = [r["line"] for r in L.file_tree(df, "g", "p").orderBy("parts").collect()]
    assert lines == draw(paths)


def test_ignore_patterns(spark):
    paths = ["a.log", "src/a.log", "src/keep.log", "build/x.txt", "src/build/y.txt", "doc/a/b.md", "doc/c.md", "q1.tmp", "q22.tmp"]
    kept = L.ignore_filter(spark.createDataFrame([(p,) for p in paths], "path string"),
                           ["# note", "*.log", "!keep.log", "/build/", "doc/**/b.md", "q?.tmp", "!build/x.txt"]).collect()
    assert sorted(r["path"] for r in kept) == ["doc/c.md", "q22.tmp", "src/build/y.txt", "src/keep.log"]


def test_select_covered(spark):
    files_ = spark.createDataFrame([(p,) for p in ["a/x", "a/b/y", "ab/z", "c/w"]], "path string")
    chosen = spark.createDataFrame([("a",), ("a/x",), ("c/w",)], "path string")
    assert sorted(r["path"] for r in L.select_covered(files_, chosen).collect()) == ["a/b/y", "a/x", "c/w"]


@pytest.mark.parametrize("mode,reverse,want", [
    ("name", False, ["d", "A.txt", "b.md", "c.txt"]), ("name", True, ["c.txt", "b.md", "A.txt", "d"]),
    ("size", False, ["d", "b.md", "c.txt", "A.txt"]), ("type", False, ["d", "b.md", "A.txt", "c.txt"]), ("time", True, ["b.md", "c.txt", "A.txt", "d"])])
def test_list_sorted(spark, mode, reverse, want):
    rows = [("c.txt", False, 5, 2), ("d", True, None, 9), ("A.txt", False, 7, 1), ("b.md", False, None, 3)]
    df = spark.createDataFrame(rows, "p string, d boolean, s bigint, m int")
    out = L.list_sorted(df, "p", "d", "s", "m", mode, reverse).orderBy("position").collect()
    assert [r["p"] for r in out] == want


def make_zip(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, d in members:
            z.writestr(n, d)
    return b.getvalue()


def make_tar(members):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w") as t:
        for n, d in members:
            info = tarfile.TarInfo(n)
            info.size = len(d)
            t.addfile(info, io.BytesIO(d))
    return b.getvalue()


def test_damaged_archives_become_error_rows(spark):
    good = make_zip([("a.txt", b"1"), ("__MACOSX/a", b"2"), ("d/", b"")])
    df = spark.createDataFrame([("g", bytearray(good)), ("b", bytearray(good[:20])), ("n", bytearray(b"plain"))], "path string, content binary")
    rows = {(r["path"], r["member"]): r["error"] for r in C.archive_members(df).collect()}
    assert rows[("g", "a.txt")] is None and "BadZipFile" in rows[("b", None)] and len(rows) == 2


def test_nested_archives_open_at_any_depth(spark):
    inner = make_zip([("x.txt", b"deep")])
    outer = make_tar([("in.zip.gz", gzip.compress(make_zip([("in.zip", inner)]))), ("p.txt", b"flat")])
    df = spark.createDataFrame([("o.tar", bytearray(outer))], "path string, content binary")
    assert {r["member"]: bytes(r["content"]) for r in C.expand_nested(df).collect()} == {"in.zip.gz/in.zip/x.txt": b"deep", "p.txt": b"flat"}
    deep, path = b"innermost", "x.txt"
    for level in range(20):
        deep, path = make_zip([(path.split("/")[0] if not level else f"l{level}.zip", deep)]), path if not level else f"l{level}.zip/{path}"
    df = spark.createDataFrame([("o.zip", bytearray(deep))], "path string, content binary")
    assert [(r["member"], bytes(r["content"]), r["error"]) for r in C.expand_nested(df).collect()] == [(path, b"innermost", None)]
    whole = {r["path"]: r["markdown"] for r in convert_all(df).collect()}
    assert "innermost" in whole["o.zip"]


def test_damaged_inner_archives_are_rows_of_their_own(spark):
    outer = make_zip([("bad.zip", inner_bytes := make_zip([("x.txt", b"deep" * 50)])[:60]), ("p.txt", b"flat")])
    assert inner_bytes
    df = spark.createDataFrame([("o.zip", bytearray(outer))], "path string, content binary")
    got = {r["member"]: (r["content"] and bytes(r["content"]), bool(r["error"])) for r in C.expand_nested(df).collect()}
    assert got["p.txt"] == (b"flat", False)
    assert (None, True) in got.values()


def test_office_files_in_a_zip_do_not_make_it_one(spark):
    docx = make_zip([("[Content_Types].xml", b"<Types/>"), ("word/document.xml", b"<w:document/>")])
    rows = [("holds.zip", make_zip([("report.docx", docx), ("n.txt", b"note")])), ("r.bin", docx), ("odd.bin", make_zip([("word/document.xml", b"x"), ("[Content_Types].xml", b"y")]))]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r["path"]: r["f"] for r in df.select("path", DT.detect_format(F.col("content"), F.lit("")).alias("f")).collect()}
    assert got == {"holds.zip": "zip", "r.bin": "docx", "odd.bin": "docx"}
    assert "note" in {r["path"]: r["markdown"] for r in convert_all(df.filter("path = 'holds.zip'")).collect()}["holds.zip"]


def test_decompress_reports_damage(spark):
    df = spark.createDataFrame([(1, bytearray(gzip.compress(b"hi"))), (2, bytearray(b"\x1f\x8b\x08xx")), (3, bytearray(b"raw"))], "path int, content binary")
    out = {r["path"]: (r["content"] and bytes(r["content"]), bool(r["error"])) for r in C.decompress(df).collect()}
    assert out == {1: (b"hi", False), 2: (None, True), 3: (b"raw", False)}


def test_convert_all_reports_what_it_cannot_convert(spark):
    rows = [("a.rs", b"fn x() {}"), ("b.md", b"# t"), ("bad.docx", b"PK\x03\x04junk"), ("old.xls", bytes.fromhex("D0CF11E0A1B11AE1")), ("x.bin", b"\xff\xfe\x00"),
            ("r.csv", b"a,b\n1\n"), ("p.png", b"\x89PNG\r\n\x1a\n"), ("z.zip", make_zip([("q/r.md", b"# in"), ("s.csv", b"a;b\n1;2\n")]))]
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "path string, content binary")
    out = {r["path"]: (r["markdown"], r["error"]) for r in convert_all(df).collect()}
    assert out["a.rs"] == ("```rs\nfn x() {}\n```", None) and out["b.md"] == ("# t", None) and out["p.png"] == ("![Image](p.png)", None)
    assert out["x.bin"] == ("[bin file](x.bin)", None)
    assert all(out[n][0] is None and out[n][1] for n in ("bad.docx", "old.xls", "r.csv"))
    from doclake.operators.convert import convert_sections

    rows = sorted((r["path"], r["section"], r["parts"], r["text"] or "", r["error"]) for r in convert_sections(df).collect())
    for path, (markdown, error) in out.items():
        mine = [r for r in rows if r[0] == path]
        assert (markdown or "") == ("".join(r[3] for r in mine) if error is None else "") and any(r[4] for r in mine) == bool(error)
    assert [r[1:3] for r in rows if r[0] == "z.zip"] == [(0, []), (1, ["q"]), (1, ["q", "r.md"]), (1, ["s.csv"]), (2, []), (3, ["q/r.md"]), (3, ["s.csv"])]
    assert out["z.zip"][0] == ("```file-tree\n├── q/\n│   └── r.md\n└── s.csv\n```\n\n# File: q/r.md\n\n# in\n\n"
                               "# File: s.csv\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n\n")


def test_error_policies(spark):
    df = spark.createDataFrame([(1, None), (2, "status")], "id int, error_class string")
    good, bad = fetched.split_errors(df)
    assert [r["id"] for r in good.collect()] == [1] and [r["id"] for r in bad.collect()] == [2]
    with pytest.raises(Exception, match="bad input"):
        fetched.split_errors(df, policy="fail")[0].collect()


def test_hidden_files(spark, tmp_path):
    for name in (".hidden", "_under", "plain.txt", "sub/.deep/x.md"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    seen = files.scan_files(spark, str(tmp_path), hidden=True)
    assert sorted(r["rel"] for r in seen.collect()) == [".hidden", "_under", "plain.txt", "sub/.deep/x.md"]
    assert [r["rel"] for r in files.scan_files(spark, str(tmp_path), max_depth=1).collect()] == ["plain.txt"]
    assert "content" not in files.scan_files(spark, str(tmp_path), with_content=False).columns


def test_media_ties_and_relative_sizes(spark):
    html = ('<div width="100" height="50"><img src="a" width="50%" height="100%"><p>unclosed</div><img src="b" width="50%" height="1px">'
            '<img src="c" width="5" height="500"><img src="d" width="4"><img src="e" style="max-width:10px;width:99px;height:2em">')
    df = spark.createDataFrame([(1, "http://h/x/", html)], "id int, url string, html string")
    cands = ME.media_candidates(df, "id", "url", "html")
    assert {r["url"][-1]: (r["width"], r["height"]) for r in cands.collect()} == {
        "a": (50, 50), "b": (960, 1), "c": (5, 500), "d": (0, 0), "e": (10, 28)}
    assert ME.biggest_media(cands).first()["url"] == "http://h/x/c"  # a and c tie, the later one wins


@pytest.mark.parametrize("ref,want", [
    ("../q", "http://h.org/a/q"), ("./r/../s", "http://h.org/a/b/s"), ("/", "http://h.org/"), ("", "http://h.org/a/b/c?k=1"), ("HTTPS://X.org:443/y z", "https://x.org/y%20z"),
    ("../../../../up", "http://h.org/up"), ("ü", "http://h.org/a/b/%C3%BC"), ("mailto:x@y", "mailto:x@y"), ("#f", "http://h.org/a/b/c?k=1#f"), ("d/..", "http://h.org/a/b/")])
def test_resolve_url(spark, ref, want):
    df = spark.createDataFrame([("http://H.org:80/a/b/c?k=1#z", ref)], "b string, r string")
    assert df.select(U.resolve_url(F.col("b"), F.col("r"))).first()[0] == want


def test_fences_hide_everything_inside(spark):
    md = "# real\n\n````md\n# no\n```\n[x](y)\n```\n````\n\n~~~\n# no\n```\n~~~\n[a](b) `[c](d)`\n\n```\nunclosed # no\n"
    df = spark.createDataFrame([(1, md)], "id int, md string")
    assert [r["text"] for r in M.md_headings(df, "id", "md").collect()] == ["real"]
    assert [r["url"] for r in M.md_links(df, "id", "md").collect()] == ["b"]
    assert [r["code"] for r in M.md_code_blocks(df, "id", "md").orderBy("pos").collect()] == ["# no\n```\n[x](y)\n```", "# no\n```", "unclosed # no\n"]


def toc(levels):
    low = min(levels)
    d = [x - low for x in levels]
    out = []
    for i, depth in enumerate(d):
        def later(col, i=i):
            for x in d[i + 1:]:
                if x < col:
                    return False
                if x == col:
                    return True
            return False

        if depth == 0:
            out.append(("\n" if i and d[i - 1] > 0 else "") + f"t{i}")
        else:
            out.append("".join("│ " if later(c) else "  " for c in range(1, depth)) + ("├─ " if later(depth) else "└─ ") + f"t{i}")
    return out


def test_toc_against_a_scan(spark):
    random.seed(9)
    docs = {k: [random.randint(1, 6) for _ in range(random.randint(1, 25))] for k in range(30)}
    df = spark.createDataFrame([(k, i, lv, f"t{i}") for k, ls in docs.items() for i, lv in enumerate(ls)], "doc_id int, pos int, level int, text string")
    got = {}
    for r in M.md_toc(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["line"])
    assert got == {k: toc(ls) for k, ls in docs.items()}


def test_list_depth_follows_indentation(spark):
    md = "- a\n  - b\n      - c\n  - d\n- e\n   1. f\n   2. g\n\n   more g\n\ntext\n\n7) h\n8) i"
    out = M.md_list_items(spark.createDataFrame([(1, md)], "id int, md string"), "id", "md").orderBy("pos").collect()
    assert [(r["text"][0], r["depth"], r["number"]) for r in out] == [
        ("a", 0, None), ("b", 1, None), ("c", 2, None), ("d", 1, None), ("e", 0, None), ("f", 1, 1), ("g", 1, 2), ("h", 0, 7), ("i", 0, 8)]
    assert out[6]["text"] == "g\n\nmore g"


def test_delimited_edge_cases(spark):
    rows = [("q", 'a,b\n"x\ny",""\n,"p""q"\n'), ("t", "a\tb\r\n1\t\r\n"), ("one", "solo\nv\n"), ("rag", "a,b\n1,2,3\n")]
    cells, bad = T.read_delimited(spark.createDataFrame(rows, "path string, content string"))
    got = {(r["path"], r["row_no"], r["col_no"]): r["value"] for r in cells.collect()}
    assert got[("q", 1, 0)] == "x\ny" and got[("q", 1, 1)] == "" and got[("q", 2, 0)] == "" and got[("q", 2, 1)] == 'p"q'
    assert got[("t", 1, 1)] == "" and got[("one", 1, 0)] == "v" and [r["path"] for r in bad.collect()] == ["rag"]


def test_escape_and_blanks(spark):
    df = spark.createDataFrame([("a < b <Zed> <b>x</b> `<i>` <br/>", "p\n \n\t\n\n  q\n\nr")], "m string, t string")
    row = df.select(TX.escape_unknown(F.col("m")), TX.collapse_blanks(F.col("t")), TX.decode_entities(F.lit("&amp;lt; &#8364;"))).first()
    assert row[0] == "a &lt; b &lt;Zed&gt; <b>x</b> `&lt;i&gt;` &lt;br/&gt;" and row[1] == "p\n\nq\n\nr" and row[2] == "&lt; €"


def test_ansi(spark):
    df = spark.createDataFrame([("\x1b[1;31mred\x1b[0m \x1b]8;;http://x\x07link\x1b]8;;\x07",)], "t string")
    assert tuple(df.select(TX.strip_ansi(F.col("t")), TX.visible_length(F.col("t"))).first()) == ("red link", 8)


def test_latest_keeps_the_highest_version_over_batches(spark, tmp_path):
    from doclake.streaming import ingest

    folder, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    rows = [[("a", 5, "new"), ("b", 1, "one")], [("a", 3, "late"), ("c", 1, "x")], [("b", 2, "two"), ("a", 4, "late too")]]
    for part in rows:
        spark.createDataFrame(part, "k string, v int, t string").coalesce(1).write.mode("append").parquet(folder)
        ingest.stream_latest(spark, folder, out, ckpt, "k string, v int, t string", "k", ["v"], ["t"])
    assert {r["k"]: r["t"] for r in ingest.read_latest(spark, out, "k").collect()} == {"a": "new", "b": "two", "c": "x"}
    assert len(ingest.state_folders(spark, out)) == 2


def test_relative_paths_where_the_root_repeats(spark, tmp_path):
    root = tmp_path / "r"
    deep = root / str(root).lstrip("/") / "x"
    deep.mkdir(parents=True)
    (deep / "f.txt").write_text("x")
    assert [r["rel"] for r in files.scan_files(spark, str(root)).collect()] == [f"{str(root).lstrip('/')}/x/f.txt"]


STRAY = [
    ("<p>a</p></table><h1>T</h1><p>b</p><p>c</p>", "a\n\n# T\n\nb\n\nc"), ("<p>a</p></pre><p>b</p>", "a\n\nb"),
    ("</blockquote><blockquote><p>q</p></blockquote>", "> q"), ("<div></div>", ""), ("", ""),
    ("<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr></table>", "| a<br>\\| in \\|<br>\\| --- \\| | b |\n| --- | --- |"),
    ("<p>&#9999999; &#xD800; &#0; &#38;lt; &eacute; &rarr; &#x0000041; &nosuch;</p>", "� � � &lt; é → A &nosuch;")]


def test_stray_tags_nested_tables_and_references(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(STRAY)], "id int, h string")
    got = {r["doc_id"]: r["markdown"] for r in H.html_to_markdown(df, "id", "h").collect()}
    assert [got[i] for i in range(len(STRAY))] == [m for _, m in STRAY]
    least = H.html_nesting(df, "id", "h").agg(*[F.min(c) for c in ("in_list", "in_table", "in_quote", "in_pre", "in_heading", "in_link")]).first()
    assert all(x >= 0 for x in least)


def test_unclosed_links_and_headings_stay(spark):
    df = spark.createDataFrame([(1, "<h2>one <a href=x>here<h3>two</h3><a href=y>there</a>")], "id int, h string")
    assert [(r["href"], r["text"]) for r in H.html_links(df, "id", "h").orderBy("link_no").collect()] == [("x", "heretwo"), ("y", "there")]
    assert [r["level"] for r in H.html_headings(df, "id", "h").orderBy("heading_no").collect()] == [2, 3]


@pytest.mark.parametrize("unit", ["x", "<a href=x>", "<h1>", "<!-- ", "<script>", ":::x\n", "[", "x "])
def test_a_megabyte_of_anything_takes_seconds(spark, unit):
    import time

    df = spark.createDataFrame([(1, unit * (1_000_000 // len(unit)))], "id int, t string")
    start = time.time()
    for job in (H.html_text(df, "id", "t"), H.html_links(df, "id", "t"), H.html_headings(df, "id", "t"), M.md_headings(df, "id", "t"), M.md_code_blocks(df, "id", "t")):
        job.write.format("noop").mode("overwrite").save()
    assert time.time() - start < 60


def test_streams_that_nothing_reaches_leave_empty_tables(spark, tmp_path):
    from doclake.streaming import ingest

    folder, pages = str(tmp_path / "in"), "page_id long, html string"
    (tmp_path / "in").mkdir()
    out = {n: str(tmp_path / n) for n in ("links", "files", "latest")}
    ingest.stream_links(spark, folder, out["links"], str(tmp_path / "c1"), pages, "none*")
    ingest.stream_ingest(spark, folder, out["files"], str(tmp_path / "c2"))
    ingest.stream_latest(spark, folder, out["latest"], str(tmp_path / "c3"), "k string, v int, t string", "k", ["v"], ["t"])
    assert "href" in spark.read.parquet(out["links"]).columns and spark.read.parquet(out["links"]).count() == 0
    assert "markdown" in spark.read.parquet(out["files"]).columns and spark.read.parquet(out["files"]).count() == 0
    assert ingest.read_latest(spark, out["latest"], "k").columns == ["k", "t"] and ingest.read_latest(spark, out["latest"], "k").count() == 0
    spark.createDataFrame([("a", 1, "x")], "k string, v int, t string").write.mode("append").parquet(folder)
    ingest.stream_latest(spark, folder, out["latest"], str(tmp_path / "c3"), "k string, v int, t string", "k", ["v"], ["t"])
    assert [tuple(r) for r in ingest.read_latest(spark, out["latest"], "k").collect()] == [("a", "x")]


def test_references_take_the_first_definition_of_their_document(spark):
    md = ("[a][X] [b][] [c]\n\n[x]: one 't1'\n[X]: two\n[ B ]: <b c> \n\npara\n[c]: not a definition\n\n- item\n[c]: nor here\n\n> q\n[c]: nor here\n\n"
          "```\n[c]: code\n```\n[^n]: note\n[d]:\n\n<hh:x> <x@y.z> <not a link> `<hh:code>` \\n")
    docs = spark.createDataFrame([(1, md), (2, "[a][x] [x]"), (3, None), (4, "[x]: only"), (5, "[c] ![c][] [![c]][c]\n\n[C]: (u)")], "id int, md string")
    got = [(r["doc_id"], r["kind"], r["url"], r["title"]) for r in M.md_links(docs, "id", "md").orderBy("doc_id", "pos", "n").collect()]
    assert got == [(1, "reference", "one", "a"), (1, "reference", "b c", "b"), (1, "auto", "hh:x", "hh:x"), (1, "auto", "mailto:x@y.z", "x@y.z"),
                   (5, "reference", "(u)", "c"), (5, "reference", "(u)", "![c]")]
    html = {r["doc_id"]: r["html"] for r in M.md_to_html(docs, "id", "md").collect()}
    assert html[1].startswith('<p><a href="one" title="t1">a</a> <a href="b c">b</a> [c]</p>\n<p>para\n[c]: not a definition</p>\n')
    assert html[2] == "<p>[a][x] [x]</p>\n" and html[3] == "" == html[4]
    assert html[5] == '<p><a href="(u)">c</a> <img src="(u)" alt="c" /> <a href="(u)"><img src="(u)" alt="c" /></a></p>\n'
    assert [(r["doc_id"], r["label"], r["url"], r["title"]) for r in M.md_definitions(docs, "id", "md").orderBy("doc_id", "pos").collect()] == [
        (1, "x", "one", "t1"), (1, "b", "b c", None), (4, "x", "only", None), (5, "c", "(u)", None)]


@pytest.mark.parametrize("md,want", [
    ("**a `*` b**", "<strong>a <code>*</code> b</strong>"), ("*x [y](u_v_w) z*", '<em>x <a href="u_v_w">y</a> z</em>'), ("[*x*](a*b*c)", '<a href="a*b*c"><em>x</em></a>'),
    ("![a_b_](c_d_e 'f\"g')", '<img src="c_d_e" alt="a_b_" title="f&quot;g" />'), ("`[a](b)` ![", "<code>[a](b)</code> !["), ("[a](b c) [d]()", '[a](b c) <a href="">d</a>'),
    ("a \ufdd01\ufdd1 b", "a 1 b"), ("[x](<y> \"t\")", '<a href="y" title="t">x</a>'), ("1 < 2 & <3", "1 &lt; 2 &amp; &lt;3")])
def test_inline_markup_leaves_literals_alone(spark, md, want):
    docs = spark.createDataFrame([(1, md)], "id int, md string")
    assert M.md_to_html(docs, "id", "md").first()["html"] == f"<p>{want}</p>\n"


def test_levels_below_the_depth_are_never_listed(spark, tmp_path):
    for p in ("a.txt", "d1/b.txt", "d1/d2/c.txt", "d1/d2/d3/e.txt", ".h/x", "_u/y", "d1/.z"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    (tmp_path / "d1" / "up").symlink_to(tmp_path)  # comes back
    (tmp_path / "aside").symlink_to(tmp_path / "d1" / "d2")
    seen = {r["rel"]: r["depth"] for r in files.walk(spark, str(tmp_path), max_depth=2).collect()}
    assert seen == {"a.txt": 1, "d1": 1, "aside": 1, "d1/b.txt": 2, "d1/d2": 2, "aside/c.txt": 2, "aside/d3": 2}
    assert sorted(r["rel"] for r in files.walk(spark, str(tmp_path), hidden=True).where("not is_dir").collect()) == [
        ".h/x", "_u/y", "a.txt", "aside/c.txt", "aside/d3/e.txt", "d1/.z", "d1/b.txt", "d1/d2/c.txt", "d1/d2/d3/e.txt"]
    got = {r["rel"]: (bytes(r["content"]).decode(), r["length"], r["path"]) for r in files.scan_files(spark, f"file://{tmp_path}", max_depth=2).collect()}
    assert got == {p: (c, len(c), f"{tmp_path}/{p}") for p, c in (("a.txt", "a.txt"), ("d1/b.txt", "d1/b.txt"), ("aside/c.txt", "d1/d2/c.txt"))}
    assert files.walk(spark, str(tmp_path / "none")).collect() == []


def test_one_deep_folder_is_read_by_all_tasks(spark, tmp_path):
    folder = tmp_path / "a" / "b" / "c"
    folder.mkdir(parents=True)
    for i in range(2000):
        (folder / f"f{i}.txt").write_bytes(b"%d" % i)
    out = files.scan_files(spark, str(tmp_path), hidden=True)
    tasks = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 500
    assert out.agg(F.sum(F.col("content").cast("string").cast("long"))).first()[0] == sum(range(2000))


def test_stores_that_tasks_cannot_open_are_left_to_spark(spark, tmp_path):
    assert files.is_open("/x") and files.is_open("s3a://b/x") and not files.is_open("viewfs://c/x")
    with pytest.raises(ValueError):
        files.scan_files(spark, "viewfs://c/x", hidden=True)


IGNORE_TREE = {
    ".gitignore": "# c\n*.log\n!keep.log\n/build/\ndoc/**/b.md\nq?.tmp\n\\#odd\n\\!odd2\ntrail  \n[ab][!c].x\n**/deep/*.y\nend/**\nx**y\n",
    "src/.gitignore": "!*.log\nonly/\n/top.txt\nsub/inner.txt\n", "src/sub/.gitignore": "*.log\n!inner.txt\n", "build/.gitignore": "!*\n", "doc/.gitignore": "!b.md\n"}
IGNORE_PATHS = ["a.log", "keep.log", "src/a.log", "src/sub/a.log", "src/sub/keep.log", "src/only/z", "src/x/only", "src/only.txt", "src/top.txt", "src/sub/top.txt", "src/sub/inner.txt", "build/x", "src/build/x",
                "doc/b.md", "doc/a/b.md", "doc/a/c/b.md", "other/doc/b.md", "q1.tmp", "q12.tmp", "s/q2.tmp", "#odd", "!odd2", "trail", "trail  ", "ad.x", "ac.x", "bb.x", "bd/f", "deep/1.y", "p/deep/2.y", "p/deep/r/3.y",
                "end/1", "end/2/3", "p/end/1", "xy", "xay", "x/y", "ünï.log", "a(b).log", "d.log/inside"]


def test_ignore_files_of_the_tree_against_git(spark, tmp_path):
    import shutil
    import subprocess

    if not shutil.which("git"):
        pytest.skip("no git")
    for p in [*IGNORE_TREE, *IGNORE_PATHS]:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(IGNORE_TREE.get(p, "x"))
    run = lambda *a, **k: subprocess.run(["git", "-C", str(tmp_path), *a], capture_output=True, text=True, **k)
    run("init", "-q")
    want = set(run("-c", "core.quotePath=false", "ls-files", "-z", "--others", "--exclude-standard").stdout.split("\0")) - {"", *IGNORE_TREE}
    tree = files.scan_files(spark, str(tmp_path), hidden=True).where("rel NOT LIKE '.git/%'")
    got = L.ignore_by_rules(tree.select("rel"), L.ignore_rules(tree, "rel"), "rel")
    assert {r["rel"] for r in got.collect()} - set(IGNORE_TREE) == want


def test_ignore_files_by_name_and_without_any(spark):
    paths = spark.createDataFrame([(p, i) for i, p in enumerate(["a/x.txt", "a/y.txt", "a/b/x.txt", "/z.txt", "a/x.txt"])], "path string, n int")
    rules = L.ignore_rules(spark.createDataFrame([("a/.ignore", "*.txt\n!y.txt"), ("a/b/.gitignore", "!x.txt"), (".gitignore", "y.txt\nz.txt"), ("b.txt", "*")], "path string, content string"))
    assert [tuple(r) for r in L.ignore_by_rules(paths, rules).collect()] == [("a/y.txt", 1)]
    none = L.ignore_rules(spark.createDataFrame([], "path string, content string"))
    assert L.ignore_by_rules(paths, none).count() == 5


NESTED_TABLES = [
    ("<table><tr><td>a <table><tr><th>x</th><td align=right>1</td></tr><tr><td>y</td></tr></table> z</td><td>b</td></tr><tr><td>c</td></tr></table>",
     "| a<br>\\| x \\| 1 \\|<br>\\| --- \\| ---: \\|<br>\\| y \\|  \\|<br>z | b |\n| --- | --- |\n| c |  |"),
    ("<table><tr><td><table><tr><td>1</td></tr></table><table><tr><td>2</td></tr></table><table></table></td></tr></table>",
     "| \\| 1 \\|<br>\\| --- \\|<br>\\| 2 \\|<br>\\| --- \\| |\n| --- |"),
    ("<table><tr><td>a<table><tr><td>open", "| a<br>\\| open \\|<br>\\| --- \\| |\n| --- |"), ("</table><table><tr><td>q</td></tr></table></table><p>r</p>", "| q |\n| --- |\n\nr")]


def nested_table(rows):
    """A table of cells, each a list of texts and tables, as the lines of a pipe table."""
    grid = []
    for row in rows:
        cells = []
        for cell in row:
            text = "".join(part if isinstance(part, str) else "\n" + "\n".join(nested_table(part)) + "\n" for part in cell)
            cells.append("<br>".join(x.strip() for x in text.strip().replace("|", r"\|").split("\n") if x.strip()))
        grid.append(cells)
    width = max(map(len, grid))
    lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in grid]
    return [lines[0], f"| {' | '.join(['---'] * width)} |", *lines[1:]]


def table_html(rows):
    return "<table>" + "".join("<tr>" + "".join("<td>" + "".join(p if isinstance(p, str) else table_html(p) for p in c) + "</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def test_tables_inside_cells(spark):
    random.seed(11)

    def some(depth):
        return [[[random.choice(["a", "b|c", "x"])] + ([some(depth - 1)] if depth and random.random() < 0.5 else []) + (["t"] if random.random() < 0.3 else [])
                 for _ in range(random.randint(1, 3))] for _ in range(random.randint(1, 3))]

    tables = [some(3) for _ in range(30)]
    rows = [(i, h) for i, (h, _) in enumerate(NESTED_TABLES)] + [(100 + i, table_html(t)) for i, t in enumerate(tables)]
    got = {r["doc_id"]: r["markdown"] for r in H.html_to_markdown(spark.createDataFrame(rows, "id int, h string"), "id", "h").collect()}
    assert [got[i] for i in range(len(NESTED_TABLES))] == [m for _, m in NESTED_TABLES]
    assert [got[100 + i] for i in range(len(tables))] == ["\n".join(nested_table(t)) for t in tables]


def test_unclosed_tags_nest_nothing(spark):
    page = '<div width="200" height="100"><p><img src="a" width="50%" height="50%"></p><div width="80" height="40"><img src="b" width="50%" height="50%"></div></div><img src="c" width="50%" height="10">'
    want = {"a": (100, 50), "b": (40, 20), "c": (960, 10)}
    broken = [page, "<div>" + page, page + "</div></p>", "</div></span>" + page, page.replace("</div></div>", "</div></b></div>"),
              "<div width=9 height=9><b>" + page + "<i>"]
    df = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(broken)], "id int, url string, html string")
    got = {}
    for r in ME.media_candidates(df, "id", "url", "html").collect():
        got.setdefault(r["doc_id"], {})[r["url"][-1]] = (r["width"], r["height"])
    assert got == {i: want for i in range(len(broken))}


def test_pairs_of_tags_against_a_stack(spark):
    random.seed(4)
    pages = []
    for i in range(200):
        pages.append((i, "".join(random.choice(["<a>", "</a>", "<b>", "</b>", "<img width=1>"]) for _ in range(random.randint(1, 25)))))
    got = {(r["doc_id"], r["pos"]): r["nests"] for r in ME._element_rows(spark.createDataFrame(pages, "id int, h string"), "id", "h").collect()}
    for i, page in pages:
        stacks, paired = {"a": [], "b": []}, set()
        tokens = [t + ">" for t in page.split(">")[:-1]]
        for pos, t in enumerate(tokens):
            name = t.strip("</>")
            if t.startswith("</") and stacks[name]:
                paired.add(stacks[name].pop())
            elif not t.startswith("</") and name in stacks:
                stacks[name].append(pos)
        opens = [pos for pos, t in enumerate(tokens) if not t.startswith("</")]
        seen = sorted(k for k in got if k[0] == i)
        assert [got[k] for k in seen] == [int(pos in paired) for pos in opens]


def test_archives_read_by_their_directories(spark, tmp_path):
    from doclake.sources import archives as A

    random.seed(2)
    bodies = {f"d{i % 7}/f{i}.txt": random.randbytes(random.randint(0, 3000)) for i in range(400)}
    (tmp_path / "a.zip").write_bytes(make_zip(list(bodies.items()) + [("__MACOSX/x", b"no"), ("d/", b""), ("._y", b"no")]))
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in bodies.items():
            z.writestr(n, d * 3)
    (tmp_path / "c.tar").write_bytes(make_tar(list(bodies.items()) + [("n" * 150, b"long name")]))
    (tmp_path / "n.tar").write_bytes(make_tar([("in.zip.gz", gzip.compress(make_zip([("x.txt", b"deep"), ("y.zip", make_zip([("z", b"deeper")]))]))), ("p.txt", b"flat")]))
    (tmp_path / "bad.zip").write_bytes(make_zip([("q", b"1")])[:40])
    broken = bytearray(make_zip([("ok", b"fine" * 50), ("hurt", b"x" * 100)]))
    broken[broken.index(b"x" * 100)] = 0
    (tmp_path / "hurt.zip").write_bytes(bytes(broken))
    (tmp_path / "plain.txt").write_text("plain")
    (tmp_path / "empty.zip").write_bytes(make_zip([]))
    found = files.scan_files(spark, str(tmp_path), hidden=True)
    whole, seek = C.archive_members(found), A.scan_archives(found.drop("content"))
    rows = lambda df: sorted(((r["path"], r["member"], r["ext"], r["content"] and bytes(r["content"])) for r in df.where("error is null").collect()), key=str)
    assert rows(seek) == rows(whole) and len(rows(seek)) > 1200
    errors = lambda df: sorted((r["path"].rsplit("/", 1)[-1], r["member"]) for r in df.where("error is not null").collect())
    assert errors(seek) == errors(whole) == [("bad.zip", None), ("hurt.zip", "hurt")]
    assert rows(A.scan_archives(found.drop("content"), nested=True)) == rows(C.expand_nested(found))
    one = A.scan_archives(found.drop("content").where("path like '%/a.zip'")).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(one) == 8 and max(r["count"] for r in one) < 100


def test_an_archive_larger_than_a_cell(spark, tmp_path):
    """A zip above 2 GB: its members lie behind holes of a sparse file, so nothing of that size is written or read."""
    from doclake.sources import archives as A

    path = tmp_path / "big.zip"
    with open(path, "wb") as f, zipfile.ZipFile(f, "w") as z:
        z.writestr("first.txt", b"at the start")
    with open(path, "r+b") as f:
        data = f.read()
        directory = data.index(b"PK\x01\x02")
        hole = 3 << 30
        # the directory moves behind the hole; offsets stay those of the members
        end = bytearray(data[data.index(b"PK\x05\x06"):])
        end[16:20] = (directory + hole).to_bytes(4, "little")
        f.seek(directory + hole)
        f.write(data[directory: data.index(b"PK\x05\x06")] + bytes(end))
        f.truncate()
    assert path.stat().st_size > 3 << 30
    got = A.scan_archives(spark.createDataFrame([(str(path),)], "path string")).collect()
    assert [(r["member"], bytes(r["content"]), r["error"]) for r in got] == [("first.txt", b"at the start", None)]


def test_conversion_reads_its_input_once(spark, tmp_path):
    from doclake.operators import convert

    found = [(f"f{i}.md", bytearray(b"# t")) for i in range(5)] + [("z.zip", bytearray(make_zip([("a.md", b"a"), ("bad.csv", b"a,b\n1\n")]))), ("e.zip", bytearray(make_zip([])))]
    spark.createDataFrame(found, "path string, content binary").write.parquet(str(tmp_path / "in"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = spark.read.parquet(str(tmp_path / "in")).mapInArrow(count, "path string, content binary")
    rows = convert.convert_sections(counted).collect()
    assert seen.value == len(found)
    assert {(r["path"], r["section"], r["error"] is not None) for r in rows if r["path"] == "z.zip"} == {("z.zip", 0, False), ("z.zip", 1, False), ("z.zip", 2, False), ("z.zip", 3, False), ("z.zip", 4, True)}
    assert [r["text"] for r in rows if r["path"] == "e.zip"] == ["```file-tree\n```\n\n"]


def test_packing_and_unpacking_hold_one_file_at_a_time():
    """Python objects and batches handed on stay bounded however many rows an Arrow batch brings."""
    import tracemalloc

    import pyarrow as pa

    from doclake.plans import fixtures as X

    body = random.Random(3).randbytes(10_000)
    entries = [[{"name": f"m{m}", "body": body} for m in range(2)]] * 3000
    full = pa.RecordBatch.from_arrays([
        pa.array([f"f{i}" for i in range(3000)]), pa.array(entries, pa.list_(pa.struct([("name", pa.string()), ("body", pa.binary())]))), pa.array(["tar", "zip", "zip"] * 1000)], ["path", "entries", "kind"])
    tracemalloc.start()
    try:
        for step in (X.packed, C._explode(False), C._explode(True)):
            kept = [] if step is X.packed else None
            rows = 0
            tracemalloc.reset_peak()
            for b in step(iter([full])):
                assert b.num_rows <= C.BATCH_ROWS and b.nbytes < 2 * C.BATCH_BYTES
                rows += b.num_rows
                if kept is not None:
                    kept.append(b)
            assert rows == (3000 if kept is not None else 6000)
            assert tracemalloc.get_traced_memory()[1] < 4 * C.BATCH_BYTES
            full = pa.Table.from_batches(kept).combine_chunks().to_batches()[0] if kept is not None else full
    finally:
        tracemalloc.stop()


def test_files_of_any_size_are_read_in_blocks(spark, tmp_path):
    bodies = {"a.bin": random.Random(4).randbytes(2500), "d/.b.bin": b"x" * 1000, "d/empty": b"", "d/small": b"1"}
    (tmp_path / "d").mkdir()
    for n, d in bodies.items():
        (tmp_path / n).write_bytes(d)
    with open(tmp_path / "huge.bin", "wb") as f:  # larger than a cell, a hole on the disk
        f.truncate((1 << 31) + 5)
    huge = files.scan_blocks(spark, str(tmp_path), max_depth=1).where("rel = 'huge.bin'").agg(F.sum(F.octet_length("content").cast("long")), F.max(F.octet_length("content"))).first()
    assert tuple(huge) == ((1 << 31) + 5, files.BLOCK_BYTES)
    (tmp_path / "huge.bin").write_bytes(b"")
    blocks = files.scan_blocks(spark, str(tmp_path), hidden=True, block_bytes=1000).collect()
    assert {n: b"".join(bytes(r["content"]) for r in sorted(blocks, key=lambda r: r["offset"]) if r["rel"] == n) for n in bodies} == bodies
    assert sorted(r["offset"] for r in blocks if r["rel"] == "a.bin") == [0, 1000, 2000] and len(blocks) == 7


@pytest.mark.parametrize("name", ["scan_files", "scan_files_hidden"])
def test_tables_that_are_folders_are_not_files(spark, tmp_path, name):
    import oracle
    from doclake.plans import ORACLES, QUERIES

    (tmp_path / "t.parquet").mkdir()
    for n in ("t.parquet/part-0.parquet", "t.parquet/_SUCCESS", "u.parquet", "notes.txt"):
        (tmp_path / n).write_bytes(n.encode())
    want = oracle.duck_rows(oracle.duckdb.connect(), ORACLES[name].replace("/root/testdata/sf0.01/", f"{tmp_path}/"))
    assert oracle.difference(oracle.spark_rows(QUERIES[name](spark, str(tmp_path))), want) is None and len(want[1]) == 1


def test_arriving_files_are_listed_by_tasks_and_ingested_once(spark, tmp_path, monkeypatch):
    from doclake.streaming import ingest

    folder, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    (folder / "k=1").mkdir(parents=True)
    (folder / "deep").mkdir()
    for n in [f"f{i}.md" for i in range(7)] + [".h.md", "other.txt", "k=1/p.md", "deep/q.md"]:
        (folder / n).write_text(n)
    batches = []
    monkeypatch.setattr(ingest, "convert_all", lambda batch, inline: batches.append(batch.count()) or batch.select(
        "path", F.lit("m").alias("format"), F.col("content").cast("string").alias("markdown"), F.lit(None).cast("string").alias("error")))
    for _ in range(2):
        ingest.stream_ingest(spark, str(folder), out, ckpt, "*.{md,rst}", files_at_once=3)
    assert batches == [3, 3, 2]
    (folder / "late.rst").write_text("late.rst")
    ingest.stream_ingest(spark, str(folder), out, ckpt, "*.{md,rst}", files_at_once=3)
    got = {r["path"]: (r["markdown"], r["length"]) for r in spark.read.parquet(out).collect()}
    names = [f"f{i}.md" for i in range(7)] + ["k=1/p.md", "late.rst"]
    assert got == {f"file:{folder}/{n}": (n, len(n)) for n in names} and batches == [3, 3, 2, 1]
    # the stream's own log names files of the table, not the files that arrived
    seen = "".join(p.read_text() for p in (tmp_path / "ckpt" / "sources" / "0").iterdir() if not p.name.startswith("."))
    assert "/arrivals/" in seen and "f1.md" not in seen


def test_office_tokens_pass_few_windows_and_idle_ones_none(spark):
    """Depths and counters that need only the tokens are one step of windows; starts that nobody reads never become rows."""
    def parts(*rows):
        return spark.createDataFrame([("d", part, xml) for part, xml in rows], "doc_id string, part string, content string").withColumn(
            "content", F.col("content").cast("binary"))

    docx = parts(("word/document.xml", '<w:p><w:r w:a="x>/"><w:rPr><w:b/></w:rPr><w:t>a</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>b</w:t></w:r> </w:p><w:p><w:r><w:t>cut'))
    pptx = parts(("ppt/slides/slide1.xml", '<p:txBody><a:p><a:r><a:rPr i="1"></a:rPr><a:t>x</a:t></a:r></a:p><a:p><a:r><a:t>y</a:t></a:r></a:p></p:txBody>'),
                 ("ppt/slides/slide2.xml", "<a:p><a:r>"), ("ppt/notesSlides/notesSlide2.xml", '<p:sp><p:ph type="body"/><p:txBody>said</p:txBody></p:sp>'))
    odt = parts(("content.xml", "<text:p>"))
    want = {office.docx_to_markdown: (docx, "**a** \n\nb\n\n", 3), office.pptx_to_markdown: (pptx, "*x*\ny\n\n---\n\n> said", 3), office.odf_to_markdown: (odt, "", 4)}
    for convert, (df, markdown, windows) in want.items():
        out = convert(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"^\W*(?:\(\d+\) )?Window\b", plan, re.M)) <= windows, convert.__name__
        assert [r["markdown"] for r in out.collect()] == [markdown], convert.__name__
    raw = [r["raw"] for r in office._docx_tokens(office.docx_documents(docx)).orderBy("pos").collect()]
    assert "<w:r>" not in raw and '<w:r w:a="x>/">' not in raw and raw.count("<w:p>") == 0 and raw.count("</w:p>") == 2


def kept_bytes(spark):
    """Bytes of tables and checkpoints in the shared folder, and the shuffle files of this session."""
    from doclake.session import shared_folder

    size = 0
    for top in {shared_folder(spark), (spark.sparkContext.getCheckpointDir() or shared_folder(spark)).removeprefix("file:")}:
        size += sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(top) for n in names)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return size, {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle_")}


def test_conversion_keeps_only_what_its_result_is_made_of(spark):
    from doclake.operators.convert import convert_all, convert_sections

    noise = random.Random(5)
    docx = [make_zip([("[Content_Types].xml", b"<Types/>"), ("word/document.xml", b"<w:document><w:body><w:p><w:r><w:t>%d</w:t></w:r></w:p></w:body></w:document>" % i),
                      ("word/media/a.png", b"\x89PNG\r\n\x1a\n" + noise.randbytes(100_000))]) for i in range(3)]
    rows = [(f"d{i}.docx", bytearray(d)) for i, d in enumerate(docx)] + [("n.md", bytearray(b"# n")), ("bad.docx", bytearray(b"PK\x03\x04junk"))]
    rows += [("z.zip", bytearray(make_zip([("in.docx", docx[0]), ("x.bin", b"\xff\xfe\x00" + noise.randbytes(100_000))]))), ("e.zip", bytearray(make_zip([]))), ("bad.zip", bytearray(make_zip([("c.csv", b"a,b\n1\n")])))]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before, shuffles = kept_bytes(spark)
    out = convert_all(df)
    for _ in range(50):  # Spark removes them a little later
        after, now = kept_bytes(spark)
        if not now - shuffles:
            break
        time.sleep(0.2)
    assert after - before < 100_000 and not now - shuffles  # 900 KB of images and members came in
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    for _ in range(2):  # what is left serves any number of runs
        got = {r["path"]: (r["markdown"], r["error"] is not None) for r in out.collect()}
        assert got.pop("bad.docx") == (None, True) and got.pop("bad.zip") == (None, True)
        assert {p: m.split("\n")[0] for p, (m, failed) in got.items() if not failed} == {"d0.docx": "0", "d1.docx": "1", "d2.docx": "2", "n.md": "# n", "z.zip": "```file-tree", "e.zip": "```file-tree"}
    assert "# File: in.docx\n\n0\n" in got["z.zip"][0] and "[bin file]" in got["z.zip"][0]
    twice = convert_sections(df.union(df.where("path = 'e.zip'"))).where("path = 'e.zip'").collect()
    assert [r["text"] for r in twice] == ["```file-tree\n```\n\n"] * 2


def test_a_batch_of_a_stream_leaves_nothing_but_its_rows(spark, tmp_path):
    from doclake.streaming import ingest

    (tmp_path / "in").mkdir()
    noise = random.Random(6)
    for i in range(3):
        (tmp_path / "in" / f"z{i}.zip").write_bytes(make_zip([("x.bin", b"\xff\xfe\x00" + noise.randbytes(100_000))]))
    before, shuffles = kept_bytes(spark)
    ingest.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    for _ in range(50):
        after, now = kept_bytes(spark)
        if after <= before:
            break
        time.sleep(0.2)
    assert after - before < 1_000
    assert sorted((r["path"].split("/")[-1], r["format"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(f"z{i}.zip", "zip", None) for i in range(3)]


@pytest.mark.parametrize("together, most", [(50_000, 500), (100, 150), (1, 150)])
def test_many_files_arrive_in_parts(spark, monkeypatch, together, most):
    from doclake.plans import source_queries as Q

    made = spark.range(500).selectExpr("concat('f', id % 490, '.md') AS path", "cast(concat('t', id % 490) AS binary) AS content")
    there, runs = [], []

    def taken(spark, folder, out, ckpt, files_at_once):
        names = sorted(os.listdir(folder.removeprefix("file://")))
        if there[-1:] != [names]:
            there.append(names)
            spark.createDataFrame([(f"{folder}/{n}", "markdown", n, None) for n in names if not n.startswith(".")], "path string, format string, markdown string, error string").write.parquet(f"{out}/batch={len(there)}")
        runs.append(files_at_once)

    monkeypatch.setattr(Q, "mixed_files", lambda spark, sf: made)
    monkeypatch.setattr(Q.ingest, "stream_ingest", taken)
    monkeypatch.setattr(Q, "FILES_TOGETHER", together)
    assert sorted(r["name"] for r in Q.stream_ingest(spark, "").collect()) == sorted(f"f{i}.md" for i in range(490))
    parts = min(Q.MOST_PARTS, -(-500 // together))
    assert len(there) == parts and len(runs) == parts + 1 and max(map(len, there)) <= most and runs[-1] == (245 if parts == 1 else None)


def test_conversion_says_when_its_input_was_read(spark, tmp_path):
    import shutil

    from doclake.operators.convert import convert_all

    spark.createDataFrame([("n.md", bytearray(b"# n")), ("z.zip", bytearray(make_zip([("a.md", b"a")])))], "path string, content binary").write.parquet(str(tmp_path / "in"))
    out = convert_all(spark.read.parquet(str(tmp_path / "in")), read=lambda: shutil.rmtree(tmp_path / "in"))
    assert not (tmp_path / "in").exists() and {r["path"] for r in out.collect()} == {"n.md", "z.zip"}
