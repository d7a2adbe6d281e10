"""Office packages, archives and tables: one package per conversation turn or document, written by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.functions import text as TX
from doclake.operators import containers as C
from doclake.operators import office as O
from doclake.operators import tables as TB
from doclake.plans import fixtures as X
from doclake.plans.registry import ORACLES, duck, query, synth, table

COLS = ["role", "turn", "conv_id", "text"]


def _png():
    return F.lit(bytes.fromhex("89504E470D0A1A0A0000000D49484452"))


def para(body: str, props: str = "") -> str:
    return f"<w:p>{'<w:pPr>' + props + '</w:pPr>' if props else ''}{body}</w:p>"


def run(text: str, props: str = "") -> str:
    return f"<w:r>{'<w:rPr>' + props + '</w:rPr>' if props else ''}<w:t>{text}</w:t></w:r>"


def item(text: str, num: int, level: int) -> str:
    return para(run(text), f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>')


def cell(*paras: str) -> str:
    return "<w:tc>" + "".join(paras) + "</w:tc>"


DOCX_XML = '<?xml version="1.0"?><w:document><w:body>' + "".join([
    para(run("{role} &amp; co"), '<w:pStyle w:val="Title"/>'), para(run("Turn {turn}"), '<w:pStyle w:val="Heading2"/>'),
    para(run("plain ") + run("bold", "<w:b/>") + run("both", '<w:i/><w:b w:val="true"/>') + run("mix", '<w:b w:val="1"/><w:strike/><w:u w:val="single"/>')),
    item("{role}", 1, 0), item("deep", 1, 2), item("one", 2, 0), item("two", 2, 0),
    "<w:tbl><w:tr>" + cell(para(run("H1"))) + cell(para(run("H2"))) + "</w:tr><w:tr>" + cell(para(run("x")), para(run("y"))) +
    cell(para('<w:hyperlink r:id="rId1">' + run("link") + "</w:hyperlink>")) + "</w:tr></w:tbl>",
    item("three", 2, 0), para('<w:hyperlink r:id="rId1">' + run("go") + '</w:hyperlink><w:hyperlink r:id="rIdX">' + run("miss") + "</w:hyperlink>"),
    para("<w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r>"), para('<w:r><w:drawing><a:t>hid</a:t><a:blip r:embed="rId2"/></w:drawing></w:r>'),
    para(run("{text}")), "<w:p></w:p><w:p/>", para(run("日本 עברית"))]) + "</w:body></w:document>"
NUMBERING = ('<w:numbering><w:abstractNum w:abstractNumId="10"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>'
             '<w:abstractNum w:abstractNumId="20"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/></w:lvl></w:abstractNum>'
             '<w:num w:numId="1"><w:abstractNumId w:val="10"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="20"/></w:num></w:numbering>')
RELS = ('<Relationships><Relationship Id="rId1" Type="h" Target="http://l/{turn}?a=1&amp;b=2"/>'
        '<Relationship Id="rId2" Target="media/image1.png"/></Relationships>')
DOCX_MD = ("# {role} & co\n\n## Turn {turn}\n\nplain **bold** ***both*** ~~<u>mix</u>~~ \n\n  - {role}  \n      - deep  \n  1. one  \n  2. two  \n"
           "| H1 | H2 |\n|---|---|\n| xy | [link](http://l/{turn}?a=1&b=2) |\n\n  1. three  \n[go](http://l/{turn}?a=1&b=2)miss\n\n\t\nab\n\n![Image]()\n\n{text}\n\n\n\n日本 עברית\n\n")
ID = "'c' || conv_id || '-' || turn"


def text(template: str) -> str:
    for col in COLS:
        template = template.replace("{" + col + "}", f"\0{col}\0")
    out = []
    for i, piece in enumerate(template.split("\0")):
        if i % 2:
            out.append(f"CAST({piece} AS VARCHAR)")
        else:
            for j, part in enumerate(piece.replace("\t", "\n\t").split("\n")):
                out += ["chr(10)" if not part.startswith("\t") else "chr(9)"] if j else []
                out += ["'" + part.lstrip("\t").replace("'", "''") + "'"] if part.lstrip("\t") else []
    return " || ".join(out or ["''"])


def rows(columns: str, data, id: str = ID, ext: str = "docx") -> str:
    def value(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else text(v)

    names = [c.strip() for c in columns.split(",")]
    return " UNION ALL ".join(f"SELECT {id} || '.{ext}' AS doc_id, " + ", ".join(f"{value(v)} AS {n}" for n, v in zip(names, r)) + " FROM conversations" for r in data)


def _turns(spark, sf):
    return table(spark, sf, "conversations")


def _name(ext: str):
    return F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn", F.lit("." + ext))


def docx_files(spark, sf):
    return X.pack(_turns(spark, sf), _name("docx"), [
        ("[Content_Types].xml", F.lit("<Types/>")), ("word/document.xml", X.fill(DOCX_XML, COLS)), ("word/_rels/document.xml.rels", X.fill(RELS, COLS)),
        ("word/numbering.xml", F.lit(NUMBERING)), ("word/media/image1.png", _png())])


def _docx(spark, sf):
    return C.package_parts(docx_files(spark, sf))


@query("package_parts", rows("part, size", [("[Content_Types].xml", 8), ("word/numbering.xml", len(NUMBERING)), ("word/media/image1.png", 16)]) +
       "".join(f" UNION ALL SELECT {ID} || '.docx', '{part}', octet_length(encode({text(body)})) FROM conversations" for part, body in (("word/document.xml", DOCX_XML), ("word/_rels/document.xml.rels", RELS))))
def package_parts(spark, sf):
    return _docx(spark, sf).select("doc_id", "part", F.octet_length("content").alias("size"))


RUNS = [(0, 0, "{role} & co"), (1, 1, "Turn {turn}"), (2, 2, "plain "), (2, 3, "bold"), (2, 4, "both"), (2, 5, "mix"), (3, 6, "{role}"), (4, 7, "deep"), (5, 8, "one"), (6, 9, "two"),
        (7, 10, "H1"), (8, 11, "H2"), (9, 12, "x"), (10, 13, "y"), (11, 14, "link"), (12, 15, "three"), (13, 16, "go"), (13, 17, "miss"), (14, 18, "ab"), (15, 19, ""), (16, 20, "{text}"), (18, 21, "日本 עברית")]
RUN_FLAGS = {3: (True, False, False, False), 4: (True, True, False, False), 5: (False, False, True, True)}


@query("docx_runs", rows("para_no, run_no, text, bold, italic, strike, underline", [(*r, *RUN_FLAGS.get(r[1], (False,) * 4)) for r in RUNS]))
def docx_runs(spark, sf):
    """Every run of every document; what follows a paragraph's last run is none."""
    runs = O.docx_runs(_docx(spark, sf)).filter("ended")
    return runs.select("doc_id", F.col("para_no").cast("int").alias("para_no"), F.col("run_no").cast("int").alias("run_no"), "text", "bold", "italic", "strike", "underline")


@query("docx_all_runs", ORACLES["docx_runs"])
def docx_all_runs(spark, sf):
    """The name under which ``docx_runs`` gave all runs first."""
    return docx_runs(spark, sf)


@query("office_rels", rows("part, rel_id, target", [
    ("word/_rels/document.xml.rels", "rId1", "http://l/{turn}?a=1&b=2"), ("word/_rels/document.xml.rels", "rId2", "media/image1.png")]))
def office_rels(spark, sf):
    return O.office_rels(_docx(spark, sf))


@query("docx_numbering", rows("num_id, ilvl, ordered", [("1", "0", False), ("2", "0", True), ("2", "1", False)]))
def docx_numbering(spark, sf):
    return O.docx_numbering(_docx(spark, sf))


@query("docx_list_items", rows("depth, ordered, number, text", [
    (1, False, None, "{role}"), (3, False, None, "deep"), (1, True, 1, "one"), (1, True, 2, "two"), (1, True, 1, "three")]))
def docx_list_items(spark, sf):
    return O.docx_list_items(_docx(spark, sf)).drop("para_no")


@query("docx_headings", rows("level, text", [(1, "{role} & co"), (2, "Turn {turn}")]))
def docx_headings(spark, sf):
    return O.docx_headings(_docx(spark, sf)).drop("para_no")


@query("office_links", rows("text, url", [("link", "http://l/{turn}?a=1&b=2"), ("go", "http://l/{turn}?a=1&b=2"), ("miss", None)]))
def office_links(spark, sf):
    return O.office_links(_docx(spark, sf)).select("doc_id", "text", "url")


@query("office_media", rows("part, mime, size, rel_id", [("word/media/image1.png", "image/png", 16, "rId2")]))
def office_media(spark, sf):
    return O.office_media(_docx(spark, sf))


@query("office_tables", rows("markdown", [("| H1 | H2 |\n|---|---|\n| xy | [link](http://l/{turn}?a=1&b=2) |\n\n",)]))
def office_tables(spark, sf):
    return O.office_tables(_docx(spark, sf)).drop("block")


@query("docx_to_markdown", rows("markdown", [(DOCX_MD,)]))
def docx_to_markdown(spark, sf):
    return O.docx_to_markdown(_docx(spark, sf))


STYLES = """SELECT doc_id, concat(' w', doc_id, ' ') AS t, doc_id % 2 = 0 AS b, doc_id % 3 = 0 AS i, doc_id % 5 = 0 AS s, doc_id % 7 = 0 AS u FROM {documents}"""
TRIMMED = "CASE WHEN b AND i THEN '***' || trim(t) || '***' WHEN b THEN '**' || trim(t) || '**' WHEN i THEN '*' || trim(t) || '*' END"


@query("run_styles", f"""WITH x AS ({duck(STYLES)}), y AS (SELECT *, {TRIMMED} AS bi FROM x),
 d AS (SELECT *, coalesce(bi || ' ', t) AS d1, coalesce(bi, trim(t)) AS o1 FROM y),
 e AS (SELECT *, CASE WHEN u THEN '<u>' || trim(d1) || '</u> ' ELSE d1 END AS d2, CASE WHEN s THEN '~~' || o1 || '~~' ELSE o1 END AS o2 FROM d)
SELECT doc_id, CASE WHEN s THEN '~~' || trim(d2) || '~~ ' ELSE d2 END AS docx, ' ' || CASE WHEN u THEN '<u>' || o2 || '</u>' ELSE o2 END || ' ' AS other FROM e""")
def run_styles(spark, sf):
    src = synth(spark, sf, STYLES)
    flags = [F.col(c) for c in ("b", "i", "s", "u")]
    return src.select("doc_id", O.run_styles(F.col("t"), *flags).alias("docx"), O.run_styles(F.col("t"), *flags, docx=False).alias("other"))


# ------------------------------------------------------------------------------------------------ open documents

ODT_XML = ('<?xml version="1.0"?><office:document-content><office:automatic-styles>'
           '<style:style style:name="T1" style:family="text"><style:text-properties fo:font-weight="bold"/></style:style>'
           '<style:style style:name="T2" style:family="text"><style:text-properties fo:font-style="italic" style:text-underline-style="solid"/></style:style>'
           '<style:style style:name="P1" style:family="paragraph"><style:text-properties fo:font-weight="bold"/></style:style>'
           '<text:list-style style:name="L1"><text:list-level-style-bullet text:level="1"/></text:list-style>'
           '<text:list-style style:name="L2"><text:list-level-style-number text:level="1"/></text:list-style></office:automatic-styles><office:body>'
           '<text:h text:outline-level="2">{role} &lt;{turn}&gt;</text:h><text:p>plain <text:span text:style-name="T1"> bold</text:span> and <text:span text:style-name="T2">it</text:span>'
           '<text:tab/>x<text:line-break/>y</text:p><text:list text:style-name="L1"><text:list-item><text:p>{role}</text:p><text:list text:style-name="L2"><text:list-item><text:p>n1</text:p></text:list-item>'
           '<text:list-item><text:p>n2</text:p></text:list-item></text:list></text:list-item><text:list-item><text:p>b2</text:p></text:list-item></text:list>'
           '<text:list text:style-name="L2"><text:list-item><text:p>again</text:p></text:list-item></text:list>'
           '<table:table table:name="t"><table:table-row><table:table-cell><text:p>A</text:p></table:table-cell><table:table-cell><text:p>B</text:p></table:table-cell></table:table-row>'
           '<table:table-row><table:table-cell><text:p>{turn}</text:p></table:table-cell><table:table-cell><text:p>z</text:p></table:table-cell></table:table-row></table:table>'
           '<text:p><text:a xlink:href="http://o/{conv_id}">site</text:a></text:p><text:p><draw:frame><draw:image xlink:href="Pictures/1.png"/></draw:frame></text:p><text:p>{text}</text:p></office:body></office:document-content>')
ODT_MD = ("## {role} <{turn}>\n\nplain  **bold** and *<u>it</u>*\tx\ny\n\n- {role}\n  1. n1\n  2. n2\n- b2\n\n1. again\n\n| A | B |\n|---|---|\n| {turn} | z |\n\n"
          "[site](http://o/{conv_id})\n\n![Image]()\n\n{text}").replace("*<u>it</u>*", "<u>*it*</u>")


def odt_files(spark, sf):
    return X.pack(_turns(spark, sf), _name("odt"), [("mimetype", F.lit("application/vnd.oasis.opendocument.text")), ("content.xml", X.fill(ODT_XML, COLS)), ("Pictures/1.png", _png())])


@query("odf_styles", rows("name, family, bold, italic, strike, underline, ordered", [
    ("T1", "text", True, False, False, False, False), ("T2", "text", False, True, False, True, False),
    ("L1", "list", False, False, False, False, False), ("L2", "list", False, False, False, False, True)], ext="odt"))
def odf_styles(spark, sf):
    return O.odf_styles(C.package_parts(odt_files(spark, sf)))


@query("odf_to_markdown", rows("markdown", [(ODT_MD,)], ext="odt"))
def odf_to_markdown(spark, sf):
    return O.odf_to_markdown(C.package_parts(odt_files(spark, sf)))


# ------------------------------------------------------------------------------------------------ presentations


def shape(id: int, body: str, ph: str = "") -> str:
    mark = f'<p:nvPr><p:ph type="{ph}"/></p:nvPr>' if ph else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{id}" name="s"/>{mark}</p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>'


def ap(runs: str, props: str = "") -> str:
    return f"<a:p>{props}{runs}</a:p>"


def ar(text: str, props: str = "") -> str:
    return f"<a:r><a:rPr {props}></a:rPr><a:t>{text}</a:t></a:r>"


SLIDE1 = "<p:sld>" + shape(2, ap(ar("{role} &amp; all", 'b="1"')), "title") + shape(3, ap(ar("top", 'i="1"'), '<a:pPr marL="300000"></a:pPr>') + ap(
    ar("mid"), '<a:pPr marL="500000"></a:pPr>') + ap(ar("none"), '<a:pPr marL="900000"><a:buNone/></a:pPr>') + ap(
    '<a:r><a:rPr><a:hlinkClick r:id="rId1"/></a:rPr><a:t> link </a:t></a:r>')) + "</p:sld>"
SLIDE2 = "<p:sld>" + shape(4, ap(ar("small", 'sz="1200"'))) + shape(5, ap(ar("Big {turn}", 'sz="4000" u="sng"'))) + (
    "<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody>" + ap(ar("A")) + "</a:txBody></a:tc><a:tc><a:txBody>" + ap(ar("B")) + "</a:txBody></a:tc></a:tr><a:tr><a:tc><a:txBody>" + ap(
        ar("{conv_id}")) + "</a:txBody></a:tc><a:tc><a:txBody>" + ap(ar(" q ")) + '</a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame><p:pic><a:blip r:embed="rId2"/></p:pic>') + "</p:sld>"
SLIDE10 = "<p:sld>" + shape(6, ap(ar("{text}"))) + "</p:sld>"
NOTES = '<p:notes><p:sp><p:nvPr><p:ph type="sldImg"/></p:nvPr><p:txBody><a:p><a:r><a:t>no</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:nvPr><p:ph type="body"/></p:nvPr><p:txBody><a:p><a:r><a:t>note {turn}</a:t></a:r></a:p><a:p><a:r><a:t>more</a:t></a:r></a:p></p:txBody></p:sp></p:notes>'
PPTX_MD = ("# {role} & all\n\n- *top*\n  - mid\nnone\n[link](http://p/{turn})\n\n\n> note {turn} more\n\n---\n\nsmall\n\n# <u>Big {turn}</u>\n\n| A | B |\n|---|---|\n| {conv_id} | q |\n\n![Image]()\n\n---\n\n{text}")


def pptx_files(spark, sf):
    src = _turns(spark, sf)
    rels = '<Relationships><Relationship Id="rId1" Target="http://p/{turn}"/><Relationship Id="rId2" Target="../media/i.png"/></Relationships>'
    return X.pack(src, _name("pptx"), [
        ("[Content_Types].xml", F.lit("<Types/>")), ("ppt/slides/slide10.xml", X.fill(SLIDE10, COLS)), ("ppt/slides/slide2.xml", X.fill(SLIDE2, COLS)), ("ppt/slides/slide1.xml", X.fill(SLIDE1, COLS)),
        ("ppt/slides/slide3.xml", F.lit("<p:sld></p:sld>")), ("ppt/slides/_rels/slide1.xml.rels", X.fill(rels, COLS)), ("ppt/slides/_rels/slide2.xml.rels", X.fill(rels, COLS)),
        ("ppt/notesSlides/notesSlide1.xml", X.fill(NOTES, COLS)), ("ppt/media/i.png", _png())])


@query("pptx_to_markdown", f"SELECT doc_id, regexp_replace(markdown, '\\s+$', '') AS markdown FROM ({rows('markdown', [(PPTX_MD,)], ext='pptx')})")
def pptx_to_markdown(spark, sf):
    return O.pptx_to_markdown(C.package_parts(pptx_files(spark, sf)))


@query("pptx_titles", rows("slide_no, shape_id, text", [(1, "2", "{role} & all"), (2, "5", "Big {turn}")], ext="pptx"))
def pptx_titles(spark, sf):
    return O.pptx_titles(C.package_parts(pptx_files(spark, sf)))


@query("pptx_notes", rows("slide_no, notes", [(1, "note {turn} more")], ext="pptx"))
def pptx_notes(spark, sf):
    return O.pptx_notes(C.package_parts(pptx_files(spark, sf)))


@query("pptx_bullets", "SELECT p_partkey, CASE WHEN p_size * 20000 <= 400000 THEN 0 WHEN p_size * 20000 <= 800000 THEN 1 ELSE 2 END AS level FROM part")
def pptx_bullets(spark, sf):
    return table(spark, sf, "part").select("p_partkey", O.bullet_level(F.col("p_size") * 20000).alias("level"))


# ------------------------------------------------------------------------------------------------ containers


def _documents(spark, sf):
    return table(spark, sf, "documents")


def _doc_path(ext: str):
    return F.concat(F.lit("d"), "doc_id", F.lit("." + ext))


@query("decompress", "SELECT doc_id, text, FALSE AS failed FROM documents WHERE doc_id % 4 <> 3 UNION ALL SELECT doc_id, NULL, TRUE FROM documents WHERE doc_id % 4 = 3")
def decompress(spark, sf):
    src = _documents(spark, sf)
    kind = F.when(F.col("doc_id") % 4 == 0, "gz").when(F.col("doc_id") % 4 == 1, "xz").otherwise("raw")
    body = F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit(bytes.fromhex("1F8B08")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    files = X.pack(src, F.col("doc_id").cast("string"), [("x", body)], kind)
    out = C.decompress(files)
    return out.select(F.col("path").cast("bigint").alias("doc_id"), F.col("content").cast("string").alias("text"), F.col("error").isNotNull().alias("failed"))


def zip_files(spark, sf):
    src = _documents(spark, sf)
    kind = F.when(F.col("doc_id") % 3 == 0, "tar").otherwise("zip")
    return X.pack(src, _doc_path("zip"), [
        (F.concat(F.lit("a/"), "lang", F.lit(".TXT")), F.col("text")), ("__MACOSX/x.txt", F.lit("m")), ("b/._y", F.lit("n")), ("c.md", F.col("source"))], kind)


def nested_files(spark, sf):
    return X.pack(zip_files(spark, sf), F.regexp_replace("path", "zip$", "tar"), [("in.zip", F.col("content")), ("n.txt", F.col("path"))], "tar")


@query("archive_members", """SELECT 'd' || doc_id || '.zip' AS path, 'a/' || lang || '.TXT' AS member, 'txt' AS ext, md5(text) AS hash FROM documents
UNION ALL SELECT 'd' || doc_id || '.zip', 'c.md', 'md', md5(source) FROM documents
UNION ALL SELECT 'd' || doc_id || '.zip', '__MACOSX/x.txt', 'txt', md5('m') FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'd' || doc_id || '.zip', 'b/._y', '', md5('n') FROM documents WHERE doc_id % 3 = 0""")
def archive_members(spark, sf):
    return C.archive_members(zip_files(spark, sf)).select("path", "member", "ext", F.md5("content").alias("hash"))


NAMES = "CASE doc_id % 5 WHEN 0 THEN '__MACOSX/a' WHEN 1 THEN 'd/._b' WHEN 2 THEN '._c' WHEN 3 THEN 'x__MACOSX/q' ELSE 'd/e._f' END"


@query("skip_members", "SELECT doc_id, doc_id % 5 < 3 AS skipped FROM documents")
def skip_members(spark, sf):
    return synth(spark, sf, f"SELECT doc_id, {NAMES} AS name FROM {{documents}}").select("doc_id", C.skip_member(F.col("name")).alias("skipped"))


@query("expand_nested", """SELECT 'd' || doc_id || '.tar' AS path, 'in.zip/a/' || lang || '.TXT' AS member, md5(text) AS hash FROM documents
UNION ALL SELECT 'd' || doc_id || '.tar', 'in.zip/c.md', md5(source) FROM documents
UNION ALL SELECT 'd' || doc_id || '.tar', 'in.zip/__MACOSX/x.txt', md5('m') FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'd' || doc_id || '.tar', 'in.zip/b/._y', md5('n') FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'd' || doc_id || '.tar', 'n.txt', md5('d' || doc_id || '.zip') FROM documents""")
def expand_nested(spark, sf):
    return C.expand_nested(nested_files(spark, sf)).select("path", "member", F.md5("content").alias("hash"))


# ------------------------------------------------------------------------------------------------ tables

CSVS = """SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN 'id,name' WHEN 1 THEN 'id;name' WHEN 2 THEN concat('id', chr(9), 'name') WHEN 3 THEN 'id|name' ELSE 'id,name,x' END, chr(10),
 CASE p_partkey % 5 WHEN 0 THEN concat(p_partkey, ',"', p_name, ', ""q""', chr(10), 'z"') WHEN 1 THEN concat(p_partkey, ';', p_name) WHEN 2 THEN concat(p_partkey, chr(9), p_name) WHEN 3 THEN concat(p_partkey, '|') ELSE concat(p_partkey, ',b') END, chr(10)) AS content FROM {part}"""


@query("detect_delimiter", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) WHEN 3 THEN '|' WHEN 4 THEN '|' ELSE ';' END AS delimiter FROM part")
def detect_delimiter(spark, sf):
    src = synth(spark, sf, """SELECT p_partkey, concat(CASE p_partkey % 6 WHEN 0 THEN 'a,b,c;' WHEN 1 THEN 'a;b' WHEN 2 THEN concat(p_name, chr(9), 'x') WHEN 3 THEN 'a|b|c,d' WHEN 4 THEN 'none' ELSE 'a,b;c' END,
      chr(10), 'x,y,z,,,') AS content FROM {part}""")
    return src.select("p_partkey", TB.detect_delimiter(F.col("content")).alias("delimiter"))


@query("read_delimited", """SELECT CAST(p_partkey AS VARCHAR) AS path, 0 AS row_no, 0 AS col_no, 'id' AS value FROM part WHERE p_partkey % 5 < 4
UNION ALL SELECT p_partkey::VARCHAR, 0, 1, 'name' FROM part WHERE p_partkey % 5 < 4 UNION ALL SELECT p_partkey::VARCHAR, 1, 0, p_partkey::VARCHAR FROM part WHERE p_partkey % 5 < 4
UNION ALL SELECT p_partkey::VARCHAR, 1, 1, CASE p_partkey % 5 WHEN 0 THEN p_name || ', "q"' || chr(10) || 'z' WHEN 3 THEN '' ELSE p_name END FROM part WHERE p_partkey % 5 < 4
UNION ALL SELECT p_partkey::VARCHAR, -1, -1, 'records of unequal length' FROM part WHERE p_partkey % 5 = 4""")
def read_delimited(spark, sf):
    cells, bad = TB.read_delimited(synth(spark, sf, CSVS).select(F.col("p_partkey").cast("string").alias("path"), "content"))
    return cells.unionByName(bad.select("path", F.lit(-1).alias("row_no"), F.lit(-1).alias("col_no"), F.col("error").alias("value")))


@query("to_markdown_table", """WITH r AS (SELECT DISTINCT c_nationkey, -1 AS o, '| c_custkey | c_name |' || chr(10) || '|---|---|' || chr(10) AS content FROM customer
 UNION ALL SELECT c_nationkey, c_custkey, '| ' || c_custkey || ' | ' || c_name || ' |' || chr(10) FROM customer)
SELECT c_nationkey, CAST(coalesce(sum(octet_length(encode(content))) OVER (PARTITION BY c_nationkey ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, content FROM r""")
def to_markdown_table(spark, sf):
    return TB.to_markdown_table(table(spark, sf, "customer"), "c_nationkey", F.col("c_custkey"), ["c_custkey", "c_name"])


BOOK = '<workbook><sheets><sheet name="First &amp; {turn}" sheetId="1" r:id="rId1"/><sheet name="Empty" sheetId="2" r:id="rId2"/><sheet name="Last" sheetId="3" r:id="rId3"/></sheets></workbook>'
BOOK_RELS = '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/><Relationship Id="rId3" Target="/xl/worksheets/sheet3.xml"/></Relationships>'
SST = '<sst><si><t>{role}</t></si><si><r><t>ri</t></r><r><t xml:space="preserve">ch </t></r></si><si><t>{text}</t></si></sst>'
SHEET1 = ('<worksheet><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="s"><v>1</v></c></row><row r="4"><c r="B4"><v>{turn}.50</v></c><c r="C4" t="b"><v>1</v></c>'
          '<c r="D4" t="inlineStr"><is><t>in</t></is></c><c r="E4" s="3"/></row></sheetData></worksheet>')
SHEET3 = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>2</v></c></row></sheetData></worksheet>'


def xlsx_files(spark, sf):
    return X.pack(_turns(spark, sf), _name("xlsx"), [
        ("[Content_Types].xml", F.lit("<Types/>")), ("xl/workbook.xml", X.fill(BOOK, COLS)), ("xl/_rels/workbook.xml.rels", F.lit(BOOK_RELS)), ("xl/sharedStrings.xml", X.fill(SST, COLS)),
        ("xl/worksheets/sheet1.xml", X.fill(SHEET1, COLS)), ("xl/worksheets/sheet2.xml", F.lit("<worksheet><sheetData/></worksheet>")), ("xl/worksheets/sheet3.xml", F.lit(SHEET3))])


ODS_XML = ('<office:document-content><table:table table:name="S{turn}"><table:table-row><table:table-cell/><table:table-cell table:number-columns-repeated="2"><text:p>{role}</text:p></table:table-cell></table:table-row>'
           '<table:table-row table:number-rows-repeated="3"><table:table-cell table:number-columns-repeated="1000"/></table:table-row><table:table-row><table:table-cell><text:p>{text}</text:p></table:table-cell></table:table-row></table:table></office:document-content>')


def ods_files(spark, sf):
    return X.pack(_turns(spark, sf), _name("ods"), [("mimetype", F.lit("application/vnd.oasis.opendocument.spreadsheet")), ("content.xml", X.fill(ODS_XML, COLS))])


CELLS = [(0, "First & {turn}", 1, 1, "{role}"), (0, "First & {turn}", 1, 26, "rich "), (0, "First & {turn}", 3, 1, "{turn}.5"), (0, "First & {turn}", 3, 2, "true"),
         (0, "First & {turn}", 3, 3, "in"), (2, "Last", 0, 0, "{text}")]
ODS_CELLS = [(0, "S{turn}", 0, 1, "{role}"), (0, "S{turn}", 0, 2, "{role}"), (0, "S{turn}", 4, 0, "{text}")]


@query("sheet_cells", rows("sheet_no, sheet, row_no, col_no, value", CELLS, ext="xlsx") + " UNION ALL " + rows("sheet_no, sheet, row_no, col_no, value", ODS_CELLS, ext="ods"))
def sheet_cells(spark, sf):
    files = xlsx_files(spark, sf).unionByName(ods_files(spark, sf))
    return TB.sheet_cells(C.package_parts(files))


WIDE = ["{role}"] + [""] * 24 + ["rich "]
SHEET_MD = ("## First & {turn}\n\n| " + " | ".join(WIDE) + " |\n|" + "|".join(["---"] * 26) + "|\n| " + " | ".join([""] * 26) + " |\n| " + " | ".join(["{turn}.5", "true", "in"] + [""] * 23) +
            " |\n\n## Last\n\n| {text} |\n|---|\n\n")
ODS_MD = "## S{turn}\n\n|  | {role} | {role} |\n|---|---|---|\n" + "|  |  |  |\n" * 3 + "| {text} |  |  |\n\n"


@query("sheets_to_markdown", rows("markdown", [(SHEET_MD,)], ext="xlsx") + " UNION ALL " + rows("markdown", [(ODS_MD,)], ext="ods"))
def sheets_to_markdown(spark, sf):
    files = xlsx_files(spark, sf).unionByName(ods_files(spark, sf))
    return TB.sheets_to_markdown(TB.sheet_cells(C.package_parts(files)))
