"""Markdown family, over documents written from customers, orders, documents and converted pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.operators import html as H
from doclake.operators import markdown as M
from doclake.plans.html_queries import duck_decode
from doclake.plans.registry import query, synth, table

def text(template: str) -> str:
    """SQL concat of a template in which ``{column}`` stands for a customer column."""
    for col in ("c_name", "c_mktsegment", "c_custkey", "c_nationkey"):
        template = template.replace("{" + col + "}", f"\0{col}\0")
    out = []
    for i, piece in enumerate(template.split("\0")):
        for j, part in enumerate([piece] if i % 2 else piece.split("\n")):
            out += ["chr(10)"] if j else []
            out += [part] if i % 2 else ["'" + part.replace("'", "''") + "'"] if part else []
    return "concat(" + ", ".join(out or ["''"]) + ")"


def lines(*parts: str) -> str:
    return text("\n".join(parts) + "\n")


DOC = lines(
    "---", "title: {c_name}", "---", "# {c_name} *em*", "", "Intro {c_mktsegment} with [link](http://h/{c_custkey}) and `[no](x)`",
    "second line https://bare.org/p. [[http://wiki|W {c_nationkey}]]", "", "## Part ##", "- a{c_custkey}", "    - b", "      more b", "    - c", "- d", "",
    "3. x", "1. y", "", "> [!NOTE]", "> careful {c_name}", "", "```{r, echo=F}", "# not {c_name}", "x <- 1", "```", "", "| A | B\\|b |", "|:--|--:|", "| {c_name} | 1 |", "| z |", "",
    "Setext {c_custkey}", "===", "Note[^1] and [^zz] and $a_{c_nationkey}$ or $$b^2$$", "", "[^1]: def {c_mktsegment}", "[^un]: unused", "", "***", "::: {.callout-caution}", "body {c_custkey}", ":::",
    "> quoted {c_nationkey}", "> again", "", "![alt](i{c_custkey}.png#20x30) ![b](j.png)", "", "| P |", "|---|", "| ![t](t.png) |", "<div>raw</div>", "#### ", "~~~", "plain", "~~~")
DOCS = f"SELECT c_custkey AS id, {DOC} AS md FROM {{customer}}".replace("\\", "\\\\")


def _docs(spark, sf):
    return synth(spark, sf, DOCS)


# (block_no, type, level, info, text, line_from, line_to)
BLOCKS = [
    ("front_matter", None, None, "title: {c_name}", 1, 3), ("heading", 1, None, "{c_name} *em*", 4, 4),
    ("paragraph", None, None, "Intro {c_mktsegment} with [link](http://h/{c_custkey}) and `[no](x)`\nsecond line https://bare.org/p. [[http://wiki|W {c_nationkey}]]", 6, 7),
    ("heading", 2, None, "Part", 9, 9), ("item", None, "-", "a{c_custkey}", 10, 10), ("item", None, "-", "b\nmore b", 11, 12), ("item", None, "-", "c", 13, 13),
    ("item", None, "-", "d", 14, 14), ("item", None, "3.", "x", 16, 16), ("item", None, "1.", "y", 17, 17), ("quote", None, None, "[!NOTE]\ncareful {c_name}", 19, 20),
    ("code", None, "{r, echo=F}", "# not {c_name}\nx <- 1", 22, 25), ("table", None, None, "| A | B\\|b |\n|:--|--:|\n| {c_name} | 1 |\n| z |", 27, 30),
    ("heading", 1, None, "Setext {c_custkey}", 32, 33), ("paragraph", None, None, "Note[^1] and [^zz] and $a_{c_nationkey}$ or $$b^2$$", 34, 34),
    ("footnote", None, "1", "def {c_mktsegment}", 36, 36), ("footnote", None, "un", "unused", 37, 37), ("rule", None, None, "", 39, 39),
    ("directive", None, None, "::: {.callout-caution}\nbody {c_custkey}\n:::", 40, 42), ("quote", None, None, "quoted {c_nationkey}\nagain", 43, 44),
    ("paragraph", None, None, "![alt](i{c_custkey}.png#20x30) ![b](j.png)", 46, 46), ("table", None, None, "| P |\n|---|\n| ![t](t.png) |", 48, 50),
    ("html", None, None, "<div>raw</div>", 51, 51), ("heading", 4, None, "", 52, 52), ("code", None, "", "plain", 53, 55),
]


def value(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else text(v)


def rows(columns: str, data) -> str:
    """DuckDB rows per customer from templates."""
    names = [c.strip() for c in columns.split(",")]
    return " UNION ALL ".join("SELECT c_custkey AS doc_id, " + ", ".join(f"{value(v)} AS {n}" for n, v in zip(names, r)) + " FROM customer" for r in data)


@query("md_blocks", rows("block_no, type, level, info, text, line_from, line_to", [(i, *b) for i, b in enumerate(BLOCKS)]))
def md_blocks(spark, sf):
    return M.md_blocks(_docs(spark, sf), "id", "md").drop("raw")


@query("md_front_matter", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'lang: ' || lang || chr(10) || 'n: ' || n_chars END AS front_matter, text AS body FROM documents""")
def md_front_matter(spark, sf):
    src = synth(spark, sf, """SELECT doc_id, concat(CASE WHEN doc_id % 2 = 0 THEN concat('---', chr(10), 'lang: ', lang, chr(10), 'n: ', n_chars, chr(10), '---', chr(10))
      ELSE '' END, text) AS md FROM {documents}""")
    return M.md_front_matter(src, "doc_id", "md")


@query("md_headings", rows("n, level, text", [(0, 1, "{c_name} em"), (1, 2, "Part"), (2, 1, "Setext {c_custkey}")]))
def md_headings(spark, sf):
    from pyspark.sql import Window as W
    heads = M.md_headings(_docs(spark, sf), "id", "md")
    return heads.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1).alias("n"), "level", "text")


TOC = lines("## A{c_custkey}", "### B", "#### C{c_nationkey}", "### D", "## E", "#### F", "#### G", "## H")


@query("md_toc", rows("n, depth, line", [
    (0, 0, "A{c_custkey}"), (1, 1, "├─ B"), (2, 2, "│ └─ C{c_nationkey}"), (3, 1, "└─ D"), (4, 0, "\nE"), (5, 2, "  ├─ F"), (6, 2, "  └─ G"), (7, 0, "\nH")]))
def md_toc(spark, sf):
    docs = synth(spark, sf, f"SELECT c_custkey AS id, {TOC} AS md FROM {{customer}}")
    return M.md_toc(M.md_headings(docs, "id", "md")).select("doc_id", F.col("pos").alias("n"), "depth", "line")


@query("md_toc_pages", f"""SELECT page_id AS doc_id, 0 AS depth, trim({duck_decode("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS line FROM pages""")
def md_toc_pages(spark, sf):
    heads = H.html_headings(table(spark, sf, "pages"), "page_id", "html").withColumnRenamed("heading_no", "pos")
    return M.md_toc(heads).select("doc_id", "depth", "line")


@query("md_code_blocks", rows("info, language, is_mermaid, code", [
    ("{r, echo=F}", "r", False, "# not {c_name}\nx <- 1"), ("", "text", False, "plain")]))
def md_code_blocks(spark, sf):
    return M.md_code_blocks(_docs(spark, sf), "id", "md").drop("pos")


LONG = "SELECT doc_id, concat('intro', chr(10), '```mmd', chr(10), text, chr(10), '```', chr(10), 'end') AS md FROM {documents}"


@query("md_code_lines", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM l WHERE len(ls) > 10""")
def md_code_lines(spark, sf):
    return M.md_code_lines(M.md_code_blocks(synth(spark, sf, LONG), "doc_id", "md")).drop("pos")


LANGS = ["python", "zz", "Custom", "", "rs", "foo"]
CODES = ("SELECT c_custkey AS id, concat('```', CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LANGS)) +
         " END, chr(10), CASE c_custkey % 6 WHEN 5 THEN '#!/usr/bin/env python3' ELSE c_name END, chr(10), '```') AS md FROM {customer}")


@query("resolve_syntax", """SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN 'Python' WHEN 1 THEN 'Plain Text' WHEN 2 THEN 'SQL' WHEN 3 THEN 'Plain Text'
 WHEN 4 THEN 'Rust' ELSE 'Python' END AS syntax FROM customer""")
def resolve_syntax(spark, sf):
    code = M.md_code_blocks(synth(spark, sf, CODES), "id", "md")
    return M.resolve_syntax(code, [(".custom", "sql"), ("zz", "nosuch")]).select("doc_id", "syntax")


@query("md_links", rows("kind, url, title", [
    ("inline", "http://h/{c_custkey}", "link"), ("bare", "https://bare.org/p", "https://bare.org/p"), ("wiki", "http://wiki", "W {c_nationkey}")]))
def md_links(spark, sf):
    return M.md_links(_docs(spark, sf), "id", "md").select("doc_id", "kind", "url", "title")


@query("md_images", rows("alt, base_url, width, height", [
    ("alt", "i{c_custkey}.png", "20", "30"), ("b", "j.png", None, None), ("t", "t.png", "1728", None)]))
def md_images(spark, sf):
    return M.md_images(_docs(spark, sf), "id", "md").select("doc_id", "alt", "base_url", "width", "height")


@query("md_tables", "SELECT *, CASE col_no WHEN 0 THEN CASE block_no WHEN 12 THEN greatest(length(c), 1) ELSE 11 END ELSE 3 END AS width FROM (" + " UNION ALL ".join(
    f"SELECT c_custkey AS doc_id, c_name AS c, {b} AS block_no, {r} AS row_no, {c} AS col_no, {text(v)} AS value, '{a}' AS align FROM customer" for b, r, c, v, a in [
        (12, 0, 0, "A", "left"), (12, 0, 1, "B|b", "right"), (12, 1, 0, "{c_name}", "left"), (12, 1, 1, "1", "right"), (12, 2, 0, "z", "left"),
        (21, 0, 0, "P", "none"), (21, 1, 0, "![t](t.png)", "none")]) + ")")
def md_tables(spark, sf):
    return M.md_tables(_docs(spark, sf), "id", "md").join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("c")), "doc_id")


@query("md_list_items", rows("pos, depth, ordered, number, text", [
    (4, 0, False, None, "a{c_custkey}"), (5, 1, False, None, "b\nmore b"), (6, 1, False, None, "c"), (7, 0, False, None, "d"), (8, 0, True, 3, "x"), (9, 0, True, 4, "y")]))
def md_list_items(spark, sf):
    items = M.md_list_items(_docs(spark, sf).withColumn("md", F.replace("md", F.lit("3. x"), F.lit("--x--\n3. x"))), "id", "md")
    return items.select("doc_id", (F.col("pos") - F.when(F.col("ordered"), 1).otherwise(0)).alias("pos"), "depth", "ordered", "number", "text")


@query("md_tasks", """SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'partial' ELSE 'blocked' END AS state, 'ship ' || o_orderpriority AS text FROM orders
UNION ALL SELECT o_orderkey, 'open', 'bill ' || o_custkey FROM orders""")
def md_tasks(spark, sf):
    src = synth(spark, sf, """SELECT o_orderkey, concat('- [', CASE o_orderstatus WHEN 'F' THEN 'X' WHEN 'P' THEN '~' ELSE '!' END, '] ship ', o_orderpriority, chr(10),
      '* [ ] bill ', o_custkey, chr(10), '- plain [x] item') AS md FROM {orders}""")
    return M.md_tasks(src, "o_orderkey", "md").select("doc_id", "state", "text")


@query("md_footnotes", rows("name, used, definition", [("1", True, "def {c_mktsegment}"), ("zz", True, None), ("un", False, "unused")]))
def md_footnotes(spark, sf):
    return M.md_footnotes(_docs(spark, sf), "id", "md").select("doc_id", "name", F.col("pos").isNotNull().alias("used"), "definition")


@query("md_alerts", rows("block_no, alert, text", [(10, "NOTE", "careful {c_name}"), (18, "DANGER", "body {c_custkey}")]))
def md_alerts(spark, sf):
    return M.md_alerts(_docs(spark, sf), "id", "md")


@query("md_math", rows("n, display, literal", [(0, False, "a_{c_nationkey}"), (1, True, "b^2")]))
def md_math(spark, sf):
    return M.md_math(_docs(spark, sf), "id", "md").select("doc_id", "n", "display", "literal")


HTML_DOC = lines("# {c_name} *em*", "", "Intro **{c_mktsegment}** & [l](http://h/{c_custkey}) `a<b`", "", "- a{c_custkey}", "    1. b", "    2. c", "- d", "", "3. x", "", "> q ~~s~~", "",
                 "```rust", "let x = 1 < 2;", "```", "", "***", "", "| A | B |", "|:--|---|", "| {c_name} | ![i](u) |")
HTML_OUT = ("<h1>{c_name} <em>em</em></h1>\n<p>Intro <strong>{c_mktsegment}</strong> &amp; <a href=\"http://h/{c_custkey}\">l</a> <code>a&lt;b</code></p>\n"
            "<ul>\n<li>a{c_custkey}\n<ol>\n<li>b</li>\n<li>c</li>\n</ol>\n</li>\n<li>d</li>\n</ul>\n<p>sep</p>\n<ol start=\"3\">\n<li>x</li>\n</ol>\n<blockquote>\n<p>q <del>s</del></p>\n</blockquote>\n"
            "<pre><code class=\"language-rust\">let x = 1 &lt; 2;\n</code></pre>\n<hr />\n<table>\n<thead>\n<tr>\n<th align=\"left\">A</th>\n<th>B</th>\n</tr>\n</thead>\n<tbody>\n"
            "<tr>\n<td align=\"left\">{c_name}</td>\n<td><img src=\"u\" alt=\"i\" /></td>\n</tr>\n</tbody>\n</table>\n")


@query("md_to_html", rows("html", [(HTML_OUT,)]))
def md_to_html(spark, sf):
    src = synth(spark, sf, f"SELECT c_custkey AS id, {HTML_DOC} AS md FROM {{customer}}").withColumn(
        "md", F.replace("md", F.lit("3. x"), F.lit("sep\n\n3. x")))
    return M.md_to_html(src, "id", "md")


REF_DOC = lines(
    "[late]: http://too-early/{c_nationkey}", "", "See [one][Late], [ late ][] and [LATE], not [this][{c_name}] nor [that]. <http://auto/{c_custkey}> <a@{c_nationkey}.org>", "[Late]: within a paragraph", "",
    "[late]: http://never", "[Two Words]: <two/{c_custkey}.html> 'T & {c_nationkey}'", "", "- [x] [two", "  words] `[late]`", "- [![badge {c_nationkey}][pic]][two   WORDS] and [in](u_r_l) ![pic]", "",
    "> **q [late] `*`**", "", "[pic]: p{c_custkey}.png#20x30 (p)", "", "| A |", "|---|", "| ![t][Pic] ![none][no] |")
REF_DOCS = f"SELECT c_custkey AS id, {REF_DOC} AS md FROM {{customer}}".replace("\\", "\\\\")


def _ref_docs(spark, sf):
    return synth(spark, sf, REF_DOCS)


@query("md_definitions", rows("label, url, title", [
    ("late", "http://too-early/{c_nationkey}", None), ("two words", "two/{c_custkey}.html", "T & {c_nationkey}"), ("pic", "p{c_custkey}.png#20x30", "p")]))
def md_definitions(spark, sf):
    """Labels that are repeated, in other cases, within a paragraph and below their references."""
    return M.md_definitions(_ref_docs(spark, sf), "id", "md").drop("pos")


@query("md_reference_links", rows("pos, n, kind, url, title", [
    (2, 0, "reference", "http://too-early/{c_nationkey}", "one"), (2, 1, "reference", "http://too-early/{c_nationkey}", " late "), (2, 2, "reference", "http://too-early/{c_nationkey}", "LATE"),
    (2, 3, "auto", "http://auto/{c_custkey}", "http://auto/{c_custkey}"), (2, 4, "auto", "mailto:a@{c_nationkey}.org", "a@{c_nationkey}.org"), (3, 0, "reference", "http://too-early/{c_nationkey}", "Late"),
    (10, 0, "reference", "two/{c_custkey}.html", "![badge {c_nationkey}][pic]"), (10, 1, "inline", "u_r_l", "in"), (12, 0, "reference", "http://too-early/{c_nationkey}", "late")]))
def md_reference_links(spark, sf):
    return M.md_links(_ref_docs(spark, sf), "id", "md")


@query("md_reference_images", rows("n, alt, base_url, width, height", [
    (0, "badge {c_nationkey}", "p{c_custkey}.png", "20", "30"), (1, "pic", "p{c_custkey}.png", "20", "30"), (0, "t", "p{c_custkey}.png", "20", "30")]))
def md_reference_images(spark, sf):
    return M.md_images(_ref_docs(spark, sf), "id", "md").drop("block_no")


LATE, TWO = '<a href="http://too-early/{c_nationkey}">', '<a href="two/{c_custkey}.html" title="T &amp; {c_nationkey}">'
PIC = '<img src="p{c_custkey}.png#20x30" alt="%s" title="p" />'
REF_HTML = (f"<p>See {LATE}one</a>, {LATE} late </a> and {LATE}LATE</a>, not [this][{{c_name}}] nor [that]. <a href=\"http://auto/{{c_custkey}}\">http://auto/{{c_custkey}}</a> "
            f"<a href=\"mailto:a@{{c_nationkey}}.org\">a@{{c_nationkey}}.org</a>\n{LATE}Late</a>: within a paragraph</p>\n<ul>\n<li>[x] {TWO}two\nwords</a> <code>[late]</code></li>\n"
            f"<li>{TWO}{PIC % 'badge {c_nationkey}'}</a> and <a href=\"u_r_l\">in</a> {PIC % 'pic'}</li>\n</ul>\n<blockquote>\n<p><strong>q {LATE}late</a> <code>*</code></strong></p>\n</blockquote>\n"
            f"<table>\n<thead>\n<tr>\n<th>A</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>{PIC % 't'} ![none][no]</td>\n</tr>\n</tbody>\n</table>\n")


@query("md_reference_html", rows("html", [(REF_HTML,)]))
def md_reference_html(spark, sf):
    return M.md_to_html(_ref_docs(spark, sf), "id", "md")
