"""HTML family: pages as they are, and fragments derived from customers for the tags pages do not contain."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.functions.text import collapse_blanks, escape_unknown
from doclake.operators import html as H
from doclake.operators import tokens as T
from doclake.plans.registry import duck, query, synth, table

TOKEN_RE = """<(?:"[^"]*"|''[^'']*''|[^''">])*>|[^<]+|<"""


def duck_decode(x: str) -> str:
    for name, char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&")]:
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def duck_tokens(src: str, id: str, html: str) -> str:
    """CTEs ending in ``tok(doc_id, pos, raw, tag, kind)``."""
    clean = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "title"):
        clean = f"regexp_replace({clean}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    clean = f"regexp_replace({clean}, '<[!?][^>]*>', '', 'g')"
    return f"""
    base AS (SELECT {id} AS doc_id, regexp_extract_all({clean}, '{TOKEN_RE}') AS toks FROM ({src})),
    exploded AS (SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS raw FROM base),
    tagged AS (SELECT *, CASE WHEN raw LIKE '<_%' THEN lower(regexp_extract(raw, '^</?([A-Za-z_][A-Za-z0-9:._-]*)', 1))
                         ELSE '' END AS tag FROM exploded),
    tok AS (SELECT *, CASE WHEN tag = '' THEN 'text' WHEN raw LIKE '</%' THEN 'close'
              WHEN raw LIKE '%/>' OR tag IN ('area','base','br','col','embed','hr','img','input','link','meta','source',
              'track','wbr') THEN 'void' ELSE 'open' END AS kind FROM tagged)"""


PAGES = "SELECT page_id, html FROM {pages}"
STEP = "CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END"


def _depth(tags: str, name: str) -> str:
    return f"""CAST(sum(CASE WHEN tag IN ({tags}) THEN {STEP} ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS {name}"""


@query("html_tokens", f"""WITH {duck_tokens(duck(PAGES), 'page_id', 'html')}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, kind, tag,
  CASE WHEN kind IN ('open','void') AND tag = 'a' THEN regexp_extract(raw, 'href="([^"]*)"', 1) END AS href,
  CASE WHEN kind = 'text' THEN {duck_decode('raw')} END AS text FROM tok""")
def html_tokens(spark, sf):
    tokens = T.html_tokens(table(spark, sf, "pages"), "page_id", "html")
    return tokens.select("doc_id", "pos", "kind", "tag",
                         F.when(F.col("tag") == "a", F.col("attrs")["href"]).alias("href"), "text")


@query("html_nesting", f"""WITH {duck_tokens(duck(PAGES), 'page_id', 'html')}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, kind, tag, {_depth("'ul','ol'", 'in_list')}, {_depth("'table'", 'in_table')},
 {_depth("'blockquote','details'", 'in_quote')}, {_depth("'pre'", 'in_pre')},
 {_depth("'h1','h2','h3','h4','h5','h6'", 'in_heading')}, {_depth("'a'", 'in_link')} FROM tok""")
def html_nesting(spark, sf):
    return H.html_nesting(table(spark, sf, "pages"), "page_id", "html")


@query("html_text", f"""WITH {duck_tokens(duck(PAGES), 'page_id', 'html')}
SELECT doc_id, {duck_decode("string_agg(raw, '' ORDER BY pos)")} AS text FROM tok WHERE kind = 'text' GROUP BY doc_id""")
def html_text(spark, sf):
    return H.html_text(table(spark, sf, "pages"), "page_id", "html")


@query("html_links", """WITH m AS (SELECT page_id,
  regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 1) AS hrefs,
  regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 2) AS bodies FROM pages),
 x AS (SELECT page_id, generate_subscripts(hrefs, 1) - 1 AS n, unnest(hrefs) AS href, unnest(bodies) AS body FROM m)
SELECT page_id AS doc_id, CAST(n AS INTEGER) AS link_no, href, trim(body) AS text,
  '[' || trim(body) || '](' || href || ')' AS markdown FROM x""")
def html_links(spark, sf):
    return H.html_links(table(spark, sf, "pages"), "page_id", "html")


@query("html_headings", f"""WITH m AS (SELECT page_id,
  regexp_extract_all(html, '(?s)<h([1-6])>(.*?)</h[1-6]>', 1) AS l,
  regexp_extract_all(html, '(?s)<h([1-6])>(.*?)</h[1-6]>', 2) AS b FROM pages),
 x AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS lev, unnest(b) AS body FROM m)
SELECT page_id AS doc_id, CAST(n AS INTEGER) AS heading_no, CAST(lev AS INTEGER) AS level,
  trim({duck_decode('body')}) AS text FROM x""")
def html_headings(spark, sf):
    return H.html_headings(table(spark, sf, "pages"), "page_id", "html")


PAGE_IMAGES = """SELECT page_id, concat('<p>x</p><img src="/i/', page_id, '.png" alt="n', page_id % 7, '" width="', page_id % 50,
 'px;" height="', page_id % 30, '%"><img src="u.gif"/><img alt="q" src=''v.png'' width="', page_id % 9, '">',
 html) AS html FROM {pages}"""


@query("html_images", """SELECT page_id AS doc_id, CAST(3 AS INTEGER) AS pos, '/i/' || page_id || '.png' AS src, 'n' || (page_id % 7) AS alt,
 '![n' || (page_id % 7) || '](/i/' || page_id || '.png#' || (page_id % 50) || 'pxx' || (page_id % 30) || '%)' AS markdown FROM pages
UNION ALL SELECT page_id, 4, 'u.gif', 'IMG', '![IMG](u.gif)' FROM pages
UNION ALL SELECT page_id, 5, 'v.png', 'q', '![q](v.png#' || (page_id % 9) || 'x)' FROM pages""")
def html_images(spark, sf):
    return H.html_images(synth(spark, sf, PAGE_IMAGES), "page_id", "html")


LISTS = """SELECT c_custkey AS id, concat('<p>', c_name, '</p><ul><li>', c_mktsegment, '<ol start="3"><li>a', c_custkey,
 '</li><li>b', c_nationkey, '<p>more</p></li></ol></li><li>z</li></ul>') AS html FROM {customer}"""


@query("html_lists", """SELECT c_custkey AS doc_id, 0 AS item_no, 1 AS depth, '- ' AS marker, c_mktsegment AS text FROM customer
UNION ALL SELECT c_custkey, 1, 2, '3. ', 'a' || c_custkey FROM customer
UNION ALL SELECT c_custkey, 2, 2, '4. ', 'b' || c_nationkey FROM customer
UNION ALL SELECT c_custkey, 3, 1, '- ', 'z' FROM customer""")
def html_lists(spark, sf):
    return H.html_lists(synth(spark, sf, LISTS), "id", "html")


TABLES = """SELECT c_custkey AS id, concat('<p>t</p><table><tr><th align="left">n|', c_nationkey, '</th><th>b</th><th align="right">c</th></tr><tr><td>',
 c_name, '</td><td align="center">x', chr(10), ' y</td></tr><tr></tr><tr><td>', c_mktsegment, '</td></tr></table>') AS html FROM {customer}"""


@query("html_tables", """SELECT c_custkey AS doc_id, 0 AS table_no, '| n\\|' || c_nationkey || ' | b | c |' || chr(10) ||
 '| :--- | :---: | ---: |' || chr(10) || '| ' || c_name || ' | x<br>y |  |' || chr(10) || '| ' || c_mktsegment || ' |  |  |' AS markdown
FROM customer""")
def html_tables(spark, sf):
    return H.html_tables(synth(spark, sf, TABLES), "id", "html")


NESTED = """SELECT c_custkey AS id, concat('<table><tr><td>a', c_custkey, '<table><tr><th>', c_name, '</th><td align="right">1</td></tr><tr><td>', c_nationkey,
 '</td></tr></table>z</td><td>', c_mktsegment, '</td></tr></table>') AS html FROM {customer}"""


@query("html_nested_tables", r"""SELECT c_custkey AS doc_id, 0 AS table_no, '| a' || c_custkey || '<br>\| ' || c_name || ' \| 1 \|<br>\| --- \| ---: \|<br>\| ' || c_nationkey ||
 ' \|  \|<br>z | ' || c_mktsegment || ' |' || chr(10) || '| --- | --- |' AS markdown FROM customer""")
def html_nested_tables(spark, sf):
    """A table in a cell is its lines there."""
    return H.html_tables(synth(spark, sf, NESTED), "id", "html")


INLINE = """SELECT c_custkey AS id, concat('<b> ', c_name, ' <i>it</i></b> <em>', c_mktsegment, '</em><var>v</var> <del>d</del><s>s</s><mark>m ',
 c_nationkey, '</mark><sup>2</sup><kbd>Ctrl</kbd><q>q</q><code>x</code><strong>open') AS html FROM {customer}"""


@query("html_inline", """SELECT c_custkey AS doc_id, '**' || c_name || ' *it*** *' || c_mktsegment || '**v* ~~d~~~~s~~==m ' || c_nationkey ||
 '==^2^`[Ctrl]`"q"`x`open' AS markdown FROM customer""")
def html_inline(spark, sf):
    return H.html_inline(synth(spark, sf, INLINE), "id", "html")


QUOTES = """SELECT c_custkey AS id, concat('<p>outside</p><blockquote>', c_name, '<blockquote>', c_mktsegment,
 '</blockquote></blockquote><details><summary>S', c_nationkey, '</summary>body</details>') AS html FROM {customer}"""


@query("html_quotes", """SELECT c_custkey AS doc_id, '> ' || c_name || chr(10) || '> ' || chr(10) || '> > ' || c_mktsegment || chr(10) || chr(10) ||
 '> ▼ S' || c_nationkey || chr(10) || '> ' || chr(10) || '> body' AS markdown FROM customer""")
def html_quotes(spark, sf):
    return H.html_quotes(synth(spark, sf, QUOTES), "id", "html")


CODE = """SELECT c_custkey AS id, concat('<p>a</p><pre>', c_name, chr(10), '  if x &lt; y:  ', chr(10), '</pre><p>b</p><pre><code>',
 c_mktsegment, '</code></pre>') AS html FROM {customer}"""


@query("html_code", """SELECT c_custkey AS doc_id, 0 AS code_no, '```' || chr(10) || c_name || chr(10) || '  if x < y:' || chr(10) || '```' AS markdown FROM customer
UNION ALL SELECT c_custkey, 1, '```' || chr(10) || '`' || c_mktsegment || '`' || chr(10) || '```' FROM customer""")
def html_code(spark, sf):
    return H.html_code(synth(spark, sf, CODE), "id", "html")


BOUNDARY = "tag IN ('p','div','ul','ol','li','h1','h2','h3','h4','h5','h6')"


@query("html_blocks", f"""WITH {duck_tokens(duck(PAGES), 'page_id', 'html')},
b AS (SELECT *, CAST(sum(CASE WHEN {BOUNDARY} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS block_id FROM tok),
g AS (SELECT doc_id, block_id, arg_min(tag, pos) AS t0, arg_min(kind, pos) AS k0,
  string_agg(CASE WHEN kind = 'text' THEN {duck_decode('raw')} WHEN tag = 'br' THEN chr(10)
    WHEN tag = 'a' AND kind = 'open' THEN '[' WHEN tag = 'a' THEN ']' ELSE '' END, '' ORDER BY pos) AS txt,
  max(CASE WHEN tag = 'a' AND kind = 'open' THEN regexp_extract(raw, 'href="([^"]*)"', 1) END) AS href FROM b GROUP BY doc_id, block_id),
h AS (SELECT *, regexp_replace(regexp_replace(txt || CASE WHEN href IS NOT NULL THEN '(' || href || ')' ELSE '' END,
  '^\\s+|\\s+$', '', 'g'), '[ \\t]*(\\n[ \\t]*){{3,}}', chr(10) || chr(10), 'g') AS text FROM g)
SELECT doc_id, block_id, CASE WHEN k0 = 'open' AND regexp_matches(t0, '^h[1-6]$') THEN 'heading' ELSE 'paragraph' END AS type,
  CASE WHEN k0 = 'open' AND regexp_matches(t0, '^h[1-6]$') THEN CAST(substring(t0, 2, 1) AS INTEGER) END AS level,
  CASE WHEN k0 = 'open' AND t0 = 'li' THEN '- ' ELSE '' END AS marker, text FROM h WHERE text <> ''""")
def html_blocks(spark, sf):
    blocks = H.html_blocks(table(spark, sf, "pages"), "page_id", "html")
    return blocks.select("doc_id", "block_id", "type", "level", F.coalesce(F.expr(
        "try_element_at(filter(path, p -> p.what = 'item'), -1).marker"), F.lit("")).alias("marker"), "text")


BLANKS = "SELECT doc_id, concat(replace(text, '. ', concat('.', chr(10), '  ', chr(10), chr(9), chr(10))), chr(10), chr(10), 'end') AS t FROM {documents}"


@query("collapse_blanks", f"""SELECT doc_id, regexp_replace(t, '[ \\t]*(\\n[ \\t]*){{3,}}', chr(10) || chr(10), 'g') AS text
FROM ({duck(BLANKS)})""")
def collapse(spark, sf):
    return synth(spark, sf, BLANKS).select("doc_id", collapse_blanks(F.col("t")).alias("text"))


UNKNOWN = """SELECT c_custkey AS id, concat('<Foo>', c_name, '</Foo> <b>', c_mktsegment, '</b> 1 < ', c_nationkey, ' `<i>c</i>` <br> ',
 '```', chr(10), '<p>', c_name, '</p>', chr(10), '```<p align="center">z</p>') AS md FROM {customer}"""


@query("escape_unknown", """SELECT c_custkey AS doc_id, '&lt;Foo&gt;' || c_name || '&lt;/Foo&gt; <b>' || c_mktsegment || '</b> 1 &lt; ' || c_nationkey ||
 ' `&lt;i&gt;c&lt;/i&gt;` &lt;br&gt; ```' || chr(10) || '&lt;p&gt;' || c_name || '&lt;/p&gt;' || chr(10) || '```<p align="center">z</p>' AS markdown FROM customer""")
def unknown(spark, sf):
    return synth(spark, sf, UNKNOWN).select(F.col("id").alias("doc_id"), escape_unknown(F.col("md")).alias("markdown"))


@query("html_to_markdown", f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)^.*</head>', '') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(h, '<li><a href="([^"]*)">([^<]*)</a></li>', '- [\\2](\\1)' || chr(10), 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(h, '<h1>', chr(10) || chr(10) || '# ', 'g'), '</?(p|div|ul|h1)( [^>]*)?>', chr(10) || chr(10), 'g') AS h FROM b),
d AS (SELECT page_id, {duck_decode("regexp_replace(replace(h, '<br>', chr(10)), '<[^>]*>', '', 'g')")} AS h FROM c)
SELECT page_id AS doc_id, regexp_replace(regexp_replace(h, '^\\s+|\\s+$', '', 'g'), '[ \\t]*(\\n[ \\t]*){{3,}}', chr(10) || chr(10), 'g') AS markdown FROM d""")
def html_to_markdown(spark, sf):
    return H.html_to_markdown(table(spark, sf, "pages"), "page_id", "html")
