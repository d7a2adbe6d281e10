"""Classification: bytes and extensions derived from documents, MIME types and paths from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.functions import detect as D
from doclake.functions.text import strip_ansi, trim_ws, utf8_valid, visible_length
from doclake.operators.listing import ext_category
from doclake.plans.registry import duck, query, synth, table


def _hex(text: str) -> str:
    return text.encode().hex().upper()


# (leading bytes, extension, kind, format, image, svg, mermaid); the document's own text follows the bytes
SAMPLES = [
    ("255044462D", "txt", "Pdf", "text", False, False, False),
    ("89504E470D0A1A0A", "md", "Image", "markdown", True, False, False),
    ("474946383961", "mp4", "Gif", "image", True, False, False),
    ("FFD8FFE0", "", "Image", "image", True, False, False),
    ("1A45DFA3", "webm", "Video", "video", False, False, False),
    ("4D5A9000", "bin", "Exe", "app", False, False, False),
    (_hex('<?xml version="1.0"?>\n<!-- c --><svg width="3">'), "html", "Svg", "html", False, True, False),
    (_hex("---\ntitle: x\n---\n\n%% c\nflowchart TD\n"), "mmd", "Mermaid", "text", False, False, True),
    (_hex("plain words\n"), "mmd", "Markdown", "markdown", False, False, False),
    (_hex("graph(a)\n"), "mermaid", "Mermaid", "text", False, False, True),
    (_hex("just text "), "rs", None, "text", False, False, False),
    ("C328", "dat", None, "binary", False, False, False),
    ("52494646AAAAAAAA57454250", "docx", "Image", "docx", True, False, False),
    ("504B0304", "jar", None, "package", False, False, False),
    ("504B0304", "dat", None, "zip", False, False, False),
    (_hex("<svgx>"), "tex", "Tex", "text", False, False, False),
    (_hex("a,b\n1,2\n"), "csv", None, "csv", False, False, False),
    ("0000667479706176696600", "", None, "text", False, False, False),
    ("00000000667479706176696600", "typ", "Image", "image", True, False, False),
    ("01020000667479706176696600", "svg", "Svg", "image", False, False, False),
    ("FF0A", "url", "JpegXL", "binary", False, False, False),
    (_hex("[InternetShortcut]\n"), "url", "Url", "text", False, False, False),
    ("D0CF11E0A1B11AE1", "png", "Image", "xls", False, False, False),
    ("494433", "mp3", None, "audio", False, False, False),
]
N = len(SAMPLES)


def _pick(i: int) -> str:
    def value(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'"

    return f"CASE doc_id % {N} " + " ".join(f"WHEN {n} THEN {value(s[i])}" for n, s in enumerate(SAMPLES)) + " END"


MAGIC = f"SELECT doc_id, unhex(concat({_pick(0)}, hex(text))) AS content, {_pick(1)} AS ext FROM {{documents}}"


def _expected(i: int, name: str) -> str:
    return f"SELECT doc_id, {_pick(i)} AS {name} FROM documents"


@query("detect_kind", _expected(2, "kind"))
def detect_kind(spark, sf):
    return synth(spark, sf, MAGIC).select("doc_id", D.detect_kind(F.col("content"), F.col("ext")).alias("kind"))


@query("detect_format", _expected(3, "format"))
def detect_format(spark, sf):
    return synth(spark, sf, MAGIC).select("doc_id", D.detect_format(F.col("content"), F.col("ext")).alias("format"))


@query("image_sniff", _expected(4, "is_image"))
def image_sniff(spark, sf):
    return synth(spark, sf, MAGIC).select("doc_id", D.is_image(F.col("content")).alias("is_image"))


@query("svg_sniff", _expected(5, "is_svg"))
def svg_sniff(spark, sf):
    return synth(spark, sf, MAGIC).select("doc_id", D.is_svg(F.col("content")).alias("is_svg"))


@query("mermaid_sniff", _expected(6, "is_mermaid"))
def mermaid_sniff(spark, sf):
    return synth(spark, sf, MAGIC).select("doc_id", D.is_mermaid(F.col("content")).alias("is_mermaid"))


MIMES = [("text/html; charset=utf-8", "Html"), ("image/png", "Image"), ("application/json", "PreMarkdown"),
         ("text/weird", "PreMarkdown"), ("font/woff", None), (" video/mp4 ;x=1", "Video"), ("image/svg+xml", "Svg"),
         ("application/octet-stream", None)]
MIME_CASE = f"CASE page_id % {len(MIMES)} " + " ".join(f"WHEN {i} THEN '{m}'" for i, (m, _) in enumerate(MIMES)) + " END"
KIND_CASE = f"CASE page_id % {len(MIMES)} " + " ".join(
    f"WHEN {i} THEN " + ("NULL" if k is None else f"'{k}'") for i, (_, k) in enumerate(MIMES)) + " END"
MIME_ROWS = f"""SELECT page_id, concat(split_part(url, '?', 1), CASE WHEN page_id % 3 = 0 THEN '/a.pdf?x=1' ELSE '/b.bin' END) AS url, {MIME_CASE} AS mime,
 CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status,
 unhex(CASE WHEN page_id % 4 = 1 THEN concat('474946383961', hex(html)) ELSE hex(html) END) AS content FROM {{pages}}"""


@query("mime_kind", f"SELECT page_id, {KIND_CASE} AS kind FROM pages")
def mime_kind(spark, sf):
    return D.mime_kind(synth(spark, sf, MIME_ROWS), "mime").select("page_id", "kind")


@query("resolve_kind", f"""SELECT page_id, CASE WHEN declared IS NULL OR declared = 'Html' THEN declared
  WHEN page_id % 3 = 0 AND page_id % 4 <> 1 THEN 'Pdf' WHEN page_id % 4 = 1 THEN 'Gif' ELSE declared END AS kind FROM (
  SELECT page_id, CASE WHEN page_id % {len(MIMES)} = {len(MIMES) - 1} THEN CASE WHEN page_id % 3 = 0 THEN 'Pdf' END ELSE {KIND_CASE} END AS declared
  FROM pages)""")
def resolve_kind(spark, sf):
    return D.resolve_kind(synth(spark, sf, MIME_ROWS), "url", "mime", "content").select("page_id", "kind")


@query("file_ext", """SELECT page_id, lower(regexp_extract(regexp_extract(url, '[^/]*$', 0), '^.+\\.([^.]*)$', 1)) AS ext,
  list_last(string_split(list_last(string_split(string_split(url, '?')[1], '/')), '.')) AS url_ext FROM pages""")
def file_ext(spark, sf):
    return table(spark, sf, "pages").select("page_id", D.file_ext(F.col("url")).alias("ext"), D.url_ext(F.col("url")).alias("url_ext"))


EXT_NAMES = ["main.RS", "a.py", ".gitignore", "x.conf", "pack.zip", "notes", "readme.md", "b.weird", "Makefile.mk", "t.tar.gz"]
EXT_KINDS = ["code", "code", "config", "config", "archive", "plain", "code", "text", "config", "archive"]
EXT_ROWS = ("SELECT page_id, concat(split_part(url, '?', 1), '/', CASE page_id % 10 " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate(EXT_NAMES)) + " END) AS path, page_id % 11 = 0 AS is_dir FROM {pages}")


@query("ext_category", "SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'folder' ELSE CASE page_id % 10 " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate(EXT_KINDS)) + " END END AS category FROM pages")
def category(spark, sf):
    return ext_category(synth(spark, sf, EXT_ROWS), "path", "is_dir").select("page_id", "category")


@query("utf8_valid", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE ELSE FALSE END AS valid FROM documents""")
def valid(spark, sf):
    src = synth(spark, sf, """SELECT doc_id, unhex(concat(CASE doc_id % 4 WHEN 0 THEN 'EFBBBF' WHEN 1 THEN 'C328' WHEN 2 THEN '' ELSE 'F0808080' END,
      hex(text))) AS content FROM {documents}""")
    return src.select("doc_id", utf8_valid(F.col("content")).alias("valid"))


LINK_ROWS = f"""SELECT doc_id, unhex(concat({_pick(0)}, hex(text))) AS content, nullif({_pick(1)}, '') AS ext, concat('/d/', doc_id) AS path FROM {{documents}}"""


@query("fallback_link", f"""WITH x AS (SELECT doc_id, text, {_pick(0)} AS pre, nullif({_pick(1)}, '') AS ext, {_pick(3)} AS fmt, '/d/' || doc_id AS path FROM documents)
SELECT doc_id, CASE fmt WHEN 'image' THEN '![Image](' || path || ')' WHEN 'audio' THEN '<audio controls src="' || path || '"></audio>'
 WHEN 'video' THEN '![Video](' || path || ')'
 WHEN 'text' THEN '```' || coalesce(ext, '') || chr(10) || decode(unhex(pre)) || text || chr(10) || '```'
 WHEN 'html' THEN '```html' || chr(10) || decode(unhex(pre)) || text || chr(10) || '```'
 WHEN 'markdown' THEN CASE WHEN pre LIKE '89%' THEN NULL ELSE decode(unhex(pre)) || text END
 ELSE '[' || coalesce(ext, 'Bin') || ' file](' || path || ')' END AS markdown FROM x""")
def fallback_link(spark, sf):
    src = synth(spark, sf, LINK_ROWS)
    fmt = D.detect_format(F.col("content"), F.col("ext"))
    return src.withColumn("fmt", fmt).select("doc_id", D.fallback_link(
        F.col("content"), F.col("fmt"), F.col("path"), F.col("ext")).alias("markdown"))


DATA_URIS = "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'data:x;base64,@@' WHEN doc_id % 4 = 2 THEN concat('http://', lang) ELSE 'data:text/plain;base64,' END AS head, text FROM {documents}"


@query("decode_data_uri", "SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN text END AS text FROM documents")
def decode_data_uri(spark, sf):
    src = synth(spark, sf, DATA_URIS)
    url = F.when(F.col("doc_id") % 4 < 2, F.concat("head", F.base64(F.col("text").cast("binary")))).otherwise(F.col("head"))
    return src.select("doc_id", D.decode_data_uri(url).cast("string").alias("text"))


@query("embed_data_uri", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '![Image]()' ELSE '![Image](data:image/' || lang || ';base64,' || to_base64(encode(text)) || ')' END AS markdown
FROM documents""")
def embed_data_uri(spark, sf):
    src = table(spark, sf, "documents")
    return src.select("doc_id", D.embed_data_uri(F.col("text").cast("binary"), F.concat(F.lit("image/"), "lang"),
                                                 F.col("doc_id") % 3 != 0).alias("markdown"))


HEADERS = """SELECT p_partkey, unhex(CASE p_partkey % 4
  WHEN 0 THEN concat('89504E470D0A1A0A0000000D49484452', lpad(hex(p_size), 8, '0'), lpad(hex(p_size + 300), 8, '0'))
  WHEN 1 THEN concat('474946383961', hex(p_size + 20), '01', hex(p_size + 30), '00')
  WHEN 2 THEN concat('424D', repeat('00', 16), hex(p_size + 16), '020000', hex(p_size + 17), '000000')
  ELSE 'FFD8FF' END) AS content FROM {part}"""


@query("image_size", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size + 20 + 256 WHEN 2 THEN p_size + 16 + 512 END AS width,
 CASE p_partkey % 4 WHEN 0 THEN p_size + 300 WHEN 1 THEN p_size + 30 WHEN 2 THEN p_size + 17 END AS height FROM part""")
def image_size(spark, sf):
    src = synth(spark, sf, HEADERS.replace("hex(p_size", "hex(0L + p_size"))
    return src.withColumn("s", D.image_size(F.col("content"))).select("p_partkey", "s.width", "s.height")


ANSI = "SELECT event_id, concat('  ', chr(27), '[31m', event_type, chr(27), '[0m ', chr(27), '[1;4m', props, chr(27), '[K  ') AS line FROM {events}"


@query("strip_ansi", f"""SELECT event_id, trim(regexp_replace(line, '\\x1b\\[[0-9;]*[A-Za-z]', '', 'g')) AS text,
 length(regexp_replace(line, '\\x1b\\[[0-9;]*[A-Za-z]', '', 'g')) AS visible FROM ({duck(ANSI)})""")
def ansi(spark, sf):
    src = synth(spark, sf, ANSI)
    return src.select("event_id", trim_ws(strip_ansi(F.col("line"))).alias("text"), visible_length(F.col("line")).alias("visible"))
