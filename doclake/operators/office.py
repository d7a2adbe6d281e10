"""Office packages as relational jobs.

A package becomes one row per document with its main XML and small lookups (relationships, numbering, styles). References
are resolved while the XML is still an array of tokens, then the tokens are exploded; running counts over the document
give blocks, paragraphs and runs, and three nested aggregations on the same distribution put the text back together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclake.functions.text import XML_ENTITIES, decode_entities, let, record, trim_ws
from doclake.operators.tokens import TAG_BODY, TOKEN, attr, tag_of, token_array
from doclake.session import cluster_by

ROW, CELL, LINK_OPEN, LINK_HREF, LINK_CLOSE = (chr(0xFDD0 + i) for i in range(5))

# Media suffixes of packages.
MEDIA_TYPES = [("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("gif", "image/gif"), ("svg", "image/svg+xml")]
# Left margins (EMU) up to which a bullet is on level 0 and 1.
BULLET_MARGINS = (400_000, 800_000)


def media_type(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for suffix, mime in MEDIA_TYPES:
        out = out.when(F.endswith(name, F.lit("." + suffix)), mime)
    return out


def _text(part: str) -> Column:
    return F.max(F.when(F.col("part") == part, F.col("content").cast("string")))


def _x(raw: Column, name: str, decode: bool = False) -> Column:
    """Attribute of an XML token; identifiers and flags need no decoding."""
    return attr(raw, name, xml=True, decode=decode)


def _elements(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"""<{tag}\b(?:[^'">]|"[^"]*"|'[^']*')*>"""), F.lit(0))


def rels_entries(xml: Column) -> Column:
    """``array<struct(rel_id, target)>`` of a relationships part."""
    return F.transform(_elements(xml, "Relationship"), lambda e: record(rel_id=_x(e, "Id"), target=_x(e, "Target", True)))


def lookup(entries: Column, field: str, value: str, key: Column) -> Column:
    """First entry whose ``field`` equals ``key``; null without one."""
    return F.get(F.filter(entries, lambda e: e[field] == key), F.lit(0))[value]


def office_rels(parts: DataFrame) -> DataFrame:
    """``doc_id, part, rel_id, target`` of every relationships part."""
    rels = parts.filter(F.endswith("part", F.lit(".rels")))
    return rels.select("doc_id", "part", F.inline(rels_entries(F.col("content").cast("string"))))


def numbering_entries(xml: Column) -> Column:
    """``array<struct(num_id, ilvl, ordered)>``: numbers joined to the levels of their abstract definition."""
    abstract = F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<w:abstractNum\b.*?</w:abstractNum>"), F.lit(0)), lambda a: F.struct(
        _x(a, "w:abstractNumId").alias("abs"),
        F.transform(F.regexp_extract_all(a, F.lit(r"(?s)<w:lvl\b.*?</w:lvl>"), F.lit(0)), lambda v: F.struct(
            _x(v, "w:ilvl").alias("ilvl"), (_x(F.get(_elements(v, "w:numFmt"), F.lit(0)), "w:val") == "decimal").alias("ordered"))).alias("levels")))
    nums = F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<w:num\b.*?</w:num>"), F.lit(0)), lambda n: F.struct(
        _x(n, "w:numId").alias("num_id"), _x(F.get(_elements(n, "w:abstractNumId"), F.lit(0)), "w:val").alias("abs")))
    return let(abstract, lambda ab: F.flatten(F.transform(nums, lambda n: F.transform(
        F.flatten(F.transform(F.filter(ab, lambda a: a["abs"] == n["abs"]), lambda a: a["levels"])),
        lambda v: F.struct(n["num_id"].alias("num_id"), v["ilvl"].alias("ilvl"), F.coalesce(v["ordered"], F.lit(False)).alias("ordered"))))))


def docx_numbering(parts: DataFrame) -> DataFrame:
    """``doc_id, num_id, ilvl, ordered``; a level is ordered exactly when its format is decimal."""
    part = parts.filter("part = 'word/numbering.xml'")
    return part.select("doc_id", F.inline(numbering_entries(F.col("content").cast("string"))))


def run_styles(text: Column, bold: Column, italic: Column, strike: Column, underline: Column, docx: bool = True) -> Column:
    """Markers of a run. Text documents of the first family add a blank and strike outside; the others keep edge blanks."""
    def wrap(t: Column, on: Column, before: str, after: str, tail: str) -> Column:
        return F.when(on, F.concat(F.lit(before), trim_ws(t), F.lit(after + tail))).otherwise(t)

    def styled(raw: Column, tail: str) -> Column:
        t = let(raw, lambda r: F.when(bold & italic, wrap(r, F.lit(True), "***", "***", tail)).when(bold, wrap(r, F.lit(True), "**", "**", tail))
                .when(italic, wrap(r, F.lit(True), "*", "*", tail)).otherwise(r if docx else trim_ws(r)))
        outer = [("<u>", "</u>", underline), ("~~", "~~", strike)]
        for rule in outer if docx else reversed(outer):
            t = let(t, outside(*rule, tail))
        return t

    def outside(before: str, after: str, on: Column, tail: str):
        return lambda r: wrap(r, on, before, after, tail)

    if docx:
        return styled(text, " ")
    return F.when(trim_ws(text) == "", text).otherwise(F.concat(
        F.when(F.startswith(text, F.lit(" ")), " ").otherwise(""), styled(text, ""), F.when(F.endswith(text, F.lit(" ")), " ").otherwise("")))


def _image(mime: Column, content: Column, inline: bool) -> Column:
    if not inline:
        return F.lit("![Image]()")
    return F.concat(F.lit("![Image](data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""), F.lit(")"))


def _media_entries(inline: bool) -> Column:
    """``array<struct(part, image)>`` of the media parts of one document; without inlining no bytes are carried."""
    mime = media_type(F.col("part"))
    return F.collect_list(F.when(mime.isNotNull(), F.struct("part", _image(mime, F.col("content"), inline).alias("image"))))


def resolve_links(text: Column) -> Column:
    """``open url href text close`` markers → Markdown link; a link without target is its text."""
    text = F.regexp_replace(text, f"{LINK_OPEN}([^{LINK_HREF}]*){LINK_HREF}([^{LINK_OPEN}{LINK_CLOSE}]*){LINK_CLOSE}", "[$2]($1)")
    return F.regexp_replace(text, f"{LINK_OPEN}[^{LINK_HREF}]*{LINK_HREF}|{LINK_CLOSE}", "")


def markdown_table(text: Column, trimmed: bool = False) -> Column:
    """Rows and cells behind markers → table text without padding or escaping; first row is the header."""
    def tail(values: Column) -> Column:
        return F.filter(values, lambda _v, i: i > 0)

    rows = F.transform(tail(F.split(text, ROW)), lambda r: F.transform(tail(F.split(r, CELL)), lambda c: trim_ws(c) if trimmed else c))

    def lines(grid: Column) -> Column:
        head = F.get(grid, F.lit(0))
        dashes = F.concat(F.lit("|"), F.array_join(F.transform(head, lambda _c: F.lit("---")), "|"), F.lit("|\n"))
        return F.array_join(F.transform(grid, lambda r, i: F.concat(
            F.lit("| "), F.array_join(r, " | "), F.lit(" |\n"), F.when(i == 0, dashes).otherwise(""))), "")

    return let(rows, lambda g: F.when(F.size(g) > 0, F.concat(lines(g), F.lit("\n"))).otherwise(""))


def _ordered(columns: list[str], value: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(value) != "", F.struct(*columns, value)))), lambda s: s[value]), "")


def _items(kind: Column, **values: Column) -> Column:
    """What a run is made of, in order: one list of ``pos, kind, …`` for all kinds; rows without a kind are not held."""
    return F.sort_array(F.collect_list(F.when(kind.isNotNull(), F.struct("pos", kind.alias("kind"), *[v.alias(n) for n, v in values.items()]))))


def _joined(items: str, kind: str) -> Column:
    values = F.transform(F.filter(items, lambda i: i["kind"] == kind), lambda i: i["value"])
    return F.when(F.size(items) == 0, "").otherwise(F.array_join(values, ""))


def _ends_after(paragraph: str, run: str, window) -> Column:
    """1 for the end of a paragraph right behind the end of a run: the two need one group, not two."""
    def end(name: str) -> Column:
        return (F.col("kind") == "close") & (F.col("tag") == name)

    return F.when(end(paragraph) & F.lag(end(run)).over(window), 1).otherwise(0)


def _so_far(value: Column, window) -> Column:
    """Last value up to each row. Rows are counted, not peers: positions are unique, and no order is compared again."""
    return F.last(value, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, 0))


def _count(cond: Column, window, before: bool = False) -> Column:
    frame = window.rowsBetween(W.unboundedPreceding, -1 if before else 0)
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)).over(frame), F.lit(0))


def _depth(tag: str, window) -> Column:
    step = F.when((F.col("tag") == tag) & (F.col("kind") == "open"), 1).when((F.col("tag") == tag) & (F.col("kind") == "close"), -1).otherwise(0)
    return F.sum(step).over(window.rowsBetween(W.unboundedPreceding, 0))


# The elements each family of documents is read from.
DOCX_TAGS = ["w:tbl", "w:tr", "w:tc", "w:p", "w:r", "w:hyperlink", "w:drawing", "w:b", "w:i", "w:strike", "w:u", "w:pStyle", "w:ilvl", "w:numId",
             "w:tab", "w:br", "a:blip"]
ODF_TAGS = ["text:h", "text:p", "text:span", "text:a", "text:list", "text:list-item", "text:line-break", "text:tab", "table:table", "table:table-row",
            "table:table-cell", "draw:image"]
PPTX_TAGS = ["p:sp", "p:cNvPr", "p:ph", "p:txBody", "a:p", "a:r", "a:rPr", "a:pPr", "a:hlinkClick", "a:buChar", "a:buAutoNum", "a:buNone", "a:tbl", "a:tr",
             "a:tc", "a:blip"]
# Of those, starts and ends that no converter reads.
DOCX_IDLE, ODF_IDLE, PPTX_IDLE = (["w:p", "w:r"], []), (["text:p"], ["text:list-item"]), (["a:p", "a:r"], ["a:rPr", "a:pPr"])


def _useful_tokens(xml: Column, tags: list[str], idle: tuple[list[str], list[str]]) -> Column:
    """Texts and the tokens of ``tags``, without the idle starts and ends; where nothing else is there these stay, so that the document does."""
    others = rf"<(?!/?(?:{'|'.join(tags)})[\s/>]){TAG_BODY}>"
    starts, ends = ([rf"{mark}(?:{'|'.join(names)})(?=[\s/>]){TAG_BODY}{end}"] * bool(names) for mark, names, end in (("<", idle[0], "(?<!/)>"), ("</", idle[1], ">")))

    def without(*skipped: str) -> Column:
        # the pattern walks over what is skipped; at the end of the text it finds nothing but the end
        return F.array_remove(F.regexp_extract_all(xml, F.lit(rf"(?:{'|'.join(skipped)})*+({TOKEN}|\z)"), F.lit(1)), "")

    return let(without(others, *starts, *ends), lambda t: F.when(F.size(t) > 0, t).otherwise(without(others)))


def _with_extra(df: DataFrame, xml: str, tags: list[str], idle: tuple[list[str], list[str]], resolve, *keep: str) -> DataFrame:
    """Token rows with ``extra``, resolved against the document's lookups before the explosion.

    Elements nobody reads are dropped while the tokens are still an array, so they never become rows.
    """
    tokens = df.select(*keep, F.posexplode(F.transform(
        _useful_tokens(F.col(xml), tags, idle), lambda t: F.struct(t.alias("raw"), resolve(t).alias("extra")))).alias("pos", "t"))
    tokens = tokens.select(*keep, "pos", "t.raw", "t.extra", tag_of(F.col("t.raw"), xml=True).alias("tag"))
    return tokens.withColumn("kind", F.when(F.col("tag") == "", "text").when(F.startswith("raw", F.lit("</")), "close")
                             .when(F.endswith("raw", F.lit("/>")), "void").otherwise("open"))


def _from_part(part: str, value) -> Column:
    """``value`` of the text of one part, worked out before the aggregation: a lookup that came after it would be
    inlined into the lambda that runs for every token."""
    return F.max(F.when(F.col("part") == part, value(F.col("content").cast("string"))))


def _gathered(parts: DataFrame, used: Column) -> DataFrame:
    """The parts a converter reads, distributed by document once: everything after it stays on that distribution."""
    return cluster_by(parts.filter(used | media_type(F.col("part")).isNotNull()), "doc_id")


def docx_documents(parts: DataFrame, inline: bool = False) -> DataFrame:
    """One row per text document: main XML and lookups; this aggregation is the only exchange of the job."""
    used = F.col("part").isin("word/document.xml", "word/_rels/document.xml.rels", "_rels/.rels", "word/numbering.xml")
    docs = _gathered(parts, used).groupBy("doc_id").agg(
        _text("word/document.xml").alias("xml"), _from_part("word/_rels/document.xml.rels", rels_entries).alias("own"),
        _from_part("_rels/.rels", rels_entries).alias("root"), _from_part("word/numbering.xml", numbering_entries).alias("numbering"),
        _media_entries(inline).alias("media"))
    return docs.filter("xml IS NOT NULL").select("doc_id", "xml", F.coalesce("own", "root").alias("rels"), "numbering", "media")


def _docx_tokens(docs: DataFrame) -> DataFrame:
    def resolve(t: Column) -> Column:
        target = lookup(F.col("rels"), "rel_id", "target", _x(t, "r:embed"))
        image = let(target, lambda p: lookup(F.col("media"), "part", "image", F.when(
            F.startswith(p, F.lit("media/")), F.concat(F.lit("word/"), p)).otherwise(p)))
        levels = F.array_join(F.transform(F.filter("numbering", lambda n: (n["num_id"] == _x(t, "w:val")) & n["ordered"]), lambda n: n["ilvl"]), ",")
        return (F.when(F.startswith(t, F.lit("<w:hyperlink")), let(_x(t, "r:id"), lambda r: lookup(F.col("rels"), "rel_id", "target", r)))
                .when(F.startswith(t, F.lit("<a:blip")), image).when(F.startswith(t, F.lit("<w:numId")), levels))

    tokens = _with_extra(docs, "xml", DOCX_TAGS, DOCX_IDLE, resolve, "doc_id")
    by_doc = W.partitionBy("doc_id").orderBy("pos")
    closed = F.col("kind") == "close"
    # added at once: one step of windows, not one after the other
    tokens = tokens.withColumns({"tables": _depth("w:tbl", by_doc), "drawings": _depth("w:drawing", by_doc), "links": _depth("w:hyperlink", by_doc),
                                 "joins": _ends_after("w:p", "w:r", by_doc)})
    ends = (closed & (F.col("tag") == "w:p") & (F.col("tables") == 0)) | (closed & (F.col("tag") == "w:tbl"))
    return tokens.select(
        "*", _count(ends, by_doc, True).alias("block"), _count(closed & (F.col("tag") == "w:p"), by_doc, True).alias("para_no"),
        _count(closed & (F.col("tag") == "w:r"), by_doc, True).alias("run_no"), _count(closed & (F.col("tag") == "w:tbl"), by_doc, True).alias("epoch"))


def docx_runs(parts: DataFrame, inline: bool = False) -> DataFrame:
    """``doc_id, block, para_no, run_no, text, bold, italic, strike, underline, style, ilvl, num_id, …`` in document order.

    Properties before a run, paragraph marks included, count for that run. ``lead`` holds what precedes the run's text:
    tabs, breaks, images, link starts and ends, and the row and cell starts of tables.
    """
    raw, tag, kind = F.col("raw"), F.col("tag"), F.col("kind")
    val = _x(raw, "w:val")
    tokens = _docx_tokens(docx_documents(parts, inline)).withColumn("val", F.when(kind != "text", val))
    void = kind == "void"

    lead = (F.when(void & (tag == "w:tab"), "\t").when(void & (tag == "w:br"), "\n").when(void & (tag == "a:blip"), F.col("extra"))
            .when((tag == "w:tr") & (kind == "open"), ROW).when((tag == "w:tc") & (kind == "open"), CELL)
            .when((tag == "w:hyperlink") & (kind == "open") & F.col("extra").isNotNull(), F.concat(F.lit(LINK_OPEN), "extra", F.lit(LINK_HREF)))
            .when((tag == "w:hyperlink") & (kind == "close"), LINK_CLOSE))
    text = F.when((kind == "text") & (F.col("drawings") == 0), decode_entities(raw, XML_ENTITIES))
    prop = F.when(void & tag.isin("w:b", "w:i", "w:strike", "w:u", "w:pStyle", "w:ilvl", "w:numId"), tag)
    tokens = tokens.withColumns({"lead": lead, "words": text}).withColumn(
        "what", F.when(F.col("words") != "", "words").when(F.col("lead") != "", "lead").otherwise(prop))
    runs = tokens.withColumn("run_no", F.col("run_no") - F.col("joins")).groupBy("doc_id", "block", "para_no", "run_no").agg(
        _items(F.col("what"), value=F.coalesce("words", "lead", "val"), extra=F.when(tag == "w:numId", F.col("extra"))).alias("items"),
        F.coalesce(F.max((tag == "w:r") & (kind == "close")), F.lit(False)).alias("ended"),
        F.max((tag == "w:p") & (kind == "close")).alias("para_ended"), F.max("tables").alias("in_table"),
        F.max(F.when((tag == "w:r") & (kind == "close"), F.col("links"))).alias("in_link"), F.min("epoch").alias("epoch"))
    runs = runs.withColumn("props", F.when(F.size("items") > 0, F.filter("items", lambda i: ~i["kind"].isin("words", "lead"))))

    def last(name: str) -> Column:
        return F.when(F.size("props") > 0, F.try_element_at(F.filter("props", lambda i: i["kind"] == name), F.lit(-1)))

    def flag(name: str) -> Column:
        return F.coalesce(F.when(F.size("props") > 0, let(last(name), lambda i: i.isNotNull() & F.coalesce(i["value"] == "true", F.lit(True)))), F.lit(False))

    return runs.select(
        "doc_id", "block", "para_no", "run_no", _joined("items", "words").alias("text"), _joined("items", "lead").alias("lead"),
        flag("w:b").alias("bold"), flag("w:i").alias("italic"), flag("w:strike").alias("strike"), last("w:u").isNotNull().alias("underline"),
        F.lower(last("w:pStyle")["value"]).alias("style"), last("w:ilvl")["value"].try_cast("int").alias("ilvl"),
        last("w:numId")["value"].alias("num_id"), last("w:numId")["extra"].alias("ordered_levels"),
        "ended", "para_ended", "in_table", "in_link", "epoch")


def _docx_paragraphs(runs: DataFrame) -> DataFrame:
    """Paragraph rows: their runs in order, heading level, list position and counter."""
    shown = F.when(F.col("ended"), F.col("text")).otherwise("")
    styled = F.when(shown == "", "").otherwise(run_styles(shown, F.col("bold"), F.col("italic"), F.col("strike"), F.col("underline")))
    runs = runs.withColumn("shown", styled)
    paras = runs.groupBy("doc_id", "block", "para_no").agg(
        F.sort_array(F.collect_list(F.struct("run_no", "lead", "shown", (F.coalesce("in_link", F.lit(0)) > 0).alias("linked")))).alias("runs"),
        F.max("style").alias("style"), F.max("ilvl").alias("ilvl"), F.max("num_id").alias("num_id"), F.max("ordered_levels").alias("ordered_levels"),
        F.max("in_table").alias("in_table"), F.max("para_ended").alias("para_ended"), F.min("epoch").alias("epoch"))
    title = F.coalesce(F.contains("style", F.lit("title")), F.lit(False))
    heading = ~title & F.coalesce(F.contains("style", F.lit("heading")), F.lit(False))
    digit = F.coalesce(F.nullif(F.regexp_extract("style", r"([0-9])[^0-9]*$", 1), F.lit("")).cast("int"), F.lit(1))
    words = F.exists("runs", lambda r: r["shown"] != "")
    paras = paras.withColumn("level", F.when(title, 1).when(heading, digit).otherwise(0)).withColumn(
        "depth", F.when((F.col("level") == 0) & (F.col("in_table") == 0) & words & F.col("ilvl").isNotNull(), F.col("ilvl") + 1).otherwise(0))
    ordered = F.array_contains(F.split(F.coalesce("ordered_levels", F.lit("")), ","), F.col("ilvl").cast("string"))
    paras = paras.withColumn("ordered", F.coalesce((F.col("depth") > 0) & ordered, F.lit(False)))
    counter = F.row_number().over(W.partitionBy("doc_id", "epoch", "depth", "ordered").orderBy("para_no"))
    return paras.withColumn("number", F.when(F.col("ordered"), counter))


def _paragraph_text() -> Column:
    first = F.array_min(F.transform(F.filter("runs", lambda r: r["shown"] != ""), lambda r: r["run_no"]))
    plain = F.array_min(F.transform(F.filter("runs", lambda r: (r["shown"] != "") & ~r["linked"]), lambda r: r["run_no"]))
    marker = F.when(F.col("depth") > 0, F.concat(F.expr("repeat('  ', depth)"), F.when(
        F.col("ordered"), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("- "))).otherwise("")
    hashes = F.when((F.col("level") > 0) & (F.col("in_table") == 0), F.concat(F.expr("repeat('#', level)"), F.lit(" "))).otherwise("")

    def piece(s: Column) -> Column:
        def one(r: Column) -> Column:
            mark = F.when(r["run_no"] == s["first"], s["marker"]).otherwise("")
            head = F.when(r["run_no"] == s["plain"], s["hashes"]).otherwise("")
            # a list marker stands before the link it opens with, otherwise right before the words
            before = F.when(r["linked"], F.concat(F.regexp_replace(r["lead"], f"{LINK_OPEN}[^{LINK_OPEN}]*$", ""), mark,
                                                  F.regexp_extract(r["lead"], f"{LINK_OPEN}[^{LINK_OPEN}]*$", 0))).otherwise(F.concat(r["lead"], mark))
            return F.concat(before, head, r["shown"])

        return F.array_join(F.transform(s["runs"], one), "")

    body = resolve_links(let(F.struct(first.alias("first"), plain.alias("plain"), marker.alias("marker"), hashes.alias("hashes"), F.col("runs")), piece))
    end = F.when((F.col("in_table") > 0) | ~F.col("para_ended"), "").when(F.col("depth") > 0, "  \n").otherwise("\n\n")
    return F.concat(body, end)


def docx_to_markdown(parts: DataFrame, inline: bool = False) -> DataFrame:
    """``doc_id, markdown`` of text documents."""
    paras = _docx_paragraphs(docx_runs(parts, inline)).withColumn("piece", _paragraph_text())
    blocks = paras.groupBy("doc_id", "block").agg(_ordered(["para_no"], "piece").alias("piece"), F.max("in_table").alias("in_table"))
    blocks = blocks.withColumn("piece", F.when(F.col("in_table") > 0, markdown_table(F.col("piece"))).otherwise(F.col("piece")))
    return blocks.groupBy("doc_id").agg(_ordered(["block"], "piece").alias("markdown"))


def docx_list_items(parts: DataFrame) -> DataFrame:
    """``doc_id, para_no, depth, ordered, number, text``; counters go on across lists and restart after a table."""
    paras = _docx_paragraphs(docx_runs(parts)).filter("depth > 0")
    text = F.array_join(F.transform("runs", lambda r: r["shown"]), "")
    return paras.select("doc_id", "para_no", "depth", "ordered", "number", text.alias("text"))


def docx_headings(parts: DataFrame) -> DataFrame:
    """``doc_id, para_no, level, text`` of titles and headings outside tables."""
    paras = _docx_paragraphs(docx_runs(parts)).filter("level > 0 AND in_table = 0")
    text = F.array_join(F.transform("runs", lambda r: r["shown"]), "")
    return paras.select("doc_id", "para_no", "level", text.alias("text")).filter("text <> ''")


def office_links(parts: DataFrame) -> DataFrame:
    """``doc_id, text, url`` of hyperlinks in text documents; ``url`` is null where the target is missing."""
    tokens = _docx_tokens(docx_documents(parts))
    by_doc = W.partitionBy("doc_id").orderBy("pos")
    links = tokens.withColumn("link_no", _count((F.col("tag") == "w:hyperlink") & (F.col("kind") == "open"), by_doc)).filter(
        (F.col("links") > 0) & ((F.col("kind") == "text") | (F.col("tag") == "w:hyperlink")))
    words = links.withColumn("words", F.when(F.col("kind") == "text", decode_entities(F.col("raw"), XML_ENTITIES)))
    return words.groupBy("doc_id", "link_no").agg(_ordered(["pos"], "words").alias("text"), F.max("extra").alias("url"))


def office_media(parts: DataFrame) -> DataFrame:
    """``doc_id, part, mime, size, rel_id``: media parts joined to the relationship that uses them."""
    media = parts.withColumn("mime", media_type(F.col("part"))).filter("mime IS NOT NULL")
    rels = office_rels(parts)
    folder = F.regexp_extract(F.col("part"), r"^([^/]*/)", 1)
    target = F.when(F.startswith("target", F.lit("../")), F.concat(folder, F.expr("substring(target, 4)"))).when(
        F.startswith("target", F.lit("media/")), F.concat(folder, "target")).otherwise(F.col("target"))
    used = rels.select("doc_id", "rel_id", target.alias("part"))
    return media.join(used, ["doc_id", "part"], "left").select("doc_id", "part", "mime", F.octet_length("content").alias("size"), "rel_id")


def office_tables(parts: DataFrame) -> DataFrame:
    """``doc_id, block, markdown`` of the tables of text documents."""
    paras = _docx_paragraphs(docx_runs(parts)).filter("in_table > 0").withColumn("piece", _paragraph_text())
    return paras.groupBy("doc_id", "block").agg(_ordered(["para_no"], "piece").alias("piece")).select(
        "doc_id", "block", markdown_table(F.col("piece")).alias("markdown"))


# ---------------------------------------------------------------------------------------------- open documents


def style_entries(xml: Column) -> Column:
    """``array<struct(name, bold, italic, strike, underline)>`` of the text styles of an open document."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<style:style\b[^>]*[^/]>.*?</style:style>"), F.lit(0))
    text_styles = F.filter(blocks, lambda b: F.coalesce(_x(b, "style:family") == "text", F.lit(False)))

    def any_(b: Column, name: str, test) -> Column:
        return F.exists(_elements(b, "style:text-properties"), lambda p: F.coalesce(test(_x(p, name)), F.lit(False)))

    return F.transform(text_styles, lambda b: F.struct(
        _x(b, "style:name").alias("name"), any_(b, "fo:font-weight", lambda v: v == "bold").alias("bold"),
        any_(b, "fo:font-style", lambda v: v == "italic").alias("italic"),
        any_(b, "style:text-line-through-style", lambda v: v != "none").alias("strike"),
        any_(b, "style:text-underline-style", lambda v: v != "none").alias("underline")))


def list_style_entries(xml: Column) -> Column:
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<text:list-style\b.*?</text:list-style>"), F.lit(0))
    return F.transform(blocks, lambda b: F.struct(_x(b, "style:name").alias("name"), F.contains(
        b, F.lit("<text:list-level-style-number")).alias("ordered")))


def odf_styles(parts: DataFrame) -> DataFrame:
    """``doc_id, name, family, bold, italic, strike, underline, ordered``."""
    content = parts.filter("part = 'content.xml'").select("doc_id", F.col("content").cast("string").alias("xml"))
    text = content.select("doc_id", F.inline(style_entries(F.col("xml"))))
    lists = content.select("doc_id", F.inline(list_style_entries(F.col("xml"))))
    off = F.lit(False)
    return text.select("doc_id", "name", F.lit("text").alias("family"), "bold", "italic", "strike", "underline", off.alias("ordered")).unionByName(
        lists.select("doc_id", "name", F.lit("list").alias("family"), off.alias("bold"), off.alias("italic"), off.alias("strike"), off.alias("underline"), "ordered"))


def odf_to_markdown(parts: DataFrame, inline: bool = False) -> DataFrame:
    """``doc_id, markdown`` of open documents: headings, nested lists with counters per list, tables, links, images."""
    docs = _gathered(parts, F.col("part") == "content.xml").groupBy("doc_id").agg(
        _text("content.xml").alias("xml"), _from_part("content.xml", style_entries).alias("styles"),
        _from_part("content.xml", list_style_entries).alias("list_styles"), _media_entries(inline).alias("media")).filter("xml IS NOT NULL")

    def resolve(t: Column) -> Column:
        style = let(_x(t, "text:style-name"), lambda n: F.get(F.filter("styles", lambda s: s["name"] == n), F.lit(0)))
        flags = let(style, lambda s: F.concat(*[F.when(s[f], c).otherwise("") for f, c in (("bold", "b"), ("italic", "i"), ("strike", "s"), ("underline", "u"))]))
        ordered = let(_x(t, "text:style-name"), lambda n: F.coalesce(lookup(F.col("list_styles"), "name", "ordered", n), F.lit(False)).cast("string"))
        return (F.when(F.startswith(t, F.lit("<text:span")), flags).when(F.startswith(t, F.lit("<text:list ")) | (t == "<text:list>"), ordered)
                .when(F.startswith(t, F.lit("<draw:image")), let(_x(t, "xlink:href"), lambda h: lookup(F.col("media"), "part", "image", h)))
                .when(F.startswith(t, F.lit("<text:a ")), _x(t, "xlink:href", True)).when(F.startswith(t, F.lit("<text:h")), _x(t, "text:outline-level")))

    tokens = _with_extra(docs, "xml", ODF_TAGS, ODF_IDLE, resolve, "doc_id")
    tag, kind, extra = F.col("tag"), F.col("kind"), F.col("extra")
    by_doc = W.partitionBy("doc_id").orderBy("pos")
    opened, closed = kind == "open", kind == "close"
    para_tag = tag.isin("text:p", "text:h")
    tokens = tokens.withColumns({
        "cells": _depth("table:table-cell", by_doc), "tables": _depth("table:table", by_doc), "lists": _depth("text:list", by_doc),
        "span": _so_far(F.when((tag == "text:span") & opened, F.coalesce(extra, F.lit(""))).when((tag == "text:span") & closed, ""), by_doc),
        "list_no": _count((tag == "text:list") & opened, by_doc)})
    ends = (closed & para_tag & (F.col("tables") == 0)) | (closed & (tag == "table:table")) | (
        closed & (tag == "text:list") & (F.col("lists") == 0)) | (opened & (tag == "text:list"))
    tokens = tokens.withColumn("block", _count(ends, by_doc, True))
    # the list a token is in: as of the last list opened or closed at its level
    level = W.partitionBy("doc_id", "lists").orderBy("pos")
    tokens = tokens.withColumn("in_list", _so_far(F.when((tag == "text:list") & opened, F.struct("list_no", (extra == "true").alias("ordered"))), level))
    raw = decode_entities(F.col("raw"), XML_ENTITIES)
    span = F.coalesce("span", F.lit(""))
    styled = F.when(span == "", F.col("words")).otherwise(run_styles(F.col("words"), *[F.contains(span, F.lit(c)) for c in "bisu"], docx=False))
    tokens = tokens.withColumn("words", F.when(kind == "text", raw)).withColumn("piece", (
        F.when(kind == "text", styled).when((kind == "void") & (tag == "text:line-break"), "\n").when((kind == "void") & (tag == "text:tab"), "\t")
        .when(opened & (tag == "draw:image"), F.concat(extra, F.lit("\n"))).when((kind == "void") & (tag == "draw:image"), extra)
        .when(opened & (tag == "table:table-row"), ROW).when(opened & (tag == "table:table-cell"), CELL)
        .when(opened & (tag == "text:a") & extra.isNotNull(), F.concat(F.lit(LINK_OPEN), extra, F.lit(LINK_HREF))).when(closed & (tag == "text:a"), LINK_CLOSE)))
    blocks = tokens.filter("lists > 0 OR tables > 0 OR piece IS NOT NULL OR tag <> ''").groupBy("doc_id", "block").agg(
        _ordered(["pos"], "piece").alias("text"), F.max("tables").alias("in_table"), F.max(F.when(closed & para_tag, tag)).alias("para"),
        F.max(F.when(opened & (tag == "text:h"), F.coalesce(extra.try_cast("int"), F.lit(1)))).alias("outline"),
        F.max(F.when(opened & (tag == "text:list-item"), True)).alias("item"),
        F.max(F.when(closed & (tag == "text:list") & (F.col("lists") == 0), True)).alias("list_end"),
        F.max_by("lists", F.when(closed & para_tag, F.col("pos"))).alias("depth"), F.max_by("in_list", F.when(closed & para_tag, F.col("pos"))).alias("in_list"))
    is_item = F.col("item").isNotNull() & F.col("para").isNotNull() & F.col("outline").isNull() & (F.col("in_table") == 0) & (F.col("depth") > 0)
    blocks = blocks.withColumn("is_item", is_item).withColumn("number", F.row_number().over(
        W.partitionBy("doc_id", "is_item", "in_list.list_no").orderBy("block")))
    body = trim_ws(resolve_links(F.col("text")))
    marker = F.concat(F.expr("repeat('  ', cast(depth - 1 as int))"), F.when(F.col("in_list.ordered"), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("- "))
    piece = (F.when(F.col("in_table") > 0, markdown_table(resolve_links(F.col("text"))))
             .when(F.col("para").isNull(), F.when(F.col("list_end"), "\n").otherwise(""))
             .when(F.col("outline").isNotNull(), F.when(body == "", "").otherwise(F.concat(F.expr("repeat('#', outline)"), F.lit(" "), body, F.lit("\n\n"))))
             .when(F.col("is_item"), F.concat(marker, body, F.lit("\n"))).otherwise(F.concat(body, F.lit("\n\n"))))
    return blocks.withColumn("piece", piece).groupBy("doc_id").agg(trim_ws(_ordered(["block"], "piece")).alias("markdown"))


# ---------------------------------------------------------------------------------------------- presentations


def pptx_slides(parts: DataFrame, inline: bool = False) -> DataFrame:
    """``doc_id, slide_no, xml, rels, notes``: slides in numeric order, notes matched by slide position."""
    number = F.coalesce(F.regexp_extract("part", r"slide([0-9]+)\.xml", 1).try_cast("int"), F.lit(0))
    key = (F.when(F.rlike("part", F.lit(r"^ppt/slides/slide.*\.xml$")), F.struct(F.lit("s").alias("k"), number.alias("n")))
           .when(F.rlike("part", F.lit(r"^ppt/slides/_rels/slide.*\.rels$")), F.struct(F.lit("r").alias("k"), number.alias("n")))
           .when(F.rlike("part", F.lit(r"^ppt/notesSlides/notesSlide[0-9]+\.xml$")), F.struct(F.lit("n").alias("k"), F.regexp_extract("part", r"([0-9]+)\.xml", 1).cast("int").alias("n"))))
    one = _gathered(parts.withColumn("key", key), F.col("key").isNotNull()).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("key.k") == "s", F.struct(F.col("key.n").alias("n"), F.col("content").cast("string").alias("xml"))))).alias("slides"),
        F.collect_list(F.when(F.col("key.k") == "r", F.struct(F.col("key.n").alias("n"), rels_entries(F.col("content").cast("string")).alias("rels")))).alias("rels"),
        F.collect_list(F.when(F.col("key.k") == "n", F.struct(F.col("key.n").alias("n"), notes_text(F.col("content").cast("string")).alias("notes")))).alias("notes"),
        _media_entries(inline).alias("media"))
    slides = one.select("doc_id", "rels", "notes", "media", F.posexplode("slides").alias("at", "s"))
    return slides.select(
        "doc_id", (F.col("at") + 1).alias("slide_no"), F.col("s.xml").alias("xml"), "media",
        lookup(F.col("rels"), "n", "rels", F.col("s.n")).alias("rels"), lookup(F.col("notes"), "n", "notes", F.col("at") + 1).alias("notes"))


def notes_text(xml: Column) -> Column:
    """Text of the body placeholder of a notes part: trimmed pieces joined by one blank."""
    shapes = F.filter(F.regexp_extract_all(xml, F.lit(r"(?s)<p:sp>.*?</p:sp>"), F.lit(0)), lambda s: F.coalesce(
        F.get(F.transform(F.slice(F.reverse(_elements(s, "p:ph")), 1, 1), lambda e: _x(e, "type")), F.lit(0)) == "body", F.lit(False)))
    bodies = F.transform(shapes, lambda s: F.regexp_extract(s, r"(?s)<p:txBody>.*</p:txBody>", 0))
    words = F.filter(F.transform(F.filter(token_array(F.array_join(bodies, "")), lambda t: ~F.startswith(t, F.lit("<"))), trim_ws), lambda t: t != "")
    return F.nullif(decode_entities(F.array_join(words, " "), XML_ENTITIES), F.lit(""))


def pptx_notes(parts: DataFrame) -> DataFrame:
    """``doc_id, slide_no, notes`` of slides that have notes."""
    return pptx_slides(parts).filter("notes IS NOT NULL").select("doc_id", "slide_no", "notes")


def bullet_level(margin: Column) -> Column:
    return F.when(margin <= BULLET_MARGINS[0], 0).when(margin <= BULLET_MARGINS[1], 1).otherwise(2)


def _slide_tokens(parts: DataFrame, inline: bool = False) -> DataFrame:
    def resolve(t: Column) -> Column:
        target = let(_x(t, "r:embed"), lambda r: lookup(F.col("rels"), "rel_id", "target", r))
        image = let(target, lambda p: lookup(F.col("media"), "part", "image", F.when(
            F.startswith(p, F.lit("../")), F.concat(F.lit("ppt/"), F.substring(p, F.lit(4), F.length(p)))).otherwise(p)))
        return (F.when(F.startswith(t, F.lit("<a:hlinkClick")), let(_x(t, "r:id"), lambda r: F.coalesce(lookup(F.col("rels"), "rel_id", "target", r), F.lit(""))))
                .when(F.startswith(t, F.lit("<a:blip")), image))

    tokens = _with_extra(pptx_slides(parts, inline), "xml", PPTX_TAGS, PPTX_IDLE, resolve, "doc_id", "slide_no", "notes")
    tokens = tokens.withColumn("notes", F.when(F.col("pos") == 0, F.col("notes")))  # once a slide, not in every row
    by_slide = W.partitionBy("doc_id", "slide_no").orderBy("pos")
    tag, kind = F.col("tag"), F.col("kind")
    # pictures and frames are shapes too: properties name the shape that everything after them belongs to
    return tokens.withColumns({
        "shape_id": _so_far(F.when(tag == "p:cNvPr", _x(F.col("raw"), "id")), by_slide), "bodies": _depth("p:txBody", by_slide),
        "cells": _depth("a:tc", by_slide), "tables": _depth("a:tbl", by_slide),
        "in_ph": _so_far(F.when(tag == "p:ph", True).when((tag == "p:sp") & (kind == "open"), False), by_slide),
        "run_no": _count((kind == "close") & (tag == "a:r"), by_slide, True), "joins": _ends_after("a:p", "a:r", by_slide)})


def _title_shapes(tokens: DataFrame) -> DataFrame:
    """Adds ``title_id``: the first title placeholder, else the shape with the largest font, the first on ties."""
    tag, raw = F.col("tag"), F.col("raw")
    by_slide = W.partitionBy("doc_id", "slide_no")
    type_ = F.when(tag == "p:ph", _x(raw, "type"))
    size = F.when((tag == "a:rPr") & ~F.coalesce("in_ph", F.lit(False)) & F.col("kind").isin("open", "void"), _x(raw, "sz").try_cast("int"))
    tokens = tokens.withColumn("ph", type_).withColumn("sz", size)
    is_title = F.col("ph").isin("title", "ctrTitle")
    placeholder = F.min_by("shape_id", F.when(is_title, F.col("pos"))).over(by_slide)
    biggest = F.max_by("shape_id", F.when(F.col("sz") > 0, F.struct("sz", (-F.col("pos")).alias("p")))).over(by_slide)
    return tokens.withColumn("title_id", F.coalesce(placeholder, biggest))


def pptx_titles(parts: DataFrame) -> DataFrame:
    """``doc_id, slide_no, shape_id, text`` of the title shape of each slide."""
    tokens = _title_shapes(_slide_tokens(parts)).filter((F.col("shape_id") == F.col("title_id")) & (F.col("kind") == "text") & (F.col("bodies") > 0))
    return tokens.withColumn("words", decode_entities(F.col("raw"), XML_ENTITIES)).groupBy("doc_id", "slide_no", "shape_id").agg(
        _ordered(["pos"], "words").alias("text"))


def pptx_to_markdown(parts: DataFrame, inline: bool = False) -> DataFrame:
    """``doc_id, markdown``: slides in order, empty ones dropped, separated by rules."""
    tag, kind, raw, extra = F.col("tag"), F.col("kind"), F.col("raw"), F.col("extra")
    opened, closed = kind == "open", kind == "close"
    by_slide = W.partitionBy("doc_id", "slide_no").orderBy("pos")
    tokens = _title_shapes(_slide_tokens(parts, inline))
    # the latest of name and placeholder decides whether text is a title; a new or closed shape clears it
    title = _so_far(F.when(tag == "p:cNvPr", F.coalesce(_x(raw, "id") == F.col("title_id"), F.lit(False)))
                    .when(tag == "p:ph", F.coalesce(F.col("ph").isin("title", "ctrTitle"), F.lit(False)))
                    .when(tag == "p:sp", F.lit(False)), by_slide)
    in_body = (F.col("bodies") > 0)
    ends = (closed & (tag == "a:p") & in_body) | (closed & (tag == "a:tbl")) | (closed & (tag == "p:txBody"))
    tokens = tokens.withColumns({"titled": title, "block": _count(ends, by_slide, True)})
    rpr = (tag == "a:rPr") & opened
    hlink = tag == "a:hlinkClick"
    runs = tokens.withColumns({
        "words": F.when((kind == "text") & (in_body | (F.col("cells") > 0)), decode_entities(raw, XML_ENTITIES)),
        "lead": F.when(opened & (tag == "a:tr"), ROW).when(opened & (tag == "a:tc"), CELL),
        "image": F.when((tag == "a:blip") & ~closed & extra.isNotNull(), F.concat(extra, F.lit("\n"))),
        "props": F.when(rpr, F.struct(F.coalesce(_x(raw, "b") == "1", F.lit(False)).alias("b"), F.coalesce(_x(raw, "i") == "1", F.lit(False)).alias("i"),
                                      F.coalesce(_x(raw, "strike").isin("sngStrike", "dblStrike"), F.lit(False)).alias("s"),
                                      F.coalesce(_x(raw, "u") != "none", F.lit(False)).alias("u"))),
        "margin": F.when((tag == "a:pPr") & opened & in_body, F.coalesce(_x(raw, "marL").try_cast("bigint"), F.lit(0)))})
    what = F.when(F.col("words") != "", "words").when(F.col("lead") != "", "lead").when(F.col("image") != "", "image")
    runs = runs.withColumn("joins", F.when(in_body, F.col("joins")).otherwise(0)).withColumn("run_no", F.col("run_no") - F.col("joins")).groupBy("doc_id", "slide_no", "block", "run_no").agg(
        _items(what, value=F.coalesce("words", "lead", "image")).alias("items"),
        F.max_by("props", F.when(F.col("props").isNotNull(), F.col("pos"))).alias("props"),
        F.max(F.when(hlink, F.coalesce(extra, F.lit("")))).alias("url"), F.min_by("margin", F.when(F.col("margin").isNotNull(), F.col("pos"))).alias("margin"),
        F.max(tag.isin("a:buChar", "a:buAutoNum")).alias("bullet"), F.max(tag == "a:buNone").alias("none"), F.max("tables").alias("in_table"),
        F.max(closed & (tag == "a:p") & in_body).alias("para"), F.max(closed & (tag == "p:txBody")).alias("body_end"),
        F.greatest(F.max_by("titled", F.when(closed & (tag == "a:p") & (F.col("joins") == 0), F.col("pos"))), F.max(F.when(F.col("joins") == 1, F.col("titled")))).alias("titled"), F.max("notes").alias("notes"))
    runs = runs.withColumns({k: _joined("items", k) for k in ("words", "lead", "image")}).drop("items")
    off = F.lit(False)
    flags = [F.coalesce(F.col(f"props.{f}"), off) for f in "bisu"]
    text = F.when(F.col("url").isNotNull() & (F.col("in_table") == 0), F.concat(F.lit("["), trim_ws(F.col("words")), F.lit("]("), "url", F.lit(")"))).otherwise(
        run_styles(F.col("words"), *flags, docx=False))
    blocks = runs.withColumn("piece", F.concat("lead", text)).groupBy("doc_id", "slide_no", "block").agg(
        _ordered(["run_no"], "piece").alias("text"), _ordered(["run_no"], "image").alias("images"),
        F.min_by("margin", F.when(F.col("margin").isNotNull(), F.col("run_no"))).alias("margin"), F.max("bullet").alias("bullet"), F.max("none").alias("none"),
        F.max("in_table").alias("in_table"), F.max("para").alias("para"), F.max("body_end").alias("body_end"), F.max("titled").alias("titled"), F.max("notes").alias("notes"))
    body = trim_ws(F.col("text"))
    margin = F.coalesce("margin", F.lit(0))
    bullet = ((margin > 0) | F.col("bullet")) & ~F.col("none")
    level = F.when((margin > 0) & ~F.col("none"), bullet_level(margin)).otherwise(0)
    clean = trim_ws(F.regexp_replace(F.regexp_replace(body, r"^\*+|\*+$", ""), r"^~+|~+$", ""))
    para = (F.when(body == "", "\n").when(F.col("titled"), F.concat(F.lit("# "), clean, F.lit("\n")))
            .when(bullet, F.concat(F.repeat(F.lit("  "), level), F.lit("- "), body, F.lit("\n"))).otherwise(F.concat(body, F.lit("\n"))))
    piece = F.concat("images", F.when(F.col("in_table") > 0, markdown_table(F.col("text"), trimmed=True)).when(F.col("para"), para)
                     .when(F.col("body_end"), "\n").otherwise(""))
    slides = blocks.withColumn("piece", piece).groupBy("doc_id", "slide_no").agg(_ordered(["block"], "piece").alias("md"), F.max("notes").alias("notes"))
    whole = trim_ws(F.concat("md", F.coalesce(F.concat(F.lit("\n> "), "notes", F.lit("\n")), F.lit(""))))
    slides = slides.withColumn("slide", whole)
    kept = F.transform(F.sort_array(F.collect_list(F.when(F.col("slide") != "", F.struct("slide_no", "slide")))), lambda s: s["slide"])
    return slides.groupBy("doc_id").agg(F.array_join(kept, "\n\n---\n\n").alias("markdown"))
