"""HTML → structure and Markdown.

Extractors that need no ancestry (text, links, headings, images) are map-only projections over the page. Everything
that depends on ancestry distributes the pages once by document and then works on token rows with per-document
windows; those windows and aggregations all reuse the one distribution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclake.functions.inline import image_markdown, inline_markdown, inline_token, resolve_inline
from doclake.functions.text import collapse_blanks, decode_entities, let, trim_ws
from doclake.operators.tokens import attr, explode_tokens, strip_opaque, token_array
from doclake.session import cluster_by

# Tags that start and end a block.
BLOCK_TAGS = [
    "p", "div", "figure", "figcaption", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "blockquote",
    "details", "summary", "pre", "table",
]
LIST_TAGS = ["ul", "ol"]
QUOTE_TAGS = ["blockquote", "details"]
CONTAINER_TAGS = ["ul", "ol", "li", "blockquote", "details"]
OPAQUE_TAGS = ["table", "pre"]
ROW, CELL, ALIGN = (chr(0xFDEC + i) for i in range(3))
INNER, INNER_END = "\U0001fffe", "\U0001ffff"  # around a table inside a cell


def _pages(df: DataFrame, id: str, html: str) -> DataFrame:
    return df.select(F.col(id).alias("doc_id"), F.col(html).alias("_markup"))


def html_text(df: DataFrame, id: str, html: str) -> DataFrame:
    """Plain text, every tag transparent; one projection per page."""
    texts = F.filter(token_array(strip_opaque(F.col(html))), lambda t: ~F.startswith(t, F.lit("<")) | (t == "<"))
    return df.select(id, html).select(F.col(id).alias("doc_id"), decode_entities(F.array_join(texts, "")).alias("text"))


def html_links(df: DataFrame, id: str, html: str) -> DataFrame:
    """``doc_id, link_no, href, text, markdown`` of every anchor in page order."""
    # a link that is not closed ends where the next one starts, or with the page
    pattern = F.lit(r"(?is)<a((?:\s[^>]*+)?)>((?:[^<]++|<(?!/?a[\s>]))*+)")
    source = strip_opaque(F.col(html))
    pairs = F.arrays_zip(F.regexp_extract_all(source, pattern, F.lit(1)).alias("attrs"),
                         F.regexp_extract_all(source, pattern, F.lit(2)).alias("body"))
    links = df.select(id, html).select(F.col(id).alias("doc_id"), F.posexplode(pairs).alias("link_no", "link"))
    links = links.select("doc_id", "link_no", F.trim(attr(F.concat(F.lit("<a"), F.col("link.attrs"), F.lit(">")), "href")).alias("href"),
                         inline_markdown(F.col("link.body")).alias("text"))
    keep_link = F.col("href").isNotNull() & ~F.contains("text", F.lit("\n"))
    return links.withColumn("markdown", F.when(keep_link, F.concat(
        F.lit("["), F.col("text"), F.lit("]("), F.col("href"), F.lit(")"))).otherwise(F.col("text")))


def html_headings(df: DataFrame, id: str, html: str) -> DataFrame:
    """``doc_id, heading_no, level, text`` for h1-h6."""
    # a heading that is not closed ends where another one starts or ends, or with the page
    pattern = F.lit(r"(?is)<h([1-6])(?:\s[^>]*+)?>((?:[^<]++|<(?!/?h[1-6][\s>]))*+)")
    source = strip_opaque(F.col(html))
    pairs = F.arrays_zip(F.regexp_extract_all(source, pattern, F.lit(1)).alias("level"),
                         F.regexp_extract_all(source, pattern, F.lit(2)).alias("body"))
    heads = df.select(id, html).select(F.col(id).alias("doc_id"), F.posexplode(pairs).alias("heading_no", "h"))
    return heads.select("doc_id", "heading_no", F.col("h.level").cast("int").alias("level"),
                        inline_markdown(F.col("h.body")).alias("text"))


def html_images(df: DataFrame, id: str, html: str) -> DataFrame:
    """``doc_id, pos, src, alt, markdown`` of every ``<img>``."""
    tokens = explode_tokens(_pages(df, id, html), "_markup", "doc_id").filter(
        (F.col("tag") == "img") & (F.col("kind") != "close"))
    raw = F.col("raw")
    return tokens.select("doc_id", "pos", F.coalesce(attr(raw, "src"), F.lit("")).alias("src"),
                         F.coalesce(attr(raw, "alt"), F.lit("IMG")).alias("alt"), image_markdown(raw).alias("markdown"))


def html_inline(df: DataFrame, id: str, html: str) -> DataFrame:
    """Inline rules applied to a fragment without block structure."""
    return df.select(id, html).select(F.col(id).alias("doc_id"), inline_markdown(strip_opaque(F.col(html))).alias("markdown"))


def nested_tokens(df: DataFrame, id: str, html: str) -> DataFrame:
    """Token rows with running container state.

    ``level`` counts open lists, items and quotes; ``opaque`` counts open tables and code blocks; ``boundary`` marks a
    token that starts a new block, ``block_id`` numbers the blocks. ``<li>`` directly after an unclosed ``<li>`` closes
    it, and so does the end of its list.
    """
    tokens = explode_tokens(cluster_by(_pages(df, id, html), "doc_id"), "_markup", "doc_id")
    by_doc = W.partitionBy("doc_id").orderBy("pos")
    opened, closed = F.col("kind") == "open", F.col("kind") == "close"
    step = F.when(opened, 1).when(closed, -1).otherwise(0)
    container = F.col("tag").isin(CONTAINER_TAGS)
    last_container = F.last(F.when(container, F.concat("kind", F.lit(" "), "tag")), ignorenulls=True).over(
        by_doc.rowsBetween(W.unboundedPreceding, -1))
    implied = (F.col("before") == "open li") & ((opened & (F.col("tag") == "li")) | (closed & F.col("tag").isin(LIST_TAGS)))
    tokens = tokens.withColumn("before", last_container).withColumn("implied", F.when(F.coalesce(implied, F.lit(False)), 1).otherwise(0))
    tokens, levels = open_counts(tokens, {t: F.when(F.col("tag") == t, step).otherwise(0) - (F.col("implied") if t == "li" else 0) for t in CONTAINER_TAGS})
    tokens, tables = open_counts(tokens, {t: F.when(F.col("tag") == t, step).otherwise(0) for t in OPAQUE_TAGS})
    tokens = tokens.withColumn("level", levels).withColumn("opaque", tables).withColumn("tables", F.col("_open_table"))
    outside = (F.col("opaque") == 0) | (F.coalesce(F.lag("opaque").over(by_doc), F.lit(0)) == 0)
    return (
        tokens.withColumn("boundary", (F.col("tag").isin(BLOCK_TAGS) & outside)
                          | F.coalesce(F.lag("tag").over(by_doc) == "hr", F.lit(False)))
        .withColumn("block_id", F.sum(F.col("boundary").cast("int")).over(by_doc))
    )


def open_counts(tokens: DataFrame, steps: dict[str, Column]) -> tuple[DataFrame, Column]:
    """Adds ``_open_<name>``: how many of each are open after every token; and the sum of all of them.

    An end without a start counts for nothing: the running sum less its own minimum so far never goes below zero.
    """
    by_doc = W.partitionBy("doc_id").orderBy("pos")
    tokens = tokens.withColumns({f"_sum_{n}": F.sum(s).over(by_doc) for n, s in steps.items()})
    tokens = tokens.withColumns({f"_open_{n}": F.col(f"_sum_{n}") - F.least(F.lit(0), F.min(f"_sum_{n}").over(by_doc)) for n in steps})
    return tokens.drop(*[f"_sum_{n}" for n in steps]), reduce(lambda a, b: a + b, [F.col(f"_open_{n}") for n in steps])


def html_nesting(df: DataFrame, id: str, html: str) -> DataFrame:
    """How many containers of each class are open at every token."""
    tokens = explode_tokens(cluster_by(_pages(df, id, html), "doc_id"), "_markup", "doc_id")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)

    classes = {"in_list": LIST_TAGS, "in_table": ["table"], "in_quote": QUOTE_TAGS, "in_pre": ["pre"], "in_heading": ["h1", "h2", "h3", "h4", "h5", "h6"], "in_link": ["a"]}
    tokens, _ = open_counts(tokens, {n: F.when(F.col("tag").isin(*tags), step).otherwise(0) for n, tags in classes.items()})
    return tokens.select("doc_id", "pos", "kind", "tag", *[F.col(f"_open_{n}").alias(n) for n in classes])


def _token_text() -> Column:
    """Text one token adds to its block; inside a table the row and cell structure becomes marker characters."""
    raw, tag, opened = F.col("raw"), F.col("tag"), F.col("kind") != "close"
    in_table = F.col("opaque") > 0
    return (
        F.when((tag == "table") & opened & (F.col("tables") > 1), INNER).when((tag == "table") & ~opened & (F.col("tables") > 0), INNER_END)
        .when(tag == "tr", F.when(opened, ROW).otherwise(""))
        .when(tag.isin("td", "th"), F.when(opened, F.concat(
            F.lit(CELL), F.coalesce(F.trim(attr(raw, "align", decode=False)), F.lit("")), F.lit(ALIGN))).otherwise(""))
        .when(F.col("boundary") & tag.isin(BLOCK_TAGS), F.when(opened & (tag == "hr"), "---").otherwise(""))
        .when(in_table & (tag == "li") & opened, "\n- ")
        .when(in_table & tag.isin(BLOCK_TAGS), "\n")
        .otherwise(inline_token(raw, tag)))


def _cell_text(cell: Column) -> Column:
    body = F.replace(trim_ws(F.substring_index(cell, ALIGN, -1)), F.lit("|"), F.lit("\\|"))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "<br>")


def _tail(values: Column) -> Column:
    return F.filter(values, lambda _v, i: i > 0)


def with_inner_tables(text: Column, tables: Column) -> Column:
    """Marked table text in which every table inside a cell is its pipe table, innermost first; ``tables`` is how deep they nest."""
    pieces = F.lit(f"{INNER}[^{INNER}{INNER_END}]*{INNER_END}|[^{INNER}]+|{INNER}")

    def inward(t: Column, _i: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(t, pieces, F.lit(0)), lambda p: F.when(
            F.startswith(p, F.lit(INNER)) & F.endswith(p, F.lit(INNER_END)), F.concat(F.lit("\n"), let(table_grid(F.translate(p, INNER + INNER_END, "")), table_markdown), F.lit("\n"))).otherwise(p)), "")

    def closed(t: Column) -> Column:
        missing = F.length(F.replace(t, F.lit(INNER_END), F.lit(""))) - F.length(F.replace(t, F.lit(INNER), F.lit("")))
        return F.translate(F.aggregate(F.sequence(F.lit(1), tables), F.concat(t, F.repeat(F.lit(INNER_END), F.greatest(missing, F.lit(0)))), inward), INNER + INNER_END, "")

    return F.when(F.contains(text, F.lit(INNER)), let(text, closed)).otherwise(text)


def table_grid(text: Column) -> Column:
    """Marked table text → array of rows of (text, align) cells; rows without cells vanish."""
    rows = F.transform(_tail(F.split(text, ROW)), lambda r: F.transform(
        _tail(F.split(r, CELL)),
        lambda c: F.struct(_cell_text(c).alias("text"), F.substring_index(c, ALIGN, 1).alias("align"))))
    return F.filter(rows, lambda r: F.size(r) > 0)


def table_markdown(grid: Column) -> Column:
    """Pipe table: short rows padded, first row is the header, first declared alignment of a column wins."""
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    cols = F.sequence(F.lit(0), width - 1)

    def line(row: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(
            cols, lambda i: F.coalesce(F.get(row, i)["text"], F.lit(""))), " | "), F.lit(" |"))

    def dash(i: Column) -> Column:
        align = F.get(F.filter(F.transform(grid, lambda r: F.get(r, i)["align"]),
                               lambda a: a.isin("left", "center", "right")), F.lit(0))
        return F.when(align == "center", ":---:").when(align == "right", "---:").when(align == "left", ":---").otherwise("---")

    lines = F.concat(F.array(line(F.get(grid, F.lit(0)))),
                     F.array(F.concat(F.lit("| "), F.array_join(F.transform(cols, dash), " | "), F.lit(" |"))),
                     F.transform(_tail(grid), line))
    return F.when(F.size(grid) > 0, F.array_join(lines, "\n")).otherwise("")


def html_blocks(df: DataFrame, id: str, html: str) -> DataFrame:
    """Ordered blocks: ``doc_id, block_id, type, level, container, text, path``.

    ``path`` lists the open lists, items and quotes from the outermost inwards, each with the block that opened it and,
    for items, its marker. It is found with one window per (document, nesting level): a block asks every level it is
    inside of for the last container opened there, so the work is linear in the size of the prefixes that get printed.
    """
    tokens = nested_tokens(df, id, html).withColumn("piece", _token_text())
    first = {c: F.min_by(c, "pos").alias(f"_{c}") for c in ("tag", "kind", "raw", "level")}
    blocks = tokens.groupBy("doc_id", "block_id").agg(
        *first.values(), F.max("tables").alias("_tables"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda s: s["piece"]), "").alias("_text"))
    opens = F.col("_kind") == "open"
    tag = F.when(opens | (F.col("_kind") == "void"), F.col("_tag")).otherwise("")
    kind = (F.when(F.rlike(tag, F.lit("^h[1-6]$")), "heading").when(tag == "hr", "rule").when(tag == "pre", "code")
            .when(tag == "table", "table").when(tag == "summary", "summary").otherwise("paragraph"))
    text = (F.when(F.col("type") == "code", F.regexp_replace("_text", r"\s+$", ""))
            .when(F.col("type") == "table", let(table_grid(with_inner_tables(F.col("_text"), F.greatest(F.col("_tables"), F.lit(1)))), table_markdown))
            .otherwise(collapse_blanks(trim_ws(F.col("_text")))))
    blocks = (
        blocks.withColumn("_text", resolve_inline(F.col("_text"))).withColumn("type", kind)
        .withColumn("container", F.when(opens & F.col("_tag").isin(CONTAINER_TAGS), F.col("_tag")))
        .withColumn("level", F.when(F.col("type") == "heading", F.substring("_tag", 2, 1).cast("int")))
        .withColumn("text", text)
        .withColumn("start", F.when(F.col("container") == "ol", F.expr("coalesce(try_cast(nullif(trim(regexp_extract(_raw, '(?i)start\\\\s*=\\\\s*[\"'']?([0-9]+)', 1)), '') as bigint), 1)")))
        .withColumn("live", (F.trim("text") != "") | (F.coalesce(F.col("container"), F.lit("")) == "li"))
    )
    # an item is numbered inside the last list opened one level above it: both share rank
    what = F.col("container")
    rank = F.when(what == "li", F.col("_level") - 1).when(what.isin(LIST_TAGS), F.col("_level"))
    by_rank = W.partitionBy("doc_id", "rank").orderBy("block_id")
    seen = F.sum((what == "li").cast("int")).over(by_rank)
    blocks = blocks.withColumn("rank", rank).withColumn("seen", seen).withColumn("list", F.last(F.when(
        what.isin(LIST_TAGS), F.struct("container", "start", "seen", "block_id")), ignorenulls=True).over(by_rank))
    item_no = F.col("seen") - F.coalesce("list.seen", F.lit(0))
    marker = F.when(what == "li", F.when(F.col("list.container") == "ol", F.concat(
        (F.col("list.start") + item_no - 1).cast("string"), F.lit(". "))).otherwise("- "))
    # every block asks the levels it is inside of; containers that hold no text themselves only answer
    levels = F.when(F.col("live"), F.when(F.col("_level") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("_level")))).otherwise(
        F.when(what.isNotNull(), F.array(F.col("_level"))))
    answer = F.when(what.isNotNull(), F.struct(
        F.col("_level").alias("k"), F.col("block_id").alias("opened"),
        F.when(what.isin(QUOTE_TAGS), "quote").when(what == "li", "item").otherwise("list").alias("what"),
        marker.alias("marker")))
    asked = blocks.withColumns({"answer": answer, "list_id": F.col("list.block_id"), "item_no": item_no, "levels": levels})
    asked = asked.select("doc_id", "block_id", "type", "level", "container", "text", "live", "list_id", "item_no", "answer",
                         F.explode_outer("levels").alias("k"))
    by_level = W.partitionBy("doc_id", "k").orderBy("block_id")
    asked = asked.withColumn("above", F.last(F.when(F.col("answer.k") == F.col("k"), F.col("answer")),
                                             ignorenulls=True).over(by_level))
    live = asked.filter("live").groupBy("doc_id", "block_id").agg(
        *[F.first(c).alias(c) for c in ("type", "level", "container", "text", "list_id", "item_no")],
        F.sort_array(F.collect_list("above")).alias("path"))
    by_block = W.partitionBy("doc_id").orderBy("block_id")
    next_path = F.lead("path").over(by_block)
    goes_on = F.coalesce(F.exists(next_path, lambda p: p["opened"] == F.col("block_id")), F.lit(False))
    return live.withColumn("_skip", (F.trim("text") == "") & goes_on).filter("not _skip").drop("_skip")


def _prefix(path: Column, seen: Column) -> Column:
    return F.array_join(F.transform(path, lambda p: F.when(p["what"] == "quote", "> ").when(p["what"] == "list", "").otherwise(
        F.when(F.exists(seen, lambda s: s["opened"] == p["opened"]), "    ").otherwise(p["marker"]))), "")


def _blank_prefix(path: Column) -> Column:
    """What a blank line shows: everything up to the innermost quote."""
    depth = F.array_max(F.transform(path, lambda p, i: F.when(p["what"] == "quote", i + 1).otherwise(0)))
    return _prefix(F.slice(path, 1, F.coalesce(depth, F.lit(0))), path)


def render_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks in order → one Markdown text per document."""
    by_block = W.partitionBy("doc_id").orderBy("block_id")
    blocks = blocks.withColumn("before", F.lag("path").over(by_block))
    path, before = F.col("path"), F.col("before")
    none = F.filter(path, lambda p: F.lit(False))
    seen = F.coalesce(before, none)
    common = F.filter(path, lambda p: F.exists(seen, lambda s: s["opened"] == p["opened"]))
    same_list = F.get(common, F.size(common) - 1)["what"] == "list"
    sep = (F.when(before.isNull(), "")
           .when(F.coalesce(same_list & (F.get(path, F.size(common))["what"] == "item"), F.lit(False)), "\n")
           .otherwise(F.concat(F.lit("\n"), _blank_prefix(common), F.lit("\n"))))
    body = (F.when(F.col("type") == "heading", F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.col("text")))
            .when(F.col("type") == "summary", F.concat(F.lit("▼ "), F.col("text")))
            .when(F.col("type") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
            .otherwise(F.col("text")))
    first, rest, blank = _prefix(path, seen), _prefix(path, path), _blank_prefix(path)
    lines = F.transform(F.split("body", "\n"), lambda line, i: F.concat(
        F.when(i == 0, F.col("first")).when(line == "", F.col("blank")).otherwise(F.col("rest")), line))
    pieces = blocks.withColumn("body", body).withColumn("sep", sep).withColumn("first", first).withColumn(
        "rest", rest).withColumn("blank", blank).select("doc_id", "block_id", F.concat(
            "sep", F.when(F.size("path") == 0, F.col("body")).otherwise(F.array_join(lines, "\n"))).alias("piece"))
    return pieces.groupBy("doc_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("block_id", "piece"))), lambda s: s["piece"]), "").alias("markdown"))


def keep_rows(texts: DataFrame, df: DataFrame, id: str, text: str) -> DataFrame:
    """``texts`` with an empty one for every row of ``df`` that gave none. Ids name rows, so both sides are small and even."""
    return df.select(F.col(id).alias("doc_id")).distinct().join(texts, "doc_id", "left").withColumn(text, F.coalesce(text, F.lit("")))


def html_to_markdown(df: DataFrame, id: str, html: str) -> DataFrame:
    """Whole pages → Markdown. Pages without any content give an empty text."""
    return keep_rows(render_blocks(html_blocks(df, id, html)), df, id, "markdown")


def html_lists(df: DataFrame, id: str, html: str) -> DataFrame:
    """``doc_id, item_no, depth, marker, text`` of every list item in page order."""
    blocks = html_blocks(df, id, html)
    at = F.expr("try_element_at(filter(path, p -> p.what = 'item'), -1)")
    items = blocks.withColumn("item", at).filter(F.col("item").isNotNull())
    by_item = W.partitionBy("doc_id", "item.opened").orderBy("block_id")
    by_doc = W.partitionBy("doc_id").orderBy("block_id")
    return items.withColumn("n", F.row_number().over(by_item)).filter("n = 1").select(
        "doc_id", (F.row_number().over(by_doc) - 1).alias("item_no"),
        F.size(F.filter("path", lambda p: p["what"] == "item")).alias("depth"),
        F.col("item.marker").alias("marker"), "text")


def html_tables(df: DataFrame, id: str, html: str) -> DataFrame:
    """``doc_id, table_no, markdown`` of every table in page order."""
    blocks = html_blocks(df, id, html).filter("type = 'table'")
    by_doc = W.partitionBy("doc_id").orderBy("block_id")
    return blocks.select("doc_id", (F.row_number().over(by_doc) - 1).alias("table_no"), F.col("text").alias("markdown"))


def html_quotes(df: DataFrame, id: str, html: str) -> DataFrame:
    """Markdown of the quoted parts of each document."""
    quoted = html_blocks(df, id, html).filter(F.exists("path", lambda p: p["what"] == "quote"))
    return render_blocks(quoted)


def html_code(df: DataFrame, id: str, html: str) -> DataFrame:
    """``doc_id, code_no, markdown`` of every ``<pre>`` as a fenced block."""
    blocks = html_blocks(df, id, html).filter("type = 'code'")
    by_doc = W.partitionBy("doc_id").orderBy("block_id")
    return blocks.select("doc_id", (F.row_number().over(by_doc) - 1).alias("code_no"),
                         F.concat(F.lit("```\n"), "text", F.lit("\n```")).alias("markdown"))
