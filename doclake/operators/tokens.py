"""Markup → ordered token rows. One job serves HTML pages and the XML parts of office packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.text import NAMED_ENTITIES, XML_ENTITIES, decode_entities

# One token is a tag (quote-aware), a text run, or a stray "<". Possessive, so it cannot backtrack.
TAG_BODY = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
TOKEN = rf"<{TAG_BODY}>|[^<]++|<"
TAG_NAME = r"^</?([A-Za-z_][A-Za-z0-9:._-]*)"
ATTRIBUTE = r"""([^\s=/>"'<]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


# What is not closed goes on to the end of the page.
OPAQUE = (r"(?s)<!--(?:[^-]++|-(?!->))*+(?:-->|\z)"
          + "".join(rf"|<(?i:{t})\b[^>]*+(?:>(?:[^<]++|<(?!/(?i:{t})[\s>]))*+(?:</(?i:{t})\s*+>?|\z)|\z)" for t in ("script", "style", "title"))
          + r"|<[!?][^>]*+(?:>|\z)")


def strip_opaque(html: Column) -> Column:
    """Remove comments, declarations, and elements whose bodies are not document text, in one pass."""
    return F.regexp_replace(html, OPAQUE, "")


def token_array(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(TOKEN), F.lit(0))


def tag_of(raw: Column, xml: bool = False) -> Column:
    """Tag name of a token, empty for text."""
    name = F.when(F.startswith(raw, F.lit("<")) & (F.length(raw) > 1),
                  F.regexp_extract(raw, TAG_NAME, 1)).otherwise("")
    return name if xml else F.lower(name)


def is_closing(raw: Column) -> Column:
    return F.startswith(raw, F.lit("</"))


def attr(raw: Column, name: str, xml: bool = False, decode: bool = True) -> Column:
    """Value of the first attribute called ``name``; null when it is absent.

    One pattern walks over the attributes before it, so text inside another attribute's value never matches.
    """
    value = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
    others = rf"""(?:[\s/]+(?!{name}[\s=])[^\s=/>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*+"""
    pattern = ("" if xml else "(?i)") + rf"^<[^\s/>]+{others}[\s/]+{name}\s*=\s*{value}"
    bare = F.regexp_replace(F.nullif(F.regexp_extract(raw, pattern, 1), F.lit("")), r"""^["']|["']$""", "")
    return decode_entities(bare, XML_ENTITIES if xml else NAMED_ENTITIES) if decode else bare


def attr_map(raw: Column, xml: bool = False) -> Column:
    names = F.regexp_extract_all(raw, F.lit(ATTRIBUTE), F.lit(1))
    if not xml:
        names = F.transform(names, F.lower)
    values = F.transform(F.regexp_extract_all(raw, F.lit(ATTRIBUTE), F.lit(2)),
                         lambda v: decode_entities(F.regexp_replace(v, r"""^["']|["']$""", ""),
                                                   XML_ENTITIES if xml else NAMED_ENTITIES))
    keys = F.array_distinct(names)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(values, F.array_position(names, k).cast("int") - 1)))


def explode_tokens(df: DataFrame, markup: str, *keep: str, xml: bool = False) -> DataFrame:
    """``keep`` columns plus ``pos, raw, tag, kind``; a projection-and-generate job without any exchange."""
    source = F.col(markup) if xml else strip_opaque(F.col(markup))
    tokens = df.select(*keep, F.posexplode(token_array(source)).alias("pos", "raw"))
    if xml:
        tokens = tokens.filter(~F.startswith("raw", F.lit("<?")) & ~F.startswith("raw", F.lit("<!")))
    tag = tag_of(F.col("raw"), xml)
    void = F.endswith(F.col("raw"), F.lit("/>"))
    if not xml:
        void = void | F.col("tag").isin(VOID_TAGS)
    return tokens.withColumn("tag", tag).withColumn(
        "kind", F.when(F.col("tag") == "", "text").when(is_closing(F.col("raw")), "close")
        .when(void, "void").otherwise("open"))


def html_tokens(df: DataFrame, id: str, html: str) -> DataFrame:
    """``doc_id, pos, kind, tag, attrs, text`` with entities decoded after tokenising."""
    raw = F.col("raw")
    pages = df.select(F.col(id).alias("doc_id"), F.col(html).alias("_markup"))
    return explode_tokens(pages, "_markup", "doc_id").select(
        "doc_id", "pos", "kind", "tag", "raw",
        F.when(F.col("kind").isin("open", "void"), attr_map(raw)).alias("attrs"),
        F.when(F.col("kind") == "text", decode_entities(raw)).alias("text"))
