"""Column functions over text: entities, blank runs, escaping, terminal escapes, UTF-8."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five references of XML.
XML_ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")]
# HTML names: those of the standard library that end in a semicolon; a hard space is shown as a plain one.
NAMED_ENTITIES = [(name[:-1], " " if char == "\u00a0" else char) for name, char in sorted(html5.items()) if name.endswith(";")]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def record(**fields: Column) -> Column:
    """Struct whose field names survive inside generators and lambdas."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def _numeric(ref: Column) -> Column:
    """Character of ``#65`` or ``#x41``; zero, surrogates and what lies beyond Unicode are the replacement character."""
    hexa = F.rlike(ref, F.lit("^#[xX]"))
    digits = F.regexp_replace(ref, "^#[xX]?0*", "")
    code = F.when((F.length(digits) > 7) | (digits == ""), F.lit(-1)).otherwise(F.when(hexa, F.conv(digits, 16, 10)).otherwise(digits).cast("int"))
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(F.coalesce(valid, F.lit(False)), F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")).otherwise("\ufffd")


def decode_entities(text: Column, named=NAMED_ENTITIES) -> Column:
    """Numeric and named character references to characters, each once, in one pass; unknown names stay as they are."""
    pattern = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
    common = {"amp", "lt", "gt", "quot", "apos", "nbsp"}
    table = F.from_json(F.lit(json.dumps(dict(named))), "map<string,string>")

    def char(hit: Column) -> Column:
        name = F.substring(hit, F.lit(2), F.length(hit) - 2)
        known = F.when(F.startswith(name, F.lit("#")), _numeric(name))
        for n, c in named:
            if n in common:
                known = known.when(name == n, c)
        return F.coalesce(known.otherwise(F.try_element_at(table, name)) if len(named) > len(XML_ENTITIES) else known, hit)

    def decoded(t: Column) -> Column:
        # bound once: an expression that a lambda repeats is evaluated for every element
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return let(hits, lambda h: F.array_join(F.transform(
            F.split(t, pattern, -1), lambda gap, i: F.concat(gap, F.coalesce(let(F.get(h, i), char), F.lit("")))), ""))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def collapse_blanks(text: Column) -> Column:
    """Runs of three or more line ends, blanks between them included, become exactly one blank line."""
    return F.regexp_replace(text, r"[ \t]*+(?:\n[ \t]*+){3,}", "\n\n")


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# The tags the HTML rewriter knows.
KNOWN_TAGS = [
    "div", "p", "details", "summary", "q", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "sup", "mark", "kbd", "var",
    "i", "b", "strong", "em", "del", "s", "strike", "a", "img", "picture", "source", "pre", "code", "blockquote",
    "ul", "ol", "li", "figure", "figcaption", "table", "td", "th", "tr", "thead", "tbody", "tfoot",
]


def escape_unknown(text: Column) -> Column:
    """Escape every ``<`` and ``>`` except those of known tags; code spans and fences are always escaped."""
    spans = F.regexp_extract_all(text, F.lit(r"```[\s\S]*?```|`[^`\n]+`|[^`]+|`"), F.lit(0))
    pieces = F.lit("(?s)</?(?:" + "|".join(KNOWN_TAGS) + r")\b[^>]*>|<|>|[^<>]+")

    def escape(t: Column) -> Column:
        return F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def plain(t: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(t, pieces, F.lit(0)),
                                        lambda p: F.when(F.length(p) == 1, escape(p)).otherwise(p)), "")

    return F.array_join(F.transform(
        spans, lambda s: F.when(F.startswith(s, F.lit("`")) & (F.length(s) > 1), escape(s)).otherwise(plain(s))), "")


# CSI sequences, OSC strings (ended by BEL or ST), and two-byte escapes.
ANSI_PATTERN = r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[@-Z\\-_]"


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI_PATTERN, "")


def visible_length(text: Column) -> Column:
    return F.length(strip_ansi(text))


def utf8_valid(content: Column) -> Column:
    """Byte-order-mark aware validity: UTF-8 strictly; a UTF-16 mark makes the text UTF-16."""
    utf16 = F.startswith(content, F.unhex(F.lit("FFFE"))) | F.startswith(content, F.unhex(F.lit("FEFF")))
    return F.when(utf16, F.octet_length(content) % 2 == 0).otherwise(F.is_valid_utf8(content.cast("string")))


def decode_text(content: Column) -> Column:
    """Text of the bytes, mark removed; null where the bytes are not valid text."""
    text = F.when(F.startswith(content, F.unhex(F.lit("FFFE"))) | F.startswith(content, F.unhex(F.lit("FEFF"))),
                  F.decode(content, "UTF-16"))
    text = text.when(F.startswith(content, F.unhex(F.lit("EFBBBF"))),
                     F.try_validate_utf8(F.substring(content, 4, 2147483647).cast("string")))
    return text.otherwise(F.try_validate_utf8(content.cast("string")))
