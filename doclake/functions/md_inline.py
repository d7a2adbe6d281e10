"""Inline Markdown of one block → HTML, as column expressions.

What is literal (code, addresses, images) is first taken out and stands as a numbered mark, so that emphasis sees through it and
never changes it; links then stand as marks around their words. References are left as marks with their label, which
``resolve_references`` turns into links where the document, once it is whole, defines the label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.text import let

# Marks are Unicode non-characters, which texts do not contain: a number, a reference's parts.
ATOM, ATOM_END, LINK, LINK_END, REF, REF_PART, REF_END = MARKS = [chr(0xFDD0 + i) for i in range(7)]

CODE = r"`[^`]+`"
ANGLE = r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_{|}~-]+@[A-Za-z0-9.-]+)>"
TARGET = r"""\([ \t]*<?([^()\s<>]*)>?(?:[ \t]+(?:"([^"]*)"|'([^']*)'))?[ \t]*\)"""
IMAGE, IMAGE_REF, IMAGE_SHORT = r"!\[([^\[\]]*)\]" + TARGET, r"!\[([^\[\]]*)\]\[([^\[\]]*)\]", r"!\[([^\[\]]+)\]"
ATOMS = f"{CODE}|{ANGLE}|{IMAGE}|{IMAGE_REF}|{IMAGE_SHORT}|[^`<!]+|[\\s\\S]"
WORDS = r"\[([^\[\]]*)\]"
LINKS = f"{WORDS}{TARGET}|{WORDS}\\[([^\\[\\]]*)\\]|\\[(?!\\^)([^\\[\\]]+)\\]|[^\\[]+|\\["
# What emphasis becomes, in the order in which it is looked for.
EMPHASIS = [(r"\*\*([^*]+(?:\*[^*]+\*[^*]*)?)\*\*", "strong"), (r"__([^_]+)__", "strong"), (r"(?<![\w/])_([^_\s][^_]*)_(?!\w)", "em"), (r"\*([^*\s][^*]*)\*", "em"),
            (r"~~([^~]+)~~", "del"), (r"==([^=]+)==", "mark")]


def escape_html(t: Column) -> Column:
    for char, name in [("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")]:
        t = F.replace(t, F.lit(char), F.lit(f"&{name};"))
    return t


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _part(s: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(s, f"^(?:{pattern})$", group)


def _is(s: Column, pattern: str) -> Column:
    return F.rlike(s, F.lit(f"^(?:{pattern})$"))


def _title(s: Column, pattern: str, first: int) -> Column:
    title = F.concat(_part(s, pattern, first), _part(s, pattern, first + 1))
    return F.when(title == "", "").otherwise(_text(' title="', title, '"'))


def _label(s: Column) -> Column:
    """A label as it is compared, in digits that nothing else changes."""
    return F.hex(F.lower(F.upper(F.trim(F.regexp_replace(s, r"\s+", " ")))))


def _atom(s: Column) -> Column:
    """HTML of a literal part; null for text."""
    inner = F.substring(s, F.lit(2), F.length(s) - 2)
    address = F.when(F.contains(inner, F.lit(":")), inner).otherwise(_text("mailto:", inner))

    def image_ref(words: Column, label: Column, tail: Column) -> Column:
        return _text(REF, "i", _label(label), REF_PART, escape_html(words), REF_PART, escape_html(tail), REF_END)

    second = _part(s, IMAGE_REF, 2)
    return (F.when(_is(s, CODE), _text("<code>", escape_html(inner), "</code>")).when(_is(s, ANGLE), _text('<a href="', escape_html(address), '">', escape_html(inner), "</a>"))
            .when(_is(s, IMAGE), _text('<img src="', escape_html(_part(s, IMAGE, 2)), '" alt="', escape_html(_part(s, IMAGE, 1)), '"', _title(escape_html(s), IMAGE.replace('"', "&quot;"), 3), " />"))
            .when(_is(s, IMAGE_REF), image_ref(_part(s, IMAGE_REF, 1), F.when(second == "", _part(s, IMAGE_REF, 1)).otherwise(second), _text("][", second, "]")))
            .when(_is(s, IMAGE_SHORT), image_ref(_part(s, IMAGE_SHORT, 1), _part(s, IMAGE_SHORT, 1), F.lit("]"))))


def _link(s: Column) -> Column:
    """HTML of a link or a reference in text without atoms; null for text."""
    inline, full, short = f"{WORDS}{TARGET}", f"{WORDS}\\[([^\\[\\]]*)\\]", r"\[(?!\^)([^\[\]]+)\]"
    second = _part(s, full, 2)
    kind = F.when(_is(s, inline), 0).when(_is(s, full), 1).when(_is(s, short), 2)
    parts = F.struct(kind.alias("kind"), _part(s, WORDS + r"[\s\S]*", 1).alias("words"), second.alias("second"))

    def html(x: Column) -> Column:
        inside = x["kind"] == 0
        before = F.when(inside, _text('<a href="', escape_html(_part(s, inline, 2)), '"', _title(s, inline, 3), ">")).otherwise(
            _text(REF, "a", _label(F.when(x["second"] == "", x["words"]).otherwise(x["second"])), REF_PART))
        after = F.when(inside, "</a>").otherwise(_text(REF_PART, F.when(x["kind"] == 1, _text("][", escape_html(x["second"]), "]")).otherwise("]"), REF_END))
        return F.when(x["kind"].isNotNull(), F.concat(before, _emphasis(x["words"]), after))

    return let(parts, html)


def _around(text: Column, pattern: str, part, mark: str, end: str, rest) -> Column:
    """``rest`` of a text in which every span that ``part`` knows is a mark, with those parts put back."""
    spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def put(r: Column) -> Column:
        marked = F.array_join(F.transform(r["parts"], lambda p, i: F.when(p.isNull(), F.get(r["spans"], i)).otherwise(_text(mark, i.cast("string"), end))), "")
        pieces = F.regexp_extract_all(rest(marked), F.lit(f"{mark}[0-9]+{end}|[^{mark}]+"), F.lit(0))
        return F.array_join(F.transform(pieces, lambda p: F.when(
            F.startswith(p, F.lit(mark)), F.get(r["parts"], F.regexp_extract(p, "([0-9]+)", 1).cast("int"))).otherwise(p)), "")

    return let(let(spans, lambda s: F.struct(s.alias("spans"), F.transform(s, part).alias("parts"))), put)


def _emphasis(text: Column) -> Column:
    out = escape_html(text)
    for pattern, tag in EMPHASIS:
        out = F.regexp_replace(out, pattern, f"<{tag}>$1</{tag}>")
    return out


def inline_html(text: Column) -> Column:
    """HTML of a block's text, with marks for references."""
    def links(t: Column) -> Column:
        return _around(t, LINKS, _link, LINK, LINK_END, _emphasis)

    return _around(F.translate(text, "".join(MARKS), ""), ATOMS, _atom, ATOM, ATOM_END, links)


def resolve_references(html: Column, entries: Column) -> Column:
    """A document's HTML with its references as links and images, by ``entries`` (label, block_no, url, title) in their order.

    Of equal labels the first counts; a reference without a definition is text again.
    """
    def table(e: Column) -> Column:
        first = F.filter(e, lambda x, i: (i == 0) | (F.get(e, i - 1)["label"] != x["label"]))
        return F.map_from_entries(F.transform(first, lambda x: F.struct(F.hex(x["label"]), F.struct(x["url"].alias("url"), x["title"].alias("title")))))

    body = f"[^{REF}{REF_PART}{REF_END}]*"

    def of_kind(t: Column, known: Column, kind: str, pattern_words: str, found) -> Column:
        pattern = f"{REF}{kind}([0-9A-F]*){REF_PART}({pattern_words}){REF_PART}({body}){REF_END}"
        pieces = F.regexp_extract_all(t, F.lit(f"{pattern}|[^{REF}]+|{REF}"), F.lit(0))

        def one(p: Column) -> Column:
            label, words, tail = (F.regexp_extract(p, pattern, i) for i in (1, 2, 3))
            to = F.try_element_at(known, label)
            return F.when(F.rlike(p, F.lit(f"^{pattern}$")), let(to, lambda d: F.when(d.isNull(), _text("![" if kind == "i" else "[", words, tail)).otherwise(found(d, words)))).otherwise(p)

        return F.array_join(F.transform(pieces, one), "")

    def title(d: Column) -> Column:
        return F.when(d["title"].isNull(), "").otherwise(_text(' title="', escape_html(d["title"]), '"'))

    def resolved(known: Column) -> Column:
        images = of_kind(html, known, "i", body, lambda d, w: _text('<img src="', escape_html(d["url"]), '" alt="', w, '"', title(d), " />"))
        return of_kind(images, known, "a", body, lambda d, w: _text('<a href="', escape_html(d["url"]), '"', title(d), ">", w, "</a>"))

    return F.when(F.contains(html, F.lit(REF)), let(let(entries, table), resolved)).otherwise(html)
