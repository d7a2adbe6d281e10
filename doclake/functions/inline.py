"""Inline markup of one block → Markdown, as a column expression over the block's own text.

Every inline tag first becomes a marker character, the block's tokens are concatenated, and matched marker pairs are
rewritten innermost first. Markers are Unicode non-characters, which texts do not contain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.text import decode_entities, let, trim_ws
from doclake.operators.tokens import attr, is_closing, tag_of, token_array

# Fixed values: (tags, Markdown before, Markdown after, content is trimmed).
INLINE_RULES = [
    (("b", "strong"), "**", "**", True),
    (("i", "em", "var"), "*", "*", True),
    (("del", "s", "strike"), "~~", "~~", True),
    (("mark",), "==", "==", True),
    (("sup",), "^", "^", True),
    (("kbd",), "`[", "]`", True),
    (("q",), '"', '"', False),
    (("code",), "`", "`", False),
]
OPENERS = [chr(0xFDD0 + i) for i in range(len(INLINE_RULES))]
CLOSERS = [chr(0xFDE0 + i) for i in range(len(INLINE_RULES))]
LINK_OPEN, LINK_HREF, LINK_BARE, LINK_CLOSE = (chr(0xFDE8 + i) for i in range(4))


def image_markdown(raw: Column) -> Column:
    """``![alt](src#WxH)``; sizes are the leading digits, letters and percent signs of the attributes."""
    return decode_entities(_image(raw))


def _image(raw: Column) -> Column:
    width, height = (F.regexp_extract(attr(raw, side, decode=False), r"^[0-9A-Za-z%]*", 0) for side in ("width", "height"))
    size = let(F.struct(width.alias("w"), height.alias("h")), lambda d: F.coalesce(
        F.concat(F.lit("#"), d["w"], F.lit("x"), F.coalesce(d["h"], F.lit(""))),
        F.concat(F.lit("#x"), d["h"]), F.lit("")))
    return F.concat(F.lit("!["), F.coalesce(attr(raw, "alt", decode=False), F.lit("IMG")), F.lit("]("),
                    F.coalesce(attr(raw, "src", decode=False), F.lit("")), size, F.lit(")"))


def inline_token(raw: Column, tag: Column | None = None) -> Column:
    """One token as text with markers; block tags and unknown tags vanish."""
    tag = tag_of(raw) if tag is None else tag
    out = F.when(tag == "", raw)
    for (tags, _, _, _), opener, closer in zip(INLINE_RULES, OPENERS, CLOSERS):
        out = out.when(tag.isin(*tags), F.when(is_closing(raw), closer).otherwise(opener))
    href = F.concat(F.lit(LINK_OPEN), F.trim(attr(raw, "href", decode=False)), F.lit(LINK_HREF))
    out = out.when(tag == "a", F.when(is_closing(raw), LINK_CLOSE).otherwise(F.coalesce(href, F.lit(LINK_BARE))))
    out = out.when((tag == "img") & ~is_closing(raw), _image(raw)).when(tag == "br", "\n").otherwise("")
    return decode_entities(out)


def _links(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(LINK_CLOSE)) | F.contains(text, F.lit(LINK_OPEN))
                  | F.contains(text, F.lit(LINK_BARE)), _resolve_links(text)).otherwise(text)


def _resolve_links(text: Column) -> Column:
    body = f"([^{LINK_OPEN}-{LINK_CLOSE}]*)"
    edge = r"\s*"
    # content that spans lines loses its link; content without href never had one
    text = F.regexp_replace(text, f"{LINK_OPEN}([^{LINK_HREF}]*){LINK_HREF}{edge}"
                                  f"([^\n{LINK_OPEN}-{LINK_CLOSE}]*?){edge}{LINK_CLOSE}", "[$2]($1)")
    text = F.regexp_replace(text, f"{LINK_OPEN}[^{LINK_HREF}]*{LINK_HREF}{edge}{body}", "$1")
    text = F.regexp_replace(text, f"{LINK_BARE}{edge}{body}", "$1")
    return F.regexp_replace(text, f"{edge}{LINK_CLOSE}", "")


def resolve_inline(text: Column) -> Column:
    """Rewrite marker pairs; a marker that never finds its partner inside the block is dropped."""
    rules = []
    for (_, before, after, trimmed), o, c in zip(INLINE_RULES, OPENERS, CLOSERS):
        edge = r"\s*" if trimmed else ""
        rules.append(F.struct(F.lit(o).alias("o"), F.lit(c).alias("c"),
                              F.lit(f"{o}{edge}([^{o}{c}]*?){edge}{c}").alias("pair"),
                              F.lit(f"{before}$1{after}").alias("out")))

    def apply(acc: Column, rule: Column) -> Column:
        def again(t: Column, _i: Column) -> Column:
            return F.regexp_replace(t, rule["pair"], rule["out"])

        def nested(t: Column) -> Column:
            # openers still there enclose a pair of their own kind, or have no partner at all
            left = F.length(t) - F.length(F.replace(t, rule["o"], F.lit("")))
            return F.when(left > 0, F.aggregate(F.sequence(F.lit(1), left), t, again)).otherwise(t)

        both = F.contains(acc, rule["o"]) & F.contains(acc, rule["c"])
        return F.when(both, let(again(acc, acc), nested)).otherwise(acc)

    unmatched = "".join(OPENERS + CLOSERS)
    marked = F.rlike(text, F.lit(f"[{OPENERS[0]}-{LINK_CLOSE}]"))
    return F.when(marked, let(F.translate(F.aggregate(F.array(*rules), text, apply), unmatched, ""), _links)).otherwise(text)


def inline_markdown(fragment: Column) -> Column:
    """Markdown of an HTML fragment that has no block structure, trimmed."""
    joined = F.array_join(F.transform(token_array(fragment), lambda t: let(
        F.struct(t.alias("raw"), tag_of(t).alias("tag")), lambda s: inline_token(s["raw"], s["tag"]))), "")
    plain = ~F.contains(fragment, F.lit("<"))
    return trim_ws(F.when(plain, decode_entities(fragment)).otherwise(let(joined, resolve_inline)))
