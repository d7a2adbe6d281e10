"""Markdown → structure rows, and Markdown → HTML.

A document is cut into units by one pattern: front matter, whole fenced blocks, whole directives, or single lines. Fences
are matched by the pattern itself, so nothing downstream tracks fence state. Extractors that look at one unit are
projections; only operators that need neighbouring units distribute the documents, once, and use per-document windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclake.functions.md_inline import escape_html, inline_html, resolve_references
from doclake.functions.text import let, trim_ws
from doclake.functions.urls import parse_image_ref
from doclake.rules import rule_table
from doclake.session import cluster_by

# The unit grammar.
FRONT_MATTER = r"\A---[ \t]*\n(?:[\s\S]*?\n)??---[ \t]*(?:\n|\z)"
FENCE = r"^[ \t]*(?:(`{3,})[^`\n]*|(~{3,})[^\n]*)(?:\n[\s\S]*?)??(?:\n[ \t]*(?:\1`*|\2~*)[ \t]*(?:\n|\z)|\z)"
# A directive that is not closed goes on to the end, like a fence.
DIRECTIVE = r"^:::+[ \t]*[^:\s][^\n]*\n(?:[\s\S]*?\n)??(?::::+[ \t]*(?:\n|\z)|\z)"
SETEXT = r"^ {0,3}(?![ \t#>|*+-]|\d+[.)])(?=[ \t]*+\S)[^\n]*+\n {0,3}(?:=++|-{2,}+)[ \t]*+(?:\n|\z)"
UNIT = f"(?m){FRONT_MATTER}|{FENCE}|{DIRECTIVE}|{SETEXT}|[^\\n]+\\n?|\\n"
LIST_MARKER = r"^([ \t]*)([-*+]|[0-9]{1,9}[.)])(?:[ \t]+|$)"
DELIMITER_ROW_LINE = r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\n?$"
CODE_SPAN = r"`+[^`]*`+"
#: ``[label]: address "title"`` on one line; groups: label, address, title. It cannot interrupt a paragraph.
DEFINITION = r"""^ {0,3}\[(?!\^)(?=[^\[\]\n]*[^\s\[\]])([^\[\]\n]+)\]:[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:[ \t]+("[^"\n]*"|'[^'\n]*'|\([^()\n]*\)))?[ \t]*\n?$"""

# Alert names as shown.
ALERTS = [("note", "NOTE"), ("tip", "TIP"), ("important", "INFO"), ("warning", "WARNING"), ("caution", "DANGER")]

# Fence languages and the syntax they select, and what a first line selects.
SYNTAX_TOKENS = [
    ("bash", "Shell"), ("c", "C"), ("cpp", "C++"), ("css", "CSS"), ("go", "Go"), ("html", "HTML"), ("java", "Java"),
    ("javascript", "JavaScript"), ("js", "JavaScript"), ("json", "JSON"), ("lua", "Lua"), ("md", "Markdown"),
    ("php", "PHP"), ("py", "Python"), ("python", "Python"), ("r", "R"), ("rb", "Ruby"), ("rs", "Rust"),
    ("ruby", "Ruby"), ("rust", "Rust"), ("scala", "Scala"), ("sh", "Shell"), ("sql", "SQL"), ("tex", "LaTeX"),
    ("xml", "XML"), ("yaml", "YAML"), ("yml", "YAML"), ("ts", "TypeScript"), ("typescript", "TypeScript"), ("tsx", "TypeScriptReact"),
    ("jsx", "JavaScript (JSX)"), ("toml", "TOML"), ("kt", "Kotlin"), ("kotlin", "Kotlin"), ("swift", "Swift"), ("cs", "C#"), ("csharp", "C#"),
    ("c++", "C++"), ("cc", "C++"), ("h", "C"), ("hpp", "C++"), ("diff", "Diff"), ("patch", "Diff"), ("dockerfile", "Dockerfile"),
    ("docker", "Dockerfile"), ("makefile", "Makefile"), ("make", "Makefile"), ("mk", "Makefile"), ("pl", "Perl"), ("perl", "Perl"),
    ("hs", "Haskell"), ("haskell", "Haskell"), ("clj", "Clojure"), ("clojure", "Clojure"), ("erl", "Erlang"), ("erlang", "Erlang"),
    ("ex", "Elixir"), ("exs", "Elixir"), ("elixir", "Elixir"), ("dart", "Dart"), ("groovy", "Groovy"), ("ini", "INI"), ("scss", "SCSS"),
    ("sass", "Sass"), ("less", "Less"), ("markdown", "Markdown"), ("latex", "LaTeX"), ("matlab", "MATLAB"), ("ml", "OCaml"), ("ocaml", "OCaml"),
    ("ps1", "PowerShell"), ("powershell", "PowerShell"), ("zsh", "Shell"), ("shell", "Shell"), ("fish", "Fish"), ("vim", "VimL"), ("zig", "Zig"),
    ("nix", "Nix"), ("tf", "Terraform"), ("proto", "Protocol Buffer"), ("graphql", "GraphQL"), ("vue", "Vue"), ("svelte", "Svelte"), ("asm", "Assembly"),
]
FIRST_LINES = [(r"^#!.*\bpython", "Python"), (r"^#!.*\b(?:ba|z|k)?sh\b", "Shell"), (r"^#!.*\bruby", "Ruby"),
               (r"^#!.*\bnode", "JavaScript"), (r"^<\?xml", "XML"), (r"(?i)^<!doctype html", "HTML"), (r"^<\?php", "PHP")]


def _kind(u: Column, pos: Column) -> Column:
    def like(pattern: str) -> Column:
        return F.rlike(u, F.lit(pattern))

    return (
        F.when((pos == 0) & like(FRONT_MATTER), "front_matter").when(like(r"^[ \t]*(?:```|~~~)"), "code")
        .when(like(r"^:::+[ \t]*[^:\s]"), "directive").when(like(r"^\s*$"), "blank")
        .when(like(r"^[^\n]+\n {0,3}(?:=+|-+)[ \t]*\n?$"), "heading").when(like(r"^ {0,3}#{1,6}(?:[ \t]|\n|$)"), "heading")
        .when(like(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})\n?$"), "rule")
        .when(like(LIST_MARKER), "item").when(like(r"^ {0,3}>"), "quote").when(like(r"^ {0,3}\[\^[^\]\s]+\]:"), "footnote").when(like(DEFINITION), "definition")
        .when(like(r"^ {0,3}</?[A-Za-z!]"), "html").when(F.contains(u, F.lit("|")), "row").otherwise("paragraph"))


def md_units(df: DataFrame, id: str, text: str, clustered: bool = False) -> DataFrame:
    """``doc_id, pos, unit, kind, line``; ``line`` is only there when the documents are clustered."""
    docs = df.select(F.col(id).alias("doc_id"), F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")).alias("_md"))
    docs = cluster_by(docs, "doc_id") if clustered else docs
    units = docs.select("doc_id", F.posexplode(F.regexp_extract_all("_md", F.lit(UNIT), F.lit(0))).alias("pos", "unit"))
    return units.withColumn("kind", _kind(F.col("unit"), F.col("pos")))


def _settle_definitions(units: DataFrame) -> DataFrame:
    """Units of clustered documents where a definition below a line of a paragraph, an item or a quote is what it looks like there: text."""
    before = F.last(F.when(F.col("kind") != "definition", F.col("kind")), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("pos"))
    return units.withColumn("_before", before).withColumn("kind", F.when(
        (F.col("kind") == "definition") & F.col("_before").isin("paragraph", "item", "quote", "footnote"), "paragraph").otherwise(F.col("kind"))).drop("_before")


def reference_label(label: Column) -> Column:
    """What labels are compared by: blanks and case do not count."""
    return F.lower(F.upper(F.trim(F.regexp_replace(label, r"\s+", " "))))


def _defined(unit: Column) -> Column:
    """``struct(label, url, title)`` of a definition's unit."""
    title = F.regexp_extract(unit, DEFINITION, 3)
    return F.struct(reference_label(F.regexp_extract(unit, DEFINITION, 1)).alias("label"), F.regexp_replace(F.regexp_extract(unit, DEFINITION, 2), "^<|>$", "").alias("url"),
                    F.when(title != "", F.substring(title, F.lit(2), F.length(title) - 2)).alias("title"))


def _heading_level(u: Column) -> Column:
    return F.when(F.rlike(u, F.lit(r"^ {0,3}#")), F.length(F.regexp_extract(u, r"^ {0,3}(#+)", 1))).when(
        F.rlike(u, F.lit(r"\n {0,3}=")), 1).otherwise(2)


def _heading_text(u: Column) -> Column:
    atx = F.regexp_replace(F.regexp_replace(u, r"^ {0,3}#{1,6}[ \t]*", ""), r"(?:^|[ \t])#+[ \t]*\n?$", "")
    return F.trim(F.regexp_replace(F.when(F.rlike(u, F.lit(r"^ {0,3}#")), atx).otherwise(F.regexp_replace(u, r"\n[\s\S]*$", "")), r"\n$", ""))


def inline_plain(text: Column) -> Column:
    """Text without inline markup: images and links keep their words, emphasis and code lose their marks."""
    for pattern, out in [(r"!?\[([^\[\]]*)\]\([^()]*\)", "$1"), (r"`([^`]*)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"),
                         (r"__([^_]+)__", "$1"), (r"\*([^*]+)\*", "$1"), (r"~~([^~]+)~~", "$1"), (r"==([^=]+)==", "$1")]:
        text = F.regexp_replace(text, pattern, out)
    return text


def md_front_matter(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, front_matter, body``; front matter is null when the document does not start with it."""
    block = F.regexp_extract(F.col(text), FRONT_MATTER, 0)
    inner = trim_ws(F.regexp_replace(block, r"^---|---\s*$", ""))
    return df.select(F.col(id).alias("doc_id"), F.when(block != "", inner).alias("front_matter"),
                     F.regexp_replace(F.col(text), FRONT_MATTER, "").alias("body"))


def md_headings(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, pos, level, text`` outside fences; empty headings are skipped. No exchange."""
    heads = md_units(df, id, text).filter("kind = 'heading'")
    return heads.select("doc_id", "pos", _heading_level(F.col("unit")).alias("level"),
                        inline_plain(_heading_text(F.col("unit"))).alias("text")).filter("trim(text) <> ''")


def md_toc(headings: DataFrame) -> DataFrame:
    """``doc_id, pos, depth, line``: guides and connectors look at later headings of the same document.

    For every depth the next heading at most that deep decides; the windows run backwards so their frames only grow.
    """
    rows = cluster_by(headings, "doc_id")
    back = W.partitionBy("doc_id").orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("depth", F.col("level") - F.min("level").over(W.partitionBy("doc_id")))
    later = [(F.last(F.when(F.col("depth") <= d, F.col("depth")), ignorenulls=True).over(back) == d).alias(f"later{d}") for d in range(6)]
    rows = rows.select("doc_id", "pos", "depth", "text", (F.lag("depth").over(ahead) > 0).alias("after_child"),
                       F.array(*[F.coalesce(c, F.lit(False)) for c in later]).alias("later"))
    guides = F.expr("array_join(transform(slice(later, 2, greatest(depth - 1, 0)), s -> if(s, '│ ', '  ')), '')")
    line = F.when(F.col("depth") == 0, F.concat(F.when(F.col("after_child"), "\n").otherwise(""), "text")).otherwise(
        F.concat(guides, F.when(F.get("later", F.col("depth")), "├─ ").otherwise("└─ "), "text"))
    return rows.select("doc_id", "pos", "depth", line.alias("line"))


def fence_language(info: Column) -> Column:
    """Language of a fence: ``{r, echo=F}`` → ``r``; nothing → ``text``."""
    braced = F.regexp_extract(info, r"^\{(.*)\}$", 1)
    words = F.filter(F.split(braced, r"[,\s]+"), lambda w: (w != "") & ~F.contains(w, F.lit("=")))
    return let(F.when(F.rlike(info, F.lit(r"^\{.*\}$")), F.coalesce(F.get(words, F.lit(0)), F.lit(""))).otherwise(info),
               lambda x: F.when(F.trim(x) == "", "text").otherwise(x))


def _fence_info(u: Column) -> Column:
    return F.trim(F.regexp_extract(u, r"^[ \t]*(?:`{3,}|~{3,})([^\n]*)", 1))


def _fence_code(u: Column) -> Column:
    body = F.regexp_replace(u, r"^[^\n]*(?:\n|\z)", "")
    return F.regexp_replace(body, r"(?:^|\n)[ \t]*(?:`{3,}|~{3,})[ \t]*\n?\z", "")


def md_code_blocks(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, pos, info, language, is_mermaid, code`` of every fence. No exchange."""
    info, lang = _fence_info(F.col("unit")), fence_language(F.col("info"))
    return md_units(df, id, text).filter("kind = 'code'").withColumn("info", info).select(
        "doc_id", "pos", "info", lang.alias("language"), lang.isin("mermaid", "mmd").alias("is_mermaid"),
        _fence_code(F.col("unit")).alias("code"))


def md_code_lines(code: DataFrame) -> DataFrame:
    """``doc_id, pos, line_no, line`` of blocks longer than ten lines."""
    lines = code.select("doc_id", "pos", F.split(F.regexp_replace("code", r"\n$", ""), "\n").alias("ls")).filter(F.size("ls") > 10)
    return lines.select("doc_id", "pos", F.posexplode("ls").alias("n", "line")).select(
        "doc_id", "pos", (F.col("n") + 1).alias("line_no"), "line")


def resolve_syntax(code: DataFrame, user_map: list[tuple[str, str]]) -> DataFrame:
    """Adds ``syntax``: the user's mapping, a known language, the first line, or Plain Text."""
    spark = code.sparkSession
    tokens = F.broadcast(rule_table(spark, SYNTAX_TOKENS, "_token, _syntax"))
    users = F.broadcast(rule_table(spark, [(e.strip().lstrip(".").lower(), s.strip()) for e, s in user_map] or [("\0", "\0")], "_ext, _mapped"))
    mapped = F.broadcast(rule_table(spark, SYNTAX_TOKENS, "_mtoken, _msyntax"))
    first = F.substring_index("code", "\n", 1)
    by_line = F.when(F.lit(False), F.lit(""))
    for pattern, name in FIRST_LINES:
        by_line = by_line.when(F.rlike(first, F.lit(pattern)), name)
    key = F.lower("language")
    return (code.join(users, key == F.col("_ext"), "left").join(mapped, F.lower("_mapped") == F.col("_mtoken"), "left")
            .join(tokens, key == F.col("_token"), "left")
            .withColumn("syntax", F.coalesce("_msyntax", "_syntax", by_line, F.lit("Plain Text")))
            .drop("_token", "_syntax", "_ext", "_mapped", "_mtoken", "_msyntax"))


IMAGE_WHOLE = r"!\[[^\[\]]*\](?:\([^()]*\)|\[[^\[\]]*\])?"
LINK_WORDS = r"(?:" + IMAGE_WHOLE + r"|[^\[\]])*+"
LINK = (IMAGE_WHOLE + r"|\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]|(?<!!)\[(" + LINK_WORDS + r")\]\(<?([^()\s<>]*)>?(?:[ \t]+[^()]*)?\)"
        r"|(?<![\[(<\"=/\w])((?:https?://|www\.)[^\s<>()\[\]`\"]*[^\s<>()\[\]`\".,;:!?'*_~])"
        r"|<((?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_{|}~-]+@[A-Za-z0-9.-]+))>"
        r"|(?<!!)\[(" + LINK_WORDS + r")\]\[([^\[\]]*)\]|(?<!!)\[(?!\^)([^\[\]]+)\](?!\[)")
TASK_MARK = r"^([ \t]*(?:[-*+]|[0-9]{1,9}[.)])[ \t]+)\[[^\]]\](?=[ \t]|$)"


def _references(rows: DataFrame, place: str) -> DataFrame:
    """Rows (doc_id, place, …, label, defined) → rows whose label is null or defined, with its ``url``; definitions themselves go.

    References and definitions meet in a window per (document, label) on the document's own partition; of several
    definitions the first counts, wherever the reference stands.
    """
    first = F.min_by("defined", F.when(F.col("defined").isNotNull(), F.col(place))).over(W.partitionBy("doc_id", "label"))
    rows = rows.withColumn("to", F.when(F.col("label").isNotNull(), first))
    return rows.filter(F.col("defined").isNull() & (F.col("label").isNull() | F.col("to").isNotNull()))


def md_definitions(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, pos, label, url, title`` of every definition that references can use: of equal labels the first."""
    units = _settle_definitions(md_units(df, id, text, clustered=True)).filter("kind = 'definition'").withColumn("d", _defined(F.col("unit")))
    first = F.row_number().over(W.partitionBy("doc_id", "d.label").orderBy("pos")) == 1
    return units.withColumn("_first", first).filter("_first").select("doc_id", "pos", "d.label", "d.url", "d.title")


def md_links(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, pos, n, kind, url, title``: inline links, ``[[url|title]]``, ``<url>``, bare addresses and references, outside code.

    A reference (``[words][label]``, ``[label][]``, ``[label]``) is a link where its document defines the label.
    """
    units = _settle_definitions(md_units(df, id, text, clustered=True)).filter("kind NOT IN ('code', 'front_matter', 'blank', 'rule')")
    prose = F.regexp_replace(F.regexp_replace("unit", TASK_MARK, "$1"), CODE_SPAN, "")
    groups = [F.regexp_extract_all("prose", F.lit(LINK), F.lit(i)).alias(n) for i, n in
              enumerate(["whole", "wiki", "wiki_title", "title", "url", "bare", "auto", "words", "full", "short"])]
    defined = F.when(F.col("kind") == "definition", _defined(F.col("unit")))
    rows = units.withColumns({"prose": F.when(F.col("kind") != "definition", prose).otherwise(""), "defined": defined})
    rows = rows.select("doc_id", "pos", "defined", F.posexplode_outer(F.arrays_zip(*groups)).alias("n", "m")).filter("m IS NOT NULL OR defined IS NOT NULL")
    whole = F.col("m.whole")
    rows = rows.filter(whole.isNull() | ~F.startswith(whole, F.lit("!")))  # images are no links, but words of links
    kind = (F.when(F.startswith(whole, F.lit("[[")), "wiki").when(F.startswith(whole, F.lit("<")), "auto").when(~F.startswith(whole, F.lit("[")), "bare")
            .when(F.endswith(whole, F.lit(")")), "inline").otherwise("reference"))
    named = F.when(F.endswith(whole, F.lit("[]")), F.col("m.words")).when(F.col("m.full") != "", F.col("m.full")).otherwise(F.col("m.short"))
    rows = rows.withColumn("kind", kind).withColumn("label", F.coalesce("defined.label", F.when(F.col("kind") == "reference", reference_label(named))))
    rows = _references(rows, "pos")
    kind = F.col("kind")
    mail = F.when(F.contains("m.auto", F.lit(":")), F.col("m.auto")).otherwise(F.concat(F.lit("mailto:"), "m.auto"))
    return rows.select(
        "doc_id", "pos", (F.row_number().over(W.partitionBy("doc_id", "pos").orderBy("n")) - 1).alias("n"), "kind",
        F.when(kind == "wiki", F.col("m.wiki")).when(kind == "inline", F.col("m.url")).when(kind == "reference", F.col("to.url")).when(kind == "auto", mail).otherwise(F.col("m.bare")).alias("url"),
        F.when(kind == "wiki", F.coalesce(F.nullif(F.col("m.wiki_title"), F.lit("")), F.col("m.wiki"))).when(kind == "inline", F.col("m.title"))
        .when(kind == "reference", F.when(F.col("m.short") != "", F.col("m.short")).otherwise(F.col("m.words"))).when(kind == "auto", F.col("m.auto")).otherwise(F.col("m.bare")).alias("title"))


def md_blocks(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, block_no, type, level, info, text, line_from, line_to`` in document order.

    Neighbouring lines of one kind belong together; a plain line right below an item or a quote continues it. Pipe rows
    are a table only when their second line is a delimiter row.
    """
    units = _settle_definitions(md_units(df, id, text, clustered=True))
    by_doc = W.partitionBy("doc_id").orderBy("pos")
    # a pipe row starts a table when a delimiter row follows; rows go on until another kind of line
    heads = (F.col("kind") == "row") & F.coalesce(F.rlike(F.lead("unit").over(by_doc), F.lit(DELIMITER_ROW_LINE)), F.lit(False))
    units = units.withColumn("heads", heads).withColumn("in_table", F.last(F.when(
        (F.col("kind") != "row") | F.col("heads"), F.col("heads")), ignorenulls=True).over(by_doc))
    units = units.withColumn("kind", F.when(F.col("kind") != "row", F.col("kind")).when(F.col("heads"), "table")
                             .when(F.col("in_table"), "row").otherwise("paragraph"))
    lines = F.length("unit") - F.length(F.replace("unit", F.lit("\n"), F.lit(""))) + F.when(F.endswith("unit", F.lit("\n")), 0).otherwise(1)
    kind, prev = F.col("kind"), F.col("prev")
    units = units.withColumns({"lines": lines, "prev": F.lag("kind").over(by_doc), "indented": F.rlike("unit", F.lit(r"^(?: {2,}|\t)"))})
    runs_on = (kind.isin("paragraph", "quote", "html") & (kind == prev)) | (kind == "row") | (
        (kind == "paragraph") & prev.isin("item", "quote", "footnote", "html", "row"))
    units = units.withColumn("runs_on", F.coalesce(runs_on, F.lit(False)))
    # below a blank line only an indented paragraph goes on, and only inside a list
    anchor = F.last(F.when((kind != "blank") & ~F.col("indented") & ~F.col("runs_on"), kind), ignorenulls=True).over(by_doc)
    joins = F.col("runs_on") | (kind == "blank") | ((kind == "paragraph") & F.col("indented") & (F.col("anchor") == "item"))
    units = units.withColumn("anchor", anchor).withColumn("joins", F.coalesce(joins, F.lit(False))).withColumns({
        "block": F.sum((~F.col("joins")).cast("int")).over(by_doc), "line_to": F.sum("lines").over(by_doc)})
    blocks = units.filter("block > 0").groupBy("doc_id", "block").agg(
        F.min_by("kind", "pos").alias("kind"), F.min(F.col("line_to") - F.col("lines") + 1).alias("line_from"),
        F.max(F.when(kind != "blank", F.col("line_to"))).alias("line_to"),
        F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "unit"))), lambda s: s["unit"]), ""),
                         r"\n(?:[ \t]*\n)+\z", "\n").alias("raw"))
    raw = F.regexp_replace("raw", r"\n\z", "")
    type_ = F.col("kind")
    body = (F.when(type_ == "heading", _heading_text(F.col("raw"))).when(type_ == "code", _fence_code(F.col("raw")))
            .when(type_ == "quote", F.regexp_replace(raw, r"(?m)^ {0,3}>[ \t]?", ""))
            .when(type_ == "item", F.regexp_replace(F.regexp_replace(raw, LIST_MARKER, ""), r"\n[ \t]+", "\n"))
            .when(type_ == "front_matter", trim_ws(F.regexp_replace(raw, r"^---|---\s*$", "")))
            .when(type_ == "footnote", F.regexp_replace(raw, r"^ {0,3}\[\^[^\]]+\]:[ \t]*", ""))
            .when(type_ == "definition", _defined(F.col("raw"))["url"]).when(type_ == "rule", "").otherwise(raw))
    by_block = W.partitionBy("doc_id").orderBy("block")
    return blocks.select(
        "doc_id", (F.row_number().over(by_block) - 1).alias("block_no"), type_.alias("type"),
        F.when(type_ == "heading", _heading_level(F.col("raw"))).alias("level"),
        F.when(type_ == "code", _fence_info(F.col("raw"))).when(type_ == "item", F.regexp_extract("raw", LIST_MARKER, 2))
        .when(type_ == "footnote", F.regexp_extract("raw", r"^ {0,3}\[\^([^\]]+)\]", 1)).when(type_ == "definition", _defined(F.col("raw"))["label"]).alias("info"),
        body.alias("text"), "line_from", "line_to", "raw")


def _split_row(line: Column) -> Column:
    """Cells of one pipe row; ``\\|`` is a character, not a separator."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def _table_arrays(blocks: DataFrame) -> DataFrame:
    """Header, alignment and body arrays of tables, null for other blocks."""
    tables = blocks.withColumn("ls", F.when(F.col("type") == "table", F.split(F.regexp_replace("raw", r"\n\z", ""), "\n")))
    head, delim = _split_row(F.get("ls", F.lit(0))), _split_row(F.get("ls", F.lit(1)))
    body = F.transform(F.filter("ls", lambda _l, i: i > 1), _split_row)
    align = F.transform(delim, lambda d: F.when(F.rlike(d, F.lit("^:-+:$")), "center").when(F.endswith(d, F.lit(":")), "right")
                        .when(F.startswith(d, F.lit(":")), "left").otherwise("none"))
    return tables.withColumns({"head": head, "body": body, "align": align})


def md_tables(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, block_no, row_no, col_no, value, align, width``; row 0 is the header, width the widest cell of a column."""
    tables = _table_arrays(md_blocks(df, id, text).filter("type = 'table'")).withColumn("rows", F.concat(F.array("head"), "body")).withColumn(
        "widths", F.transform(F.sequence(F.lit(0), F.size("head") - 1), lambda c: F.array_max(F.transform(
            F.col("rows"), lambda r: F.coalesce(F.length(F.get(r, c)), F.lit(0))))))
    cells = tables.select("doc_id", "block_no", "align", "widths", F.posexplode("rows").alias("row_no", "cells")).select(
        "doc_id", "block_no", "row_no", "align", "widths", F.posexplode(F.slice("cells", F.lit(1), F.size("widths"))).alias("col_no", "value"))
    return cells.select("doc_id", "block_no", "row_no", "col_no", "value", F.get("align", F.col("col_no")).alias("align"),
                        F.get("widths", F.col("col_no")).alias("width"))


IMAGE = r"!\[([^\[\]]*)\]\(<?([^()\s<>]+)>?(?:[ \t]+[^()]*)?\)|!\[([^\[\]]*)\]\[([^\[\]]*)\]|!\[([^\[\]]+)\]"


def md_images(df: DataFrame, id: str, text: str, page_width: int = 1920) -> DataFrame:
    """``doc_id, block_no, n, alt, base_url, width, height``, by address or by reference; in a table the width defaults to 90 % of the page per column."""
    blocks = md_blocks(df, id, text).filter("type NOT IN ('code', 'front_matter')")
    prose = F.when(F.col("type") == "definition", "").otherwise(F.regexp_replace("raw", CODE_SPAN, ""))
    found = F.arrays_zip(*[F.regexp_extract_all(prose, F.lit(IMAGE), F.lit(i)).alias(n) for i, n in enumerate(["whole", "alt", "url", "words", "full", "short"])])
    columns = F.size(_split_row(F.substring_index("raw", "\n", 1)))
    share = F.floor(F.lit(page_width * 9 // 10) / columns).cast("string")
    defined = F.when(F.col("type") == "definition", F.struct(F.col("info").alias("label"), F.col("text").alias("url")))
    rows = blocks.select("doc_id", "block_no", defined.alias("defined"), F.when(F.col("type") == "table", share).alias("share"), F.posexplode_outer(found).alias("n", "m"))
    named = F.when(F.endswith("m.whole", F.lit("[]")), F.col("m.words")).when(F.col("m.full") != "", F.col("m.full")).when(F.col("m.short") != "", F.col("m.short"))
    rows = _references(rows.filter("m IS NOT NULL OR defined IS NOT NULL").withColumn("label", F.coalesce("defined.label", reference_label(named))), "block_no")
    by_label = F.col("label").isNotNull()
    ref = parse_image_ref(F.when(by_label, F.col("to.url")).otherwise(F.col("m.url")))
    alt = F.when(~by_label, F.col("m.alt")).when(F.col("m.short") != "", F.col("m.short")).otherwise(F.col("m.words"))
    rows = rows.withColumns({"ref": ref, "alt": alt}).filter("ref IS NOT NULL").withColumn("n", F.row_number().over(W.partitionBy("doc_id", "block_no").orderBy("n")) - 1)
    return rows.select("doc_id", "block_no", "n", "alt", "ref.base_url", F.coalesce("ref.width", "share").alias("width"), "ref.height")


def md_list_items(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, pos, list_id, depth, ordered, number, path, text`` of every item; ``pos`` is its block number.

    Depth follows indentation: an enclosing indentation is active when the last item indented at most that far sits
    exactly there. Every item asks each narrower indentation of its list once, so there is no pairing of items.
    """
    items = _with_list_position(md_blocks(df, id, text)).filter("type = 'item'")
    return items.select("doc_id", F.col("block_no").alias("pos"), "list_id", "depth", "ordered", "number", "path", trim_ws(F.col("text")).alias("text"))


def _with_list_position(blocks: DataFrame) -> DataFrame:
    """Blocks with ``list_id, depth, ordered, number, path`` of items; other blocks pass through on the same plan."""
    by_doc = W.partitionBy("doc_id").orderBy("block_no")
    is_item = F.col("type") == "item"
    starts = is_item & F.coalesce(F.lag("type").over(by_doc) != "item", F.lit(True))
    marker = F.col("info")
    carried = blocks.columns
    rows = blocks.withColumns({
        "starts": starts, "ordered": is_item & ~marker.isin("-", "*", "+"), "given": F.when(is_item, F.regexp_extract(marker, r"^\d+", 0).try_cast("bigint")),
        "indent": F.when(is_item, F.length(F.replace(F.regexp_extract("raw", LIST_MARKER, 1), F.lit("\t"), F.lit("    "))))})
    rows = rows.withColumn("list_id", F.sum(F.col("starts").cast("int")).over(by_doc))
    in_list = W.partitionBy("doc_id", "list_id")
    # an item answers for its own indentation and every wider one of its list, and asks each narrower one
    asked = rows.drop("starts").withColumn("widths", F.when(is_item, F.collect_set("indent").over(in_list)))
    asked = asked.select("*", F.explode_outer("widths").alias("w")).drop("widths")
    below = F.last(F.when(F.col("indent") <= F.col("w"), F.struct("indent", "block_no", "ordered")), ignorenulls=True).over(
        W.partitionBy("doc_id", "list_id", "w").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1))
    active = F.when((F.col("w") < F.col("indent")) & (F.col("above.indent") == F.col("w")),
                    F.struct(F.col("w"), F.col("above.block_no").alias("block_no"), F.col("above.ordered").alias("ordered")))
    placed = asked.withColumn("above", below).groupBy("doc_id", "list_id", "block_no").agg(
        *[F.first(c).alias(c) for c in carried if c not in ("doc_id", "block_no")], *[F.first(c).alias(c) for c in ("ordered", "given")],
        F.sort_array(F.collect_list(active)).alias("up"))
    parent = F.coalesce(F.get("up", F.size("up") - 1)["block_no"], F.lit(-1))
    placed = placed.withColumn("parent", F.when(is_item, parent))
    siblings = W.partitionBy("doc_id", "list_id", "parent").orderBy("block_no")
    number = F.when(F.col("ordered"), F.first("given").over(siblings) + F.row_number().over(siblings) - 1)
    return placed.withColumns({"depth": F.when(is_item, F.size("up")), "number": number,
                               "path": F.concat(F.transform("up", lambda u: u["ordered"]), F.array("ordered"))}).drop("parent", "given", "up")


def md_tasks(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, pos, state, text``: ``x`` done, ``-`` or ``~`` partial, ``!`` blocked, anything else open. No exchange."""
    body = F.regexp_replace("unit", LIST_MARKER, "")
    tasks = md_units(df, id, text).filter("kind = 'item'").withColumn("body", body).filter(F.rlike("body", F.lit(r"^\[[^\]]\](?:[ \t]|$)")))
    mark = F.lower(F.substring("body", 2, 1))
    return tasks.select("doc_id", "pos", F.when(mark == "x", "done").when(mark.isin("-", "~"), "partial").when(mark == "!", "blocked")
                        .otherwise("open").alias("state"), trim_ws(F.substring("body", 4, 2147483647)).alias("text"))


def md_footnotes(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, name, pos, definition``: every reference with its definition, and definitions nobody refers to.

    References and definitions meet in a window per (document, name) on the document's own partition, which gives the
    outer join without a second exchange.
    """
    units = md_units(df, id, text, clustered=True).filter("kind NOT IN ('code', 'front_matter', 'blank')")
    is_def = F.col("kind") == "footnote"
    body = F.when(is_def, F.regexp_replace("unit", r"^ {0,3}\[\^[^\]]+\]:[ \t]*", "")).otherwise(F.col("unit"))
    named = F.when(is_def, F.array(F.struct(F.regexp_extract("unit", r"^ {0,3}\[\^([^\]]+)\]", 1).alias("name"), trim_ws(body).alias("definition"))))
    refs = F.transform(F.regexp_extract_all(F.regexp_replace(body, CODE_SPAN, ""), F.lit(r"\[\^([^\]\s]+)\]"), F.lit(1)),
                       lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("definition")))
    rows = units.select("doc_id", "pos", F.explode(F.concat(F.coalesce(named, F.slice(refs, 1, 0)), refs)).alias("r")).select(
        "doc_id", "pos", "r.name", "r.definition")
    same = W.partitionBy("doc_id", "name")
    rows = rows.select("doc_id", "name", F.when(F.col("definition").isNull(), F.col("pos")).alias("pos"),
                       F.min_by("definition", F.when(F.col("definition").isNotNull(), F.col("pos"))).over(same).alias("definition"),
                       F.count(F.when(F.col("definition").isNull(), 1)).over(same).alias("refs"))
    return rows.filter("pos IS NOT NULL OR refs = 0").drop("refs")


def md_alerts(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, block_no, alert, text`` of ``> [!NOTE]`` quotes and ``:::`` directives."""
    blocks = md_blocks(df, id, text).filter("type IN ('quote', 'directive')")
    quoted = F.lower(F.regexp_extract("text", r"^\[!([A-Za-z]+)\][ \t]*(?:\n|$)", 1))
    info = F.trim(F.regexp_replace(F.regexp_extract("raw", r"^:::+[ \t]*([^\n]*)", 1), r"^\{|\}$", ""))
    name = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_extract(info, r"^(\S*)", 1), r"^\.+", "")), r"^callout-(?=(?:note|tip|important|warning|caution)$)", "")
    rules = F.broadcast(rule_table(df.sparkSession, ALERTS, "_alert, _shown"))
    is_quote = F.col("type") == "quote"
    rows = blocks.withColumn("key", F.when(is_quote, quoted).otherwise(name)).join(rules, F.col("key") == F.col("_alert"), "left")
    rows = rows.filter(~is_quote | F.col("_shown").isNotNull())
    body = F.when(is_quote, F.regexp_replace("text", r"^[^\n]*\n?", "")).otherwise(
        F.regexp_replace(F.regexp_replace("raw", r"^[^\n]*\n", ""), r"(?:^|\n):::+[ \t]*\n?\z", ""))
    return rows.select("doc_id", "block_no", F.coalesce("_shown", F.when(F.col("key") == "", "DIRECTIVE").otherwise(F.col("key"))).alias("alert"),
                       trim_ws(body).alias("text"))


MATH = r"\$\$([^$]+)\$\$|(?<![\\$])\$(?![\s$])([^$\n]*[^$\s\\])\$(?![0-9$])"


def md_math(df: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, block_no, n, display, literal`` of ``$…$`` and ``$$…$$`` outside code."""
    blocks = md_blocks(df, id, text).filter("type NOT IN ('code', 'front_matter')")
    prose = F.regexp_replace("raw", CODE_SPAN, "")
    found = F.arrays_zip(F.regexp_extract_all(prose, F.lit(MATH), F.lit(1)).alias("display"), F.regexp_extract_all(prose, F.lit(MATH), F.lit(2)).alias("inline"))
    rows = blocks.select("doc_id", "block_no", F.posexplode(found).alias("n", "m"))
    display = F.coalesce(F.col("m.display") != "", F.lit(False))
    return rows.select("doc_id", "block_no", "n", display.alias("display"),
                       trim_ws(F.when(display, F.col("m.display")).otherwise(F.col("m.inline"))).alias("literal"))


# Fixed value: the page around a fragment.
PAGE_HEAD = '<!DOCTYPE html>\n<html>\n<head>\n  <meta charset="utf-8">\n  <style>{css}</style>\n</head>\n<body>\n'
PAGE_TAIL = "</body>\n</html>\n"


def _item_html() -> Column:
    """An item with the list tags that open before and close after it; ``was`` and ``next`` are neighbouring depths."""
    opened = F.when(F.col("depth") > F.col("was"), F.concat(
        F.when(F.col("was") >= 0, "\n").otherwise(""),
        F.when(F.col("ordered"), F.concat(F.lit("<ol"), F.when(F.col("number") != 1, F.concat(F.lit(' start="'), F.col("number"), F.lit('"'))).otherwise(""), F.lit(">\n"))).otherwise("<ul>\n"))).otherwise("")
    levels = F.reverse(F.filter("path", lambda _p, i: i > F.col("next")))
    closing = F.array_join(F.transform(levels, lambda o: F.concat(
        F.lit("</li>\n"), F.when(o, "</ol>\n").otherwise("</ul>\n"))), "")
    closed = F.when(F.col("next") > F.col("depth"), "").when(F.col("next") == F.col("depth"), "</li>\n").otherwise(
        F.concat(closing, F.when(F.col("next") >= 0, "</li>\n").otherwise("")))
    return F.concat(opened, F.lit("<li>"), F.col("inline"), closed)


def md_to_html(df: DataFrame, id: str, text: str, wrap: bool = False, css: str = "") -> DataFrame:
    """``doc_id, html``: the fragment, or a whole page around it."""
    by_list = W.partitionBy("doc_id", "list_id").orderBy("block_no")
    blocks = _table_arrays(_with_list_position(md_blocks(df, id, text)).filter("type <> 'front_matter'"))
    defined = F.col("type") == "definition"
    # cells of a table in one row, every row as wide as the first, so that inline markup is one expression for all kinds
    width = F.size("head")
    cells = F.concat(F.col("head"), F.flatten(F.transform("body", lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(r, i), F.lit(""))))))
    texts = F.when(F.col("type") == "table", cells).when(~F.col("type").isin("code", "rule", "html", "definition"), F.array(trim_ws(F.col("text"))))
    blocks = blocks.withColumns({
        "was": F.coalesce(F.lag("depth").over(by_list), F.lit(-1)), "next": F.coalesce(F.lead("depth").over(by_list), F.lit(-1)), "cells": F.transform(texts, inline_html)})
    blocks = blocks.withColumn("inline", F.get("cells", F.lit(0)))
    tag = F.concat(F.lit("h"), F.col("level"))
    lang = fence_language(F.coalesce("info", F.lit("")))
    code_class = F.when(F.coalesce("info", F.lit("")) == "", "").otherwise(F.concat(F.lit(' class="language-'), lang, F.lit('"')))
    paragraph = F.concat(F.lit("<p>"), F.col("inline"), F.lit("</p>\n"))

    def row(number: Column, name: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.concat(
            F.lit(f"<{name}"), F.when(F.get("align", i) == "none", "").otherwise(F.concat(F.lit(' align="'), F.get("align", i), F.lit('"'))),
            F.lit(">"), F.get("cells", number * width + i), F.lit(f"</{name}>\n"))), "")

    table = F.concat(F.lit("<table>\n<thead>\n<tr>\n"), row(F.lit(0), "th"), F.lit("</tr>\n</thead>\n"), F.when(
        F.size("body") > 0, F.concat(F.lit("<tbody>\n"), F.array_join(F.transform("body", lambda _r, j: F.concat(
            F.lit("<tr>\n"), row(j + 1, "td"), F.lit("</tr>\n"))), ""), F.lit("</tbody>\n"))).otherwise(""), F.lit("</table>\n"))
    html = (F.when(F.col("type") == "heading", F.concat(F.lit("<"), tag, F.lit(">"), F.col("inline"), F.lit("</"), tag, F.lit(">\n")))
            .when(F.col("type") == "code", F.concat(F.lit("<pre><code"), code_class, F.lit(">"), escape_html(F.col("text")), F.lit("\n</code></pre>\n")))
            .when(F.col("type") == "rule", "<hr />\n").when(defined, "").when(F.col("type") == "html", F.concat("text", F.lit("\n"))).when(F.col("type") == "table", table)
            .when(F.col("type") == "item", _item_html())
            .when(F.col("type") == "quote", F.concat(F.lit("<blockquote>\n"), paragraph, F.lit("</blockquote>\n"))).otherwise(paragraph))
    entry = F.when(defined, F.struct(F.col("info").alias("label"), "block_no", _defined(F.col("raw"))["url"].alias("url"), _defined(F.col("raw"))["title"].alias("title")))
    docs = blocks.select("doc_id", "block_no", html.alias("html"), entry.alias("entry")).groupBy("doc_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("block_no", "html"))), lambda s: s["html"]), "").alias("html"), F.sort_array(F.collect_list("entry")).alias("entries"))
    docs = docs.select("doc_id", resolve_references(F.col("html"), F.col("entries")).alias("html"))
    # documents without any content give an empty fragment; ids name rows
    docs = df.select(F.col(id).alias("doc_id")).distinct().join(docs, "doc_id", "left").withColumn("html", F.coalesce("html", F.lit("")))
    if not wrap:
        return docs
    return docs.select("doc_id", F.concat(F.lit(PAGE_HEAD.format(css=css)), "html", F.lit(PAGE_TAIL)).alias("html"))
