"""File kinds and converter formats from bytes and extensions, as pure column expressions.

Signatures are literals compared with byte ranges, so a scan that only classifies reads no more than the head.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.text import decode_text, let, utf8_valid
from doclake.rules import FORMAT_EXTENSIONS, KIND_EXTENSIONS, MIME_KINDS, rule_table

SNIFF_BYTES = 2048

# Fixed values: (offset, hex) signatures from the public format specifications.
PDF = [(0, "255044462D")]
GIF = [(0, "474946383961"), (0, "474946383761")]
EXE = [(0, "4D5A")]
JXL = [(0, "FF0A"), (0, "0000000C4A584C200D0A870A")]
ZIP = [(0, "504B0304"), (0, "504B0506"), (0, "504B0708")]
TAR = [(257, "7573746172")]
OLE = [(0, "D0CF11E0A1B11AE1")]
GZ = [(0, "1F8B08")]
XZ = [(0, "FD377A585A00")]
AUDIO = [(0, "494433"), (0, "FFFB"), (0, "664C6143"), (0, "4F676753"), (0, "4D546864"), (4, "667479704D3441"),
         (0, "2321414D52"), (0, "FFF1"), (0, "FFF9")]
VIDEO = [(0, "1A45DFA3"), (0, "3026B2758E66CF11"), (0, "464C5601"), (0, "000001B3"), (0, "000001BA"),
         (4, "6674797069736F6D"), (4, "667479706D703431"), (4, "667479706D703432"), (4, "667479704D3456"),
         (4, "6674797071742020"), (4, "6674797061766331"), (4, "6674797033677035"),
         (4, "6674797069736F32"), (4, "6674797069736F35"), (4, "6674797069736F36"), (4, "6674797064617368"), (4, "667479704D534E56")]
APP = [(0, "4D5A"), (0, "7F454C46"), (0, "CAFEBABE"), (0, "0061736D"), (0, "CFFAEDFE"), (0, "FEEDFACF"),
       (0, "6465780A"), (0, "6465790A"), (0, "4243C0DE")]
IMAGE = [
    (0, "89504E470D0A1A0A"), (0, "FFD8FF"), (0, "474946383961"), (0, "474946383761"), (0, "4D4D002A"),
    (0, "49492A00"), (0, "44445320"), (0, "424D"), (0, "00000100"), (0, "233F52414449414E4345"), (0, "762F3101"),
    (0, "716F6966"), (0, "5031"), (0, "5032"), (0, "5033"), (0, "5034"), (0, "5035"), (0, "5036"), (0, "5037"),
    (0, "6661726266656C64"),
]
# Images that are linked but never decoded: Photoshop, JPEG 2000, JPEG XR.
OTHER_IMAGE = [(0, "38425053"), (0, "0000000C6A5020200D0A870A"), (0, "FF4FFF51"), (0, "4949BC")]
ODF_MIME = {name: "mimetypeapplication/vnd.oasis.opendocument." + kind
            for name, kind in [("odt", "text"), ("odp", "presentation"), ("ods", "spreadsheet")]}

# First words of a Mermaid diagram.
MERMAID_KEYWORDS = [
    "graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram-v2", "stateDiagram", "erDiagram",
    "journey", "gantt", "pie", "gitGraph", "mindmap", "timeline", "quadrantChart", "requirementDiagram", "C4Context",
    "sankey-beta", "xychart-beta", "block-beta",
]


def bytes_at(content: Column, offset: int, signature: bytes) -> Column:
    return F.substring(content, offset + 1, len(signature)) == F.lit(signature)


def has_signature(content: Column, signatures) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [bytes_at(content, o, bytes.fromhex(h)) for o, h in signatures]), F.lit(False))


def is_image(content: Column) -> Column:
    """Plain image signatures plus the two with free bytes: RIFF????WEBP and 00 00 ?? ?? ftypavif."""
    webp = bytes_at(content, 0, b"RIFF") & bytes_at(content, 8, b"WEBP")
    avif = bytes_at(content, 0, b"\0\0") & bytes_at(content, 4, b"ftypavif")
    return has_signature(content, IMAGE) | F.coalesce(webp | avif, F.lit(False))


def is_other_image(content: Column) -> Column:
    """Image containers that are linked but never decoded."""
    brand = bytes_at(content, 4, b"ftyp") & F.substring(content, 9, 4).isin([F.lit(b) for b in (b"avif", b"avis", b"heic", b"heix", b"mif1")])
    return has_signature(content, OTHER_IMAGE) | F.coalesce(brand, F.lit(False))


def is_video(content: Column) -> Column:
    avi = bytes_at(content, 0, b"RIFF") & bytes_at(content, 8, b"AVI ")
    return has_signature(content, VIDEO) | F.coalesce(avi, F.lit(False))


def is_audio(content: Column) -> Column:
    wav = bytes_at(content, 0, b"RIFF") & bytes_at(content, 8, b"WAVE")
    aiff = bytes_at(content, 0, b"FORM") & F.substring(content, 9, 4).isin([F.lit(b) for b in (b"AIFF", b"AIFC")])
    return has_signature(content, AUDIO) | F.coalesce(wav | aiff, F.lit(False))


def head_text(content: Column) -> Column:
    return F.make_valid_utf8(F.substring(content, 1, SNIFF_BYTES).cast("string"))


def is_svg(content: Column) -> Column:
    """The first real tag of the head is ``svg``; prolog, comments and declarations are skipped."""
    return F.coalesce(F.rlike(head_text(content), F.lit(r"^(?:\s*+<[?!][^>]*+>)*+\s*+<svg(?:[ \t\n\r/][^>]*+)?>")), F.lit(False))


def is_mermaid(content: Column) -> Column:
    """First word after front matter, blank lines and ``%%`` comments is a diagram keyword."""
    body = F.regexp_replace(head_text(content), r"^[ \t]*---[ \t]*\r?\n(?:(?![ \t]*---[ \t]*(?:\r?\n|$))[^\n]*+\n)*+[ \t]*---[ \t]*(?:\r?\n|$)", "")
    word = F.regexp_extract(body, r"^(?:[ \t\r]*+(?:%%[^\n]*+)?\n)*+[ \t\r]*+([^\s(]*)", 1)
    return F.coalesce(word.isin(MERMAID_KEYWORDS), F.lit(False))


def _by_extension(ext: Column, groups) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, exts in groups:
        out = out.when(ext.isin(exts), name)
    return out


def detect_kind(content: Column, ext: Column) -> Column:
    """Any content rule beats every extension rule; null when nothing matches."""
    ext = F.lower(F.coalesce(ext, F.lit("")))
    by_content = (
        F.when((ext == "mmd") & is_mermaid(content), "Mermaid")
        .when(has_signature(content, PDF), "Pdf").when(has_signature(content, GIF), "Gif")
        .when(is_image(content), "Image").when(is_video(content), "Video").when(has_signature(content, EXE), "Exe")
        .when(has_signature(content, JXL), "JpegXL").when(is_svg(content), "Svg"))
    return F.coalesce(by_content, _by_extension(ext, KIND_EXTENSIONS))


def is_zip(content: Column) -> Column:
    return has_signature(content, ZIP)


def zip_directory(content: Column) -> Column:
    """The archive's own table of members, which its last record points to; empty where that is damaged.

    Names inside members, of an archive stored in this one for example, are no part of it.
    """
    size = F.octet_length(content)

    def number(record: Column, first: int) -> Column:
        return F.conv(F.concat(*[F.hex(F.substring(record, first + i, 1)) for i in (4, 3, 2, 1)]), 16, 10).cast("long")

    def of(tail: Column) -> Column:
        # the last end record starts before a comment of up to 65,535 bytes, mostly empty
        at = F.when(F.substring(tail, -22, 4) == F.lit(b"PK\5\6"), F.substring(tail, -22, 22)).otherwise(F.unhex(F.regexp_extract(
            F.hex(tail), "^(?:[0-9A-F]{2})*(504B0506[0-9A-F]{36})", 1)))
        return let(at, lambda r: F.when((F.octet_length(r) == 22) & (number(r, 16) + number(r, 12) <= size),
                                        F.substring(content, (number(r, 16) + 1).cast("int"), number(r, 12).cast("int"))))

    return F.coalesce(let(F.substring(content, -65557, 65557), of), F.lit(b""))


def _ooxml(directory: Column, folder: str) -> Column:
    return F.contains(directory, F.lit(b"[Content_Types].xml")) & F.contains(directory, F.lit(folder.encode()))


def _odf(content: Column, name: str) -> Column:
    # the media type is the first, stored member; a longer type must not match its prefix
    mime = ODF_MIME[name].encode()
    return is_zip(content) & bytes_at(content, 30, mime) & ~bytes_at(content, 30 + len(mime), b"-")


def detect_format(content: Column, ext: Column) -> Column:
    """The ordered rules, content or extension; then signatures; then text or binary."""
    ext = F.coalesce(ext, F.lit(""))
    ext = F.when((ext == "mmd") & is_mermaid(content), "mermaid").otherwise(ext)
    whole = {"odt": _odf(content, "odt"), "odp": _odf(content, "odp"), "ods": _odf(content, "ods"),
             "xls": has_signature(content, OLE), "zip": is_zip(content), "tar": has_signature(content, TAR)}

    def chain(e: Column, directory: Column) -> Column:
        checks = whole | {n: F.coalesce(_ooxml(directory, folder), F.lit(False)) for n, folder in (("docx", "word/"), ("pptx", "ppt/"), ("xlsx", "xl/"))}
        out = F.when(F.lit(False), F.lit(""))
        for name, exts in FORMAT_EXTENSIONS:
            rule = e.isin(exts)
            out = out.when(checks[name] | rule if name in checks else rule, name)
        return (out.when(is_image(content), "image").when(is_other_image(content), "image").when(is_audio(content), "audio").when(is_video(content), "video")
                .when(has_signature(content, APP), "app").when(utf8_valid(content), "text").otherwise("binary"))

    # only the member table of a zip is read, once
    return let(F.when(is_zip(content), zip_directory(content)), lambda d: let(ext, lambda e: chain(e, d)))


def file_ext(path: Column) -> Column:
    """Lower-case extension of the last path segment; empty when there is none (dot-only names have none)."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def url_ext(url: Column) -> Column:
    """Text after the last dot of the last segment before ``?``; the whole segment without a dot, ``#…`` kept."""
    return F.substring_index(F.substring_index(F.substring_index(url, "?", 1), "/", -1), ".", -1)


def mime_kind(df: DataFrame, mime: str) -> DataFrame:
    """Adds ``kind``; parameters are ignored, other ``text/*`` is PreMarkdown, unknown types stay null."""
    rules = rule_table(df.sparkSession, MIME_KINDS, "_mime, _kind")
    bare = F.trim(F.substring_index(F.col(mime), ";", 1))
    return df.withColumn("_bare", bare).join(F.broadcast(rules), F.col("_bare") == F.col("_mime"), "left").withColumn(
        "kind", F.coalesce("_kind", F.when(F.startswith("_bare", F.lit("text/")), "PreMarkdown"))).drop("_bare", "_mime", "_kind")


def resolve_kind(df: DataFrame, url: str, mime: str, content: str) -> DataFrame:
    """Fetched rows: octet-stream by URL extension, else MIME type; decided content wins over both.

    Rows whose declared kind is unknown stay unknown; pages (Html) are not sniffed.
    """
    typed = mime_kind(df, mime)
    ext = url_ext(F.col(url))
    declared = F.when(F.trim(F.substring_index(F.col(mime), ";", 1)) == "application/octet-stream",
                      _by_extension(F.lower(ext), KIND_EXTENSIONS)).otherwise(F.col("kind"))
    sniffed = F.coalesce(detect_kind(F.col(content), ext), F.lit("PreMarkdown"))
    return typed.withColumn("declared", declared).withColumn(
        "kind", F.when(F.col("declared").isNull() | (F.col("declared") == "Html"), F.col("declared"))
        .when(sniffed != "PreMarkdown", sniffed).otherwise(F.col("declared")))


def fallback_link(content: Column, format: Column, path: Column, ext: Column, inline: bool = False) -> Column:
    """Placeholder Markdown of everything that is not converted: media links, binary links, fenced text."""
    shown = F.coalesce(path, F.lit(""))
    image = F.concat(F.lit("![Image]("), shown, F.lit(")"))
    if inline:
        image = F.when(is_image(content), embed_data_uri(content, F.lit("image/png"))).otherwise(image)
    return (
        F.when(format == "image", image)
        .when(format == "audio", F.concat(F.lit('<audio controls src="'), shown, F.lit('"></audio>')))
        .when(format == "video", F.concat(F.lit("![Video]("), shown, F.lit(")")))
        .when(format == "html", F.concat(F.lit("```html\n"), decode_text(content), F.lit("\n```")))
        .when(format == "markdown", decode_text(content))
        .when(format == "text", F.concat(F.lit("```"), F.coalesce(ext, F.lit("")), F.lit("\n"), decode_text(content), F.lit("\n```")))
        .otherwise(F.concat(F.lit("["), F.coalesce(ext, F.lit("Bin")), F.lit(" file]("), shown, F.lit(")"))))


def embed_data_uri(content: Column, mime: Column, inline: Column | bool = True) -> Column:
    """``![Image](data:…)``, or an empty reference when bytes are not to be inlined."""
    inline = F.lit(inline) if isinstance(inline, bool) else inline
    return F.when(inline, F.concat(F.lit("![Image](data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""), F.lit(")"))).otherwise("![Image]()")


def decode_data_uri(url: Column) -> Column:
    """Bytes of a base64 data URI; null when it is not one or does not decode."""
    payload = F.regexp_extract(url, r"(?s)^data:.*?base64,(.*)$", 1)
    return F.when(F.rlike(url, F.lit(r"(?s)^data:.*?base64,")), F.try_to_binary(payload, F.lit("base64")))


def image_size(content: Column) -> Column:
    """``struct(width, height)`` from PNG, GIF and BMP headers; null for other codecs."""

    def number(first: int, n: int, little: bool) -> Column:
        order = range(first + n - 1, first - 1, -1) if little else range(first, first + n)
        return F.conv(F.concat(*[F.hex(F.substring(content, i + 1, 1)) for i in order]), 16, 10).cast("int")

    def size(w: Column, h: Column) -> Column:
        return F.struct(w.alias("width"), h.alias("height"))

    return (F.when(bytes_at(content, 0, b"\x89PNG\r\n\x1a\n"), size(number(16, 4, False), number(20, 4, False)))
            .when(has_signature(content, GIF), size(number(6, 2, True), number(8, 2, True)))
            .when(bytes_at(content, 0, b"BM"), size(number(18, 4, True), number(22, 4, True))))
