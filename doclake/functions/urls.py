"""URL and reference columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.text import let

# Code-host page that shows a file, and where its bytes live.
BLOB_PAGE = r"^.*github\.com.*[\\/]blob[\\/].*$"
# Fixed value: the generic URI pattern of RFC 3986, appendix B.
URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
# Fixed value: image reference with an optional #WxH size.
IMAGE_REF = r"^([^#]+)(?:#(\d+[a-z%]*)?x(\d+[a-z%]*)?)?$"


def rewrite_blob_url(url: Column) -> Column:
    raw = F.replace(F.replace(url, F.lit("github.com"), F.lit("raw.githubusercontent.com")), F.lit("/blob/"), F.lit("/"))
    return F.when(F.rlike(url, F.lit(BLOB_PAGE)), raw).otherwise(url)


def _parts(url: Column) -> Column:
    names = ["scheme", "authority", "path", "query", "fragment"]
    return F.struct(*[F.regexp_extract(url, URI, i + 1).alias(n) for i, n in enumerate(names)])


def _encode(text: Column) -> Column:
    """Percent-encode what a URL cannot hold literally; everything printable in ASCII stays."""
    runs = F.regexp_extract_all(text, F.lit(r"[!#-;=?-~]+|[^!#-;=?-~]+"), F.lit(0))
    enc = F.array_join(F.transform(runs, lambda r: F.when(F.rlike(r, F.lit("^[!#-;=?-~]")), r).otherwise(
        F.replace(F.url_encode(r), F.lit("+"), F.lit("%20")))), "")
    return F.when(F.rlike(text, F.lit(r"[^!#-;=?-~]")), enc).otherwise(text)


def drop_dots(path: Column) -> Column:
    """Path without `.` and `..` segments; it never leaves its root."""
    def step(acc: Column, seg: Column) -> Column:
        return F.when(seg == ".", acc).when(
            seg == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        ).otherwise(F.concat(acc, F.array(seg)))

    def walk(p: Column) -> Column:
        segs = F.split(p, "/")
        kept = F.aggregate(segs, F.slice(segs, 1, 0), step)
        tail = F.when(F.rlike(p, F.lit(r"/\.\.?$")), "/").otherwise("")
        return F.concat(F.array_join(kept, "/"), tail)

    return F.when(F.rlike(path, F.lit(r"/\.\.?(?:/|$)")), walk(path)).otherwise(path)


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute URL of ``ref`` on a page at ``base``; null when there is no usable result."""

    def join(s: Column) -> Column:
        b, r = s["base"], s["ref"]
        whole = (r["scheme"] != "") & (r["authority"] == "") & ~F.lower(r["scheme"]).isin("http", "https")
        same = r["authority"] == ""
        folder = F.regexp_replace(b["path"], r"[^/]*$", "")
        merged = F.when(folder == "", F.concat(F.lit("/"), r["path"])).otherwise(F.concat(folder, r["path"]))
        path = (F.when(~same | F.startswith(r["path"], F.lit("/")), r["path"])
                .when(r["path"] == "", b["path"]).otherwise(merged))
        query = F.when(same & (r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
        scheme = F.lower(F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"]))
        host = F.lower(F.when(same, b["authority"]).otherwise(r["authority"]))
        port = F.regexp_replace(host, r":80$", "")
        port = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(port)
        full = F.concat(scheme, F.lit("://"), port, let(F.when(path == "", "/").otherwise(path), lambda p: _encode(drop_dots(p))),
                        _encode(query), _encode(r["fragment"]))
        usable = scheme.isin("http", "https") & (host != "")
        return F.when(whole, s["raw"]).when(usable, full)

    return let(F.struct(_parts(base).alias("base"), _parts(F.trim(ref)).alias("ref"), F.trim(ref).alias("raw")), join)


def classify_ref(url: Column) -> Column:
    return (F.when(F.startswith(url, F.lit("data:")), "data")
            .when(F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://")), "remote").otherwise("local"))


def parse_image_ref(url: Column) -> Column:
    """``struct(base_url, width, height)``; null where the reference has another shape."""
    return F.when(F.rlike(url, F.lit(IMAGE_REF)), F.struct(
        F.regexp_extract(url, IMAGE_REF, 1).alias("base_url"),
        F.nullif(F.regexp_extract(url, IMAGE_REF, 2), F.lit("")).alias("width"),
        F.nullif(F.regexp_extract(url, IMAGE_REF, 3), F.lit("")).alias("height")))
