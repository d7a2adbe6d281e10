"""Media references of pages: candidates, declared sizes, the biggest one, and reference resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclake.functions.text import let
from doclake.functions.urls import drop_dots, resolve_url
from doclake.operators.tokens import attr, explode_tokens
from doclake.session import cluster_by

# Font size and viewport that relative units refer to, and the cap on embedded media.
FONT_PX = 14.0
VIEWPORT = {"width": 1920.0, "height": 1080.0}
SMALL_MEDIA_BYTES = 50_000
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _number(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(NUMBER)), text.try_cast("double"))


def _unit(text: Column) -> Column:
    return F.regexp_extract(text, r"(%|rem|em|vw|vh|px)$", 1)


def _amount(text: Column) -> Column:
    return _number(F.regexp_replace(text, r"(?:%|rem|em|vw|vh|px)$", ""))


def style_size(style: Column, side: str) -> Column:
    """First ``side`` or ``max-side`` declaration of a style attribute."""
    return F.nullif(F.trim(F.regexp_extract(style, rf"(?:^|;)\s*(?:max-)?{side}\s*:([^;]*)", 1)), F.lit(""))


def absolute_px(size: Column) -> Column:
    """Pixels of an absolute size; null for relative, unreadable or non-positive ones."""

    def px(s: Column) -> Column:
        unit, n = _unit(s), _amount(s)
        value = F.when(unit.isin("rem", "em"), n * FONT_PX).when(~unit.isin("%", "vw", "vh"), n)
        return F.when(value > 0, value)

    return let(F.trim(size), px)


def size_px(size: Column, parent: Column) -> Column:
    """Whole pixels of any size, relative ones against ``parent`` or the viewport."""

    def px(s: Column) -> Column:
        unit, n = _unit(s), F.coalesce(_amount(s), F.lit(0.0))
        value = (F.when(unit == "%", n / 100.0 * parent).when(unit.isin("rem", "em"), n * FONT_PX)
                 .when(unit == "vw", n / 100.0 * VIEWPORT["width"]).when(unit == "vh", n / 100.0 * VIEWPORT["height"]).otherwise(n))
        return F.floor(F.greatest(value, F.lit(0.0))).cast("bigint")

    return let(F.trim(size), px)


def _element_rows(df: DataFrame, id: str, html: str, *keep: str) -> DataFrame:
    """Opening tags with their element depth; a start or an end that finds no partner of its own tag nests nothing.

    A start has its partner where the running count of its tag later falls below what it was; an end has one unless it
    takes that count to a new low. The window that looks ahead runs backwards, so that its frame only grows.
    """
    pages = df.select(F.col(id).alias("doc_id"), F.col(html).alias("_markup"), *keep)
    tokens = explode_tokens(cluster_by(pages, "doc_id"), "_markup", "doc_id", *keep).filter("kind <> 'text'")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    by_tag, back = W.partitionBy("doc_id", "tag").orderBy("pos"), W.partitionBy("doc_id", "tag").orderBy(F.col("pos").desc())
    by_doc = W.partitionBy("doc_id").orderBy("pos")
    tokens = tokens.withColumn("step", step).withColumn("count", F.sum("step").over(by_tag))
    tokens = tokens.withColumn("low", F.least(F.lit(0), F.min("count").over(by_tag.rowsBetween(W.unboundedPreceding, -1))))
    tokens = tokens.withColumn("ahead", F.min("count").over(back.rowsBetween(W.unboundedPreceding, -1)))
    paired = F.when(F.col("kind") == "open", F.col("ahead") < F.col("count")).when(F.col("kind") == "close", F.col("count") >= F.col("low"))
    nests = F.when(F.coalesce(paired, F.lit(False)), F.col("step")).otherwise(0)
    video = F.when(F.col("tag") == "video", F.col("nests")).otherwise(0)
    return (tokens.withColumn("nests", nests).drop("count", "low", "ahead")
            .withColumn("depth", F.sum("nests").over(by_doc)).withColumn("in_video", F.sum(video).over(by_doc))
            .filter("kind <> 'close'"))


def element_dimensions(df: DataFrame, id: str, html: str, *keep: str) -> DataFrame:
    """``doc_id, pos, tag, raw, width, height, area`` of media elements.

    A percentage looks for the nearest ancestor with an absolute size. Every media element asks each level it is nested
    in for the element opened there last, one window per (document, level); no element is paired with another.
    """
    raw = F.col("raw")
    rows = _element_rows(df, id, html, *keep)
    style = attr(raw, "style", decode=False)
    sized = rows.withColumn("style", style)
    for side in ("width", "height"):
        sized = sized.withColumn(side, F.coalesce(attr(raw, side, decode=False), style_size(F.col("style"), side)))
    ratio = _number(F.trim(F.regexp_extract("style", r"(?:^|;)\s*aspect-ratio\s*:([^;]*)", 1)))
    sized = sized.withColumn("ratio", F.when(ratio > 0, ratio))
    for side, other in (("width", "height"), ("height", "width")):
        other_px = absolute_px(F.col(other))
        derived = other_px / F.col("ratio") if side == "height" else other_px * F.col("ratio")
        sized = sized.withColumn(f"{side}_px", F.coalesce(absolute_px(F.col(side)), derived))
    media = F.col("tag").isin("img", "video", "source", "object", "embed")
    relative = F.endswith(F.coalesce("width", F.lit("")), F.lit("%")) | F.endswith(F.coalesce("height", F.lit("")), F.lit("%"))
    # a sized container answers for its own level; a media element with a relative size asks all levels above it
    own = (F.col("kind") == "open") & (F.col("nests") == 1)
    above = F.when(F.col("kind") == "open", F.col("depth") - F.col("nests")).otherwise(F.col("depth"))
    asked = sized.withColumn("media", media).withColumn("levels", F.filter(F.concat(
        F.when(own, F.array("depth")).otherwise(F.slice(F.array("depth"), 1, 0)),
        F.when(media & relative & (above > 0), F.sequence(F.lit(1).cast("bigint"), above)).otherwise(F.slice(F.array("depth"), 1, 0))),
        lambda k: k > 0))
    asked = asked.select("doc_id", "pos", "tag", "raw", *keep, "in_video", "media", "width", "height", "width_px", "height_px",
                         own.alias("own"), "depth", F.explode_outer("levels").alias("k"))
    answers = F.col("own") & (F.col("k") == F.col("depth"))
    by_level = W.partitionBy("doc_id", "k").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    asked = asked.withColumn("up", F.last(F.when(answers, F.struct("width_px", "height_px")), ignorenulls=True).over(by_level))
    higher = F.col("k") < F.when(F.col("own"), F.col("depth")).otherwise(F.col("depth") + 1)
    found = asked.filter("media").groupBy("doc_id", "pos").agg(
        *[F.first(c).alias(c) for c in ("tag", "raw", *keep, "in_video", "width", "height")],
        *[F.max_by(F.when(higher, F.col(f"up.{s}_px")), F.when(higher & F.col(f"up.{s}_px").isNotNull(), F.col("k"))).alias(f"up_{s}")
          for s in ("width", "height")])
    both = F.col("width").isNotNull() & F.col("height").isNotNull()
    w, h = (F.when(both, size_px(F.col(s), F.coalesce(f"up_{s}", F.lit(VIEWPORT[s])))).otherwise(0).cast("bigint")
            for s in ("width", "height"))
    return found.select("doc_id", "pos", "tag", "raw", *keep, "in_video", w.alias("width"), h.alias("height")).withColumn(
        "area", F.col("width") * F.col("height"))


def media_candidates(df: DataFrame, id: str, base: str, html: str) -> DataFrame:
    """``doc_id, selector_no, pos, url, width, height, area``; unresolvable references are dropped."""
    rows = element_dimensions(df, id, html, base)
    raw, tag = F.col("raw"), F.col("tag")
    src, data, type_ = (attr(raw, a) for a in ("src", "data", "type"))
    rows = rows.withColumns({"src": src, "data": data, "type": type_})
    svg = F.col("type") == "image/svg+xml"
    selector = (F.when((tag == "img") & F.col("src").isNotNull(), 0).when((tag == "video") & F.col("src").isNotNull(), 1)
                .when((tag == "source") & F.col("src").isNotNull() & (F.col("in_video") > 0), 2)
                .when((tag == "object") & svg & F.col("data").isNotNull(), 3)
                .when((tag == "embed") & svg & F.col("src").isNotNull(), 4))
    return rows.withColumn("selector_no", selector).filter("selector_no IS NOT NULL").select(
        "doc_id", "selector_no", "pos", resolve_url(F.col(base), F.coalesce("src", "data")).alias("url"),
        "width", "height", "area").filter("url IS NOT NULL")


def biggest_media(candidates: DataFrame) -> DataFrame:
    """One winner per page, the last candidate on ties; a map-side combined aggregate, no sort of the group."""
    return candidates.groupBy("doc_id").agg(
        F.max_by(F.struct("url", "area"), F.struct("area", "selector_no", "pos")).alias("m")).select("doc_id", "m.url", "m.area")


def resolve_local_ref(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """``refs(doc_id, doc_path, ref)`` against ``inventory(path)``: as given, else next to the document with dot segments resolved, else null.

    ``found`` is the path that exists. The inventory is made distinct first, so the joins never multiply references,
    and a reference that a third of all documents share is split by the adaptive skew join.
    """
    files = inventory.select("path").distinct()
    folder = F.regexp_replace("doc_path", r"[^/]*$", "")
    # a folder without a root gets one for the time that dots are resolved
    joined = drop_dots(F.concat(F.lit("/"), folder, F.col("ref")))
    near = F.when(F.startswith("ref", F.lit("/")), drop_dots(F.col("ref"))).otherwise(F.expr("substring(_joined, 2)"))
    given = files.select(F.col("path").alias("_given"))
    beside = files.select(F.col("path").alias("_beside"))
    return (refs.withColumn("_joined", joined).withColumn("_near", near).drop("_joined").join(given, F.col("ref") == F.col("_given"), "left")
            .join(beside, F.col("_near") == F.col("_beside"), "left")
            .withColumn("found", F.coalesce("_given", "_beside")).drop("_near", "_given", "_beside"))


def dedupe_refs(refs: DataFrame, ref: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``work`` once per distinct reference and share the result with every occurrence."""
    distinct = refs.select(ref).filter(F.col(ref).isNotNull()).distinct()
    return refs.join(work(distinct), ref, "left")


def size_policy(df: DataFrame, size: Column, mode: str) -> DataFrame:
    """``none`` keeps nothing, ``all`` everything, other modes media up to 50,000 bytes."""
    if mode == "none":
        return df.filter(F.lit(False))
    return df if mode == "all" else df.filter(size <= SMALL_MEDIA_BYTES)
