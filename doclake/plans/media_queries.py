"""URLs, references and media, over page addresses and fragments derived from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.functions import urls as U
from doclake.operators import html as H
from doclake.operators import media as M
from doclake.plans.registry import duck, query, synth, table

BLOBS = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://github.com/o/r', page_id, '/blob/main/a.md')
 WHEN 1 THEN concat('https://github.com/o/r', page_id, '/tree/main') ELSE url END AS url FROM {pages}"""


@query("rewrite_blob_url", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://raw.githubusercontent.com/o/r' || page_id || '/main/a.md'
 WHEN 1 THEN 'https://github.com/o/r' || page_id || '/tree/main' ELSE url END AS url FROM pages""")
def rewrite_blob_url(spark, sf):
    return synth(spark, sf, BLOBS).select("page_id", U.rewrite_blob_url(F.col("url")).alias("url"))


REFS = """SELECT page_id, url, n, concat(CASE n WHEN 0 THEN '/a/./b/../c' WHEN 1 THEN 'rel.png' WHEN 2 THEN '?q=1' WHEN 3 THEN '#top'
 WHEN 4 THEN '//CDN.x.org/p' WHEN 5 THEN 'http://h.org' WHEN 6 THEN '../up' WHEN 7 THEN 'data:x,' ELSE 'mailto:a@b' END, '') AS ref
 FROM (SELECT page_id, url, explode(sequence(0, 8)) AS n FROM {pages})"""
DUCK_REFS = duck(REFS).replace("explode(sequence(0, 8))", "unnest(range(0, 9))")
ORIGIN = "regexp_extract(url, '^https?://[^/?#]+', 0)"
FOLDER = "regexp_extract(regexp_extract(url, '^[^?#]*', 0), '^(https?://[^/]+/(?:.*/)?)', 1)"


@query("resolve_url", f"""SELECT page_id, CAST(n AS INTEGER) AS n, CASE n WHEN 0 THEN {ORIGIN} || '/a/c' WHEN 1 THEN {FOLDER} || 'rel.png'
 WHEN 2 THEN regexp_extract(url, '^[^?#]*', 0) || '?q=1' WHEN 3 THEN regexp_extract(url, '^[^#]*', 0) || '#top'
 WHEN 4 THEN string_split(url, ':')[1] || '://cdn.x.org/p' WHEN 5 THEN 'http://h.org/'
 WHEN 6 THEN CASE WHEN {FOLDER} = {ORIGIN} || '/' THEN {ORIGIN} || '/up' ELSE regexp_replace({FOLDER}, '[^/]+/$', '') || 'up' END
 WHEN 7 THEN 'data:x,' ELSE 'mailto:a@b' END AS url FROM ({DUCK_REFS})""")
def resolve_url(spark, sf):
    return synth(spark, sf, REFS).select("page_id", "n", U.resolve_url(F.col("url"), F.col("ref")).alias("url"))


@query("classify_ref", f"""SELECT page_id, CAST(n AS INTEGER) AS n, CASE n WHEN 5 THEN 'remote' WHEN 7 THEN 'data' ELSE 'local' END AS kind FROM ({DUCK_REFS})""")
def classify_ref(spark, sf):
    return synth(spark, sf, REFS).select("page_id", "n", U.classify_ref(F.col("ref")).alias("kind"))


IMAGE_REFS = """SELECT page_id, concat(split_part(url, '#', 1), CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('#', page_id, 'x', page_id + 5)
 WHEN 2 THEN concat('#', page_id, 'pxx') WHEN 3 THEN concat('#x', page_id, '%') WHEN 4 THEN '#frag' ELSE '#x' END) AS url FROM {pages}"""


@query("parse_image_ref", """SELECT page_id, CASE WHEN page_id % 6 <> 4 THEN string_split(url, '#')[1] END AS base_url,
 CASE page_id % 6 WHEN 1 THEN page_id::VARCHAR WHEN 2 THEN page_id || 'px' END AS width,
 CASE page_id % 6 WHEN 1 THEN (page_id + 5)::VARCHAR WHEN 3 THEN page_id || '%' END AS height FROM pages""")
def parse_image_ref(spark, sf):
    src = synth(spark, sf, IMAGE_REFS).withColumn("r", U.parse_image_ref(F.col("url")))
    return src.select("page_id", "r.base_url", "r.width", "r.height")


ANCHORS = """WITH m AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs FROM pages),
 a AS (SELECT page_id, url, generate_subscripts(hrefs, 1) - 1 AS n, unnest(hrefs) AS ref FROM m)"""
PATH_OF = "regexp_replace(regexp_replace({0}, '^https?://[^/]+', ''), '[?#].*$', '')"


def _anchors(spark, sf):
    pages = table(spark, sf, "pages")
    links = H.html_links(pages, "page_id", "html").select("doc_id", "link_no", F.col("href").alias("ref"))
    return links


@query("resolve_local_ref", f"""{ANCHORS}, inv AS (SELECT DISTINCT {PATH_OF.format('url')} AS path FROM pages),
 r AS (SELECT page_id, n, CASE WHEN n % 2 = 0 THEN substring(ref, 2) ELSE ref END AS ref, '/' || substring(ref, 2, 1) || '/x.md' AS p FROM a
   UNION ALL SELECT page_id, -1, {PATH_OF.format('url')}, '/q/x.md' FROM pages
   UNION ALL SELECT page_id, -2, regexp_extract({PATH_OF.format('url')}, '[^/]*$', 0), regexp_replace({PATH_OF.format('url')}, '[^/]*$', '') || 'x.md' FROM pages)
SELECT page_id AS doc_id, CAST(n AS INTEGER) AS link_no, r.ref, coalesce(g.path, b.path) AS found FROM r LEFT JOIN inv g ON r.ref = g.path
 LEFT JOIN inv b ON CASE WHEN r.ref LIKE '/%' THEN r.ref ELSE regexp_replace(r.p, '[^/]*$', '') || r.ref END = b.path""")
def resolve_local_ref(spark, sf):
    pages = table(spark, sf, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), "[?#].*$", "")
    anchors = _anchors(spark, sf).select(
        "doc_id", "link_no", F.when(F.col("link_no") % 2 == 0, F.expr("substring(ref, 2)")).otherwise(F.col("ref")).alias("ref"),
        F.concat(F.lit("/"), F.substring("ref", 2, 1), F.lit("/x.md")).alias("doc_path"))
    own = pages.select(F.col("page_id").alias("doc_id"), F.lit(-1).alias("link_no"), path.alias("ref"), F.lit("/q/x.md").alias("doc_path"))
    near = pages.select(F.col("page_id").alias("doc_id"), F.lit(-2).alias("link_no"), F.regexp_extract(path, "[^/]*$", 0).alias("ref"),
                        F.concat(F.regexp_replace(path, "[^/]*$", ""), F.lit("x.md")).alias("doc_path"))
    refs = anchors.unionByName(own).unionByName(near)
    return M.resolve_local_ref(refs, pages.select(path.alias("path"))).select("doc_id", "link_no", "ref", "found")


@query("dedupe_refs", f"""{ANCHORS} SELECT page_id AS doc_id, CAST(n AS INTEGER) AS link_no, ref, length(ref) AS size FROM a""")
def dedupe_refs(spark, sf):
    return M.dedupe_refs(_anchors(spark, sf), "ref", lambda d: d.withColumn("size", F.length("ref"))).select(
        "doc_id", "link_no", "ref", "size")


MEDIA = """SELECT page_id, url, concat('<div style="width:', 400 + page_id % 100, 'px;height:300px"><p><img src="/a', page_id,
 '.png" width="50%" height="10%"></p></div><img src="b.png" width="20" height="', page_id % 70, '"><video src="v.mp4" style="max-width: 10em; height: 50vh">',
 '<source src="s.webm" width="3" height="2"></video><object type="image/svg+xml" data="o.svg" width="', page_id % 40, '" height="40"></object>',
 '<embed src="no.svg"><img src="c.png"><div style="aspect-ratio: 2; width: 600px"><section><img src="//cdn.x.org/d.png" width="10%" height="50%"></section></div>',
 '<img src="e.png" width="5rem" height="1.5vw"><img src="f.png" width="50%" height="oops">', html) AS html FROM {pages}"""
# (selector, pos, url, width, height)
MEDIA_ROWS = [
    (0, 2, "{o} || '/a' || page_id || '.png'", "CAST(floor(0.5 * (400 + page_id % 100)) AS BIGINT)", "30"),
    (0, 5, "{f} || 'b.png'", "20", "page_id % 70"),
    (1, 6, "{f} || 'v.mp4'", "140", "540"),
    (2, 7, "{f} || 's.webm'", "3", "2"),
    (3, 9, "{f} || 'o.svg'", "page_id % 40", "40"),
    (0, 12, "{f} || 'c.png'", "0", "0"),
    (0, 15, "string_split(url, ':')[1] || '://cdn.x.org/d.png'", "60", "150"),
    (0, 18, "{f} || 'e.png'", "70", "28"),
    (0, 19, "{f} || 'f.png'", "960", "0"),
]
CANDIDATES = " UNION ALL ".join(
    f"SELECT page_id AS doc_id, {s} AS selector_no, {p} AS pos, {u.format(o=ORIGIN, f=FOLDER)} AS url, CAST({w} AS BIGINT) AS width, CAST({h} AS BIGINT) AS height FROM pages"
    for s, p, u, w, h in MEDIA_ROWS)


@query("media_candidates", f"SELECT *, width * height AS area FROM ({CANDIDATES})")
def media_candidates(spark, sf):
    return M.media_candidates(synth(spark, sf, MEDIA), "page_id", "url", "html")


@query("element_dimensions", f"""SELECT doc_id, pos, width, height, width * height AS area FROM ({CANDIDATES})
 UNION ALL SELECT page_id, 11, 0, 0, 0 FROM pages""")
def element_dimensions(spark, sf):
    return M.element_dimensions(synth(spark, sf, MEDIA), "page_id", "html").select("doc_id", "pos", "width", "height", "area")


# the same page with starts and ends that have no partner before and inside it
BROKEN = MEDIA.replace("concat('<div style", "concat('</section></video><i width=\"9\" height=\"9\"><div width=\"9\" height=\"9\">', '<div style").replace(", html) AS html", ", '</section></p>', html) AS html")


@query("media_unpaired_tags", f"SELECT doc_id, selector_no, pos + 4 AS pos, url, width, height, width * height AS area FROM ({CANDIDATES})")
def media_unpaired_tags(spark, sf):
    return M.media_candidates(synth(spark, sf, BROKEN), "page_id", "url", "html")


@query("biggest_media", f"""WITH c AS (SELECT *, width * height AS area FROM ({CANDIDATES})),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY area DESC, selector_no DESC, pos DESC) AS rn FROM c)
 SELECT doc_id, url, area FROM r WHERE rn = 1""")
def biggest_media(spark, sf):
    return M.biggest_media(M.media_candidates(synth(spark, sf, MEDIA), "page_id", "url", "html"))


@query("size_policy", "SELECT doc_id FROM documents WHERE n_chars <= 50000")
def size_policy(spark, sf):
    return M.size_policy(table(spark, sf, "documents").select("doc_id", "n_chars"), F.col("n_chars"), "small").select("doc_id")
