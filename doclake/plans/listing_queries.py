"""Listings, trees and bundles over page addresses and documents."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from doclake.operators import listing as L
from doclake.plans.registry import duck, query, synth, table

SITE = """SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
 concat(substring(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), 2), '/d', page_id % 3, '/f', page_id % 17, '.txt') AS path,
 url, html FROM {pages}"""
DSITE = duck(SITE)


SORTED = """SELECT page_id, concat(url, '/', page_id, '.t', page_id % 5) AS path, concat('t', page_id % 5) AS ext, page_id % 7 = 0 AS is_dir, length(html) AS size,
 timestamp '2024-01-01 00:00:00' + make_interval({days}) AS modified FROM {pages}"""
SORT_KEYS = {"name": ["lower(path)"], "size": ["size"], "time": ["modified"], "type": ["ext", "lower(path)"]}


def _sorted_sql() -> str:
    src = duck(SORTED.replace("make_interval({days})", "to_days(CAST((page_id * 13) % 90 AS INTEGER))"))
    return " UNION ALL ".join(
        f"SELECT '{mode}' AS mode, {str(back).upper()} AS reversed, page_id, CAST(row_number() OVER (ORDER BY CASE WHEN is_dir THEN 0 ELSE 1 END {way}, "
        f"{', '.join(f'{k} {way}' for k in keys)}, path) - 1 AS BIGINT) AS position FROM ({src})"
        for mode, keys in SORT_KEYS.items() for back, way in ((False, "ASC"), (True, "DESC")))


@query("list_sorted", _sorted_sql())
def list_sorted(spark, sf):
    src = synth(spark, sf, SORTED.replace("{days}", "0, 0, 0, cast((page_id * 13) % 90 as int)"))
    parts = [L.list_sorted(src, "path", "is_dir", "size", "modified", mode, back).select(F.lit(mode).alias("mode"), F.lit(back).alias("reversed"), "page_id", "position")
             for mode in SORT_KEYS for back in (False, True)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("grid_rows", """WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS n FROM part)
SELECT p_partkey, CAST(n // 6 AS BIGINT) AS grid_row, CAST(n % 6 AS INTEGER) AS grid_col FROM r""")
def grid_rows(spark, sf):
    src = table(spark, sf, "part").select("p_partkey", "p_name")
    return L.grid_rows(src, 6, F.col("p_name"), F.col("p_partkey")).select("p_partkey", "grid_row", "grid_col")


@query("common_root", f"""WITH s AS (SELECT host, string_split(path, '/') AS ps FROM ({DSITE})),
 d AS (SELECT host, list_slice(ps, 1, len(ps) - 1) AS dirs FROM s),
 e AS (SELECT host, min(dirs) AS lo, max(dirs) AS hi FROM d GROUP BY host),
 k AS (SELECT host, lo, hi, len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: list_slice(lo, 1, i) = list_slice(hi, 1, i))) AS n FROM e)
SELECT host, array_to_string(list_slice(lo, 1, n), '/') AS root FROM k""")
def common_root(spark, sf):
    return L.common_root(synth(spark, sf, SITE), "host", "path")


DUCK_NODES = f"""p AS (SELECT DISTINCT host, string_split(path, '/') AS ps FROM ({DSITE})),
 e AS (SELECT host, ps, unnest(range(1, len(ps) + 1)) AS d FROM p),
 nodes AS (SELECT host, list_slice(ps, 1, d) AS parts, max(d = len(ps)) AS is_file FROM e GROUP BY 1, 2),
 ranked AS (SELECT *, list_slice(parts, 1, len(parts) - 1) AS up, lead(parts[-1]) OVER (PARTITION BY host, list_slice(parts, 1, len(parts) - 1) ORDER BY parts[-1]) IS NULL AS is_last FROM nodes),
 guide AS (SELECT r.host, r.parts, string_agg(CASE WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY len(a.parts)) AS pre
   FROM ranked r JOIN ranked a ON r.host = a.host AND len(a.parts) < len(r.parts) AND list_slice(r.parts, 1, len(a.parts)) = a.parts GROUP BY 1, 2),
 tree AS (SELECT r.host, r.parts, r.is_file, coalesce(g.pre, '') || CASE WHEN r.is_last THEN '└── ' ELSE '├── ' END || r.parts[-1] ||
   CASE WHEN r.is_file THEN '' ELSE '/' END AS line FROM ranked r LEFT JOIN guide g ON r.host = g.host AND r.parts = g.parts)"""


@query("file_tree", f"WITH {DUCK_NODES} SELECT host AS group_key, array_to_string(parts, '/') AS node, is_file, line FROM tree")
def file_tree(spark, sf):
    return L.file_tree(synth(spark, sf, SITE), "host", "path").select(
        "group_key", F.array_join("parts", "/").alias("node"), "is_file", "line")


@query("path_listing", f"""WITH p AS (SELECT DISTINCT host || '/' || path AS path FROM ({DSITE})),
 e AS (SELECT string_split(path, '/') AS ps FROM p), x AS (SELECT DISTINCT list_slice(ps, 1, unnest(range(1, len(ps) + 1))) AS parts FROM e),
 y AS (SELECT parts, len(parts) - 1 AS depth, lead(len(parts) - 1) OVER (ORDER BY parts) AS nxt FROM x)
SELECT array_to_string(parts, '/') AS path, CAST(depth AS INTEGER) AS depth, depth > 0 AND coalesce(nxt < depth, TRUE) AS is_last,
 CASE WHEN depth = 0 THEN '' ELSE repeat('│   ', CAST(depth AS INTEGER) - 1) || CASE WHEN coalesce(nxt < depth, TRUE) THEN '└── ' ELSE '├── ' END END || parts[-1] AS line FROM y""")
def path_listing(spark, sf):
    src = synth(spark, sf, SITE).select(F.split(F.concat("host", F.lit("/"), "path"), "/").alias("ps"))
    rows = src.select(F.explode(F.expr("transform(sequence(1, size(ps)), d -> array_join(slice(ps, 1, d), '/'))")).alias("path"))
    return L.path_listing(rows, "path")


@query("bundle_documents", f"""WITH {DUCK_NODES}, f AS (SELECT host, path, arg_max(html, page_id) AS content FROM ({DSITE}) GROUP BY 1, 2)
SELECT host AS group_key, 0 AS section, '' AS key, '```file-tree' || chr(10) AS text FROM (SELECT DISTINCT host FROM f)
UNION ALL SELECT host, 1, array_to_string(parts, '/'), line || chr(10) FROM tree
UNION ALL SELECT host, 2, '', '```' || chr(10) || chr(10) FROM (SELECT DISTINCT host FROM f)
UNION ALL SELECT host, 3, path, '# File: ' || path || chr(10) || chr(10) || content || chr(10) || chr(10) FROM f""")
def bundle_documents(spark, sf):
    out = L.bundle_documents(synth(spark, sf, SITE), "host", "path", "html", F.col("page_id"))
    return out.select("group_key", "section", F.array_join("parts", "/").alias("key"), "text")


@query("concat_raw", """SELECT conv_id, CAST(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
 text AS content FROM conversations""")
def concat_raw(spark, sf):
    return L.concat_raw(table(spark, sf, "conversations"), "conv_id", F.col("turn"), "text")


@query("select_covered", f"""WITH s AS (SELECT DISTINCT host || '/' || path AS path FROM ({DSITE})),
 sel AS (SELECT regexp_extract(path, '^[^/]*', 0) AS p FROM s WHERE path LIKE '%a%.com%' UNION SELECT path FROM s WHERE path LIKE '%f7.txt'
  UNION SELECT regexp_extract(path, '^[^/]*/[^/]*', 0) FROM s WHERE path LIKE '%/f3.txt')
SELECT DISTINCT s.path FROM s JOIN sel ON s.path = sel.p OR starts_with(s.path, sel.p || '/')""")
def select_covered(spark, sf):
    files = synth(spark, sf, SITE).select(F.concat("host", F.lit("/"), "path").alias("path")).distinct()
    chosen = (files.filter("path LIKE '%a%.com%'").select(F.regexp_extract("path", "^[^/]*", 0).alias("path"))
              .union(files.filter("path LIKE '%f7.txt'"))
              .union(files.filter("path LIKE '%/f3.txt'").select(F.regexp_extract("path", "^[^/]*/[^/]*", 0))))
    return L.select_covered(files, chosen)


@query("ignore_filter", f"""WITH s AS (SELECT page_id, path FROM ({DSITE}))
SELECT page_id, path FROM s WHERE NOT regexp_matches(path, '(^|/)d1/') AND NOT (regexp_matches(path, '(^|/)f[0-5]\\.txt$') AND NOT regexp_matches(path, '/f3\\.txt$'))
  AND NOT starts_with(path, 'fr/')""")
def ignore_filter(spark, sf):
    files = synth(spark, sf, SITE).select("page_id", "path")
    return L.ignore_filter(files, ["# comment", "d1/", "f[0-5].txt", "!**/f3.txt", "/fr/**", "!d1/f3.txt"])


# (folder of the ignore file, its name, its lines): a rule of a folder below re-includes, one of the other name decides over both
IGNORES = [("{host}", ".gitignore", "# top\nd1/\nf[0-5].txt\n!f3.txt\n/fr/**\n"), ("{host}/en", ".gitignore", "!f1.txt\n/d2\n!d1/\n"), ("{host}/de", ".ignore", "f3.txt\n!f5.txt\n")]
IGNORE_ROWS = " UNION ALL ".join(
    f"SELECT DISTINCT concat({', '.join(q for q in ('host' if part == '{host}' else repr(part) for part in re.split('({host})', folder + '/' + name) if part))}) AS path, "
    f"concat({', chr(10), '.join(repr(line) for line in content.split(chr(10)))}) AS content FROM ({SITE})" for folder, name, content in IGNORES)


@query("ignore_rules", f"""WITH p AS (SELECT DISTINCT host || '/' || path AS path FROM ({DSITE})),
 e AS (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS d, string_split(path, '/') AS ps FROM p),
 x AS (SELECT DISTINCT path, array_to_string(list_slice(ps, 2, d), '/') AS rel, d < len(ps) AS is_dir FROM e WHERE d > 1),
 j AS (SELECT path, CASE
   WHEN starts_with(rel, 'de/') AND regexp_matches(rel, '(^|/)f5\\.txt$') THEN FALSE
   WHEN starts_with(rel, 'de/') AND regexp_matches(rel, '(^|/)f3\\.txt$') THEN TRUE
   WHEN starts_with(rel, 'en/') AND is_dir AND regexp_matches(rel, '/d1$') THEN FALSE
   WHEN rel = 'en/d2' THEN TRUE
   WHEN starts_with(rel, 'en/') AND regexp_matches(rel, '/f1\\.txt$') THEN FALSE
   WHEN starts_with(rel, 'fr/') THEN TRUE
   WHEN regexp_matches(rel, '(^|/)f3\\.txt$') THEN FALSE
   WHEN regexp_matches(rel, '(^|/)f[0-5]\\.txt$') THEN TRUE
   WHEN is_dir AND regexp_matches(rel, '(^|/)d1$') THEN TRUE ELSE FALSE END AS ignored FROM x)
SELECT path FROM p WHERE path NOT IN (SELECT path FROM j WHERE ignored)""")
def ignore_rules(spark, sf):
    """Ignore files at the top and in folders of every host."""
    files = synth(spark, sf, SITE).select(F.concat("host", F.lit("/"), "path").alias("path")).distinct()
    return L.ignore_by_rules(files, L.ignore_rules(synth(spark, sf, IGNORE_ROWS)))
