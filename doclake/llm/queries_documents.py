"""Registered queries over documents and pages, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm.jaccard import jaccard_components
from doclake.llm.secrets import ACCESS, ASSIGN, HEX, LONG, scan_secrets, span_text
from doclake.llm.sharding import even_tree, grown_tree, shard_rows
from doclake.llm.url_filters import filter_captures, url_host, validity_intervals
from doclake.llm.variants import spelling_variants
from doclake.plans.registry import table

SHARDS = 40


def op5_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(SHARDS)
    placed = shard_rows(table(spark, sf_dir, "documents"), "doc_id", "text", tree, grown_tree(tree))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")



# crc32 of lists of bytes, with its table of 256 remainders worked out first
CRC_TABLE = """crc_step(i, k, c) as (
  select i, 0, i::bigint from range(256) r(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_step where k < 8
), crc as materialized (select list(c order by i) as tab from crc_step where k = 8)"""


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes, over a row that holds ``tab`` of ``CRC_TABLE``."""
    data = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::bigint)"
    return f"xor(coalesce(list_reduce({data}, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::bigint), 4294967295), 4294967295)"


def _op5_sql() -> str:
    def tree(name: str, grown: bool) -> str:
        more = "union all select 'g40', 'g40/k0', 'g40/k0/40', 40" if grown else ""
        leaves = f"select 'r' || i // 10, 'r' || i // 10 || '/k' || i // 5 % 2, 'r' || i // 10 || '/k' || i // 5 % 2 || '/' || i, i from range({SHARDS}) t(i) {more}"
        return f"""{name}_leaf(region, rack, leaf, shard) as ({leaves}), {name}(parent, node, weight) as (
  select '', region, count(*)::double from {name}_leaf group by all union all select region, rack, count(*)::double from {name}_leaf group by all
  union all select rack, leaf, 1.0::double from {name}_leaf)"""

    def descend(name: str) -> str:
        steps, at = [], "select name, '' as node from k"
        for level in range(3):
            steps.append(f"{name}_{level} as materialized (select p.name, arg_max(t.node, (ln((('0x' || md5(p.name || '|' || t.node)[:13])::bigint + 1.0) / 4503599627370496.0) / t.weight, t.node)) as node "
                         f"from ({at}) p join {name} t on t.parent = p.node group by p.name)")
            at = f"select name, node from {name}_{level}"
        return ", ".join(steps)

    return f"""
with recursive {CRC_TABLE}, {tree('old', False)}, {tree('new', True)}, d as materialized (
  select doc_id, coalesce(doc_id::varchar, '') as name, octet_length(encode(coalesce(text, '')))::bigint + 16 as size, {crc_sql("coalesce(text, '')")} as text_crc32 from documents, crc
), k as (select distinct name from d), {descend('old')}, {descend('new')}
select doc_id, size, text_crc32, 'key' as law, split_part(o.node, '/', -1)::int as shard, split_part(g.node, '/', -1)::int as grown_shard,
  row_number() over (partition by o.node order by ('0x' || md5(name || '|' || text_crc32 || '|' || size)[:8])::bigint % 512, doc_id nulls first, text_crc32, size) - 1 as slot
from d join old_2 o using (name) join new_2 g using (name)
"""


def op1_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture of a day of its own, against lists whose dated entries name hosts and paths of the pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.pmod(F.col("page_id") * 7919, F.lit(365)))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    host = url_host(F.col("url"))
    entries = pages.where("url is not null and page_id is not null").select(
        F.when(F.pmod("page_id", F.lit(3)) == 0, "allow").otherwise("block").alias("list"),
        F.when(F.pmod("page_id", F.lit(2)) == 0, "host").otherwise("url").alias("kind"),
        F.when(F.pmod("page_id", F.lit(2)) == 0, host).otherwise(F.concat(host, path)).alias("pattern"),
        F.when(F.pmod("page_id", F.lit(7)) < 3, "remove").otherwise("add").alias("action"),
        F.pmod(F.col("page_id") * 104729, F.lit(365)).alias("day"))
    return filter_captures(captures, "url", "fetched", validity_intervals(entries))


OP1_SQL = r"""
with p as (
  select page_id, url, (((page_id * 7919) % 365) + 365) % 365 as fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) as path
  from pages
), days as (
  select case when page_id % 3 = 0 then 'allow' else 'block' end as list, case when page_id % 2 = 0 then 'host' else 'url' end as kind,
    case when page_id % 2 = 0 then host else host || path end as pattern, (page_id * 104729) % 365 as day,
    max(case when page_id % 7 < 3 then 'remove' else 'add' end) as action
  from p where url is not null group by all
), changes as (
  select * from (select *, coalesce(lag(action) over w, 'remove') as was from days window w as (partition by list, kind, pattern order by day)) where action <> was
), valid as (
  select * from (select *, lead(day) over (partition by list, kind, pattern order by day) as valid_to from changes) where action = 'add'
), keys as (
  select page_id, fetched, 'url' as kind, host || path as pattern from p where host <> ''
  union all
  select page_id, fetched, 'host', array_to_string(string_split(host, '.')[i:], '.')
  from (select *, unnest(range(1, greatest(len(string_split(host, '.')), 2))) as i from p where host <> '')
), met as (
  select k.page_id, v.list, v.pattern, v.day, count(*) over (partition by k.page_id) as n,
    row_number() over (partition by k.page_id order by length(v.pattern) desc, v.kind = 'url' desc, v.list = 'allow' desc, v.day desc) as rn
  from keys k join valid v on k.kind = v.kind and k.pattern = v.pattern and k.fetched >= v.day and (v.valid_to is null or k.fetched < v.valid_to)
)
select p.page_id, p.url, p.fetched, coalesce(m.list, 'pass') as verdict, m.list as matched_list, m.pattern as matched_pattern,
  m.day as listed_from, coalesce(m.n, 0) as n_active
from p left join met m on m.page_id = p.page_id and m.rn = 1
"""


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are sources, their repositories the languages in them."""
    found = scan_secrets(table(spark, sf_dir, "documents"), "doc_id", "text", F.col("lang"), F.col("source"))
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("base", F.filter("found", lambda x: x["kind"] < 3))

    def n(kind: int):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    def standing(name: str):
        return F.size(F.filter("found", lambda x: x["standing"] == name)).cast("long")

    return rows.select(F.col("id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                       F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"),
                       standing("live").alias("n_live"), standing("example").alias("n_example"))


def _op9_sql() -> str:
    def hits(kind: int, pattern: str, value: str, sound: str) -> str:
        p = pattern.replace("'", "''")
        return f"""
  select doc_id, lang, source, {kind} as kind, start, stop, value from (
    select *, sum(length(gap) + length(hit)) over (partition by doc_id order by pos) - length(hit) as start,
      sum(length(gap) + length(hit)) over (partition by doc_id order by pos) as stop, {value.format(p=p)} as value
    from (select doc_id, lang, source, unnest(regexp_extract_all(text, '{p}')) as hit, generate_subscripts(regexp_extract_all(text, '{p}'), 1) as pos,
            unnest(string_split_regex(text, '{p}')[:len(regexp_extract_all(text, '{p}'))]) as gap from d)) where {sound}"""

    return f"""
with d as (select doc_id, coalesce(text, '') as text, lang, source from documents), c as materialized (
  {hits(0, ASSIGN, "regexp_extract(hit, '{p}', 2)", "length(value) >= 6")} union all
  {hits(1, ACCESS, "hit", "length(value) >= 20")} union all
  {hits(2, HEX, "hit", "length(value) >= 24")} union all
  {hits(3, LONG, "hit", "regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')")}
), k as materialized (
  select * from c where kind < 3 or not exists (
    select 1 from c b where b.kind < 3 and b.doc_id = c.doc_id and b.start < c.stop and b.stop > c.start)
), o as (select value, count(distinct source) as owners from k group by value
), j as (select k.*, o.owners from k join o using (value) where kind < 3 or owners = 1
), g as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind) as spans,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind) filter (kind < 3) as base,
    count(*) filter (owners = 1) as n_live, count(*) filter (owners >= 3) as n_example
  from j group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from d left join g using (doc_id)
"""


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


OP7_SQL = r"""
with recursive w as materialized (
  select doc_id, list_filter(string_split_regex(regexp_replace(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
    '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents
), sets as materialized (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w
), texts as materialized (
  select min(doc_id) as rep, list_sort(s) as s, len(s) as n from sets where len(s) > 0 group by all
), items as materialized (select rep, n, unnest(s) as x from texts
), pairs as materialized (
  select a.rep as a, b.rep as b from items a join items b on a.x = b.x and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges as materialized (select a, b from pairs union select b, a from pairs
), reach as (select rep as a, rep as b from texts union select r.a, e.b from reach r join edges e on r.b = e.a
), root as (select a, min(b) as component_id from reach group by a)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(r.component_id, s.doc_id) as component_id
from sets s left join texts t on list_sort(s.s) = t.s and len(s.s) > 0 left join root r on r.a = t.rep
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), "doc_id", "text")


OP12_SQL = f"""
with recursive {CRC_TABLE}, r as materialized (
  select doc_id, run, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents) group by all
), h as materialized (select run, n, {crc_sql("coalesce(doc_id::varchar, '') || ':' || run")} as h from r, crc
), w as materialized (
  select word, sum(n)::bigint as n from (
    select case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from h) where length(word) >= 5 group by word having sum(n) >= 3
), k as materialized (select word, n, word[:i - 1] as x, word[i + 1:] as y from (select *, unnest(range(1, length(word) + 1)) as i from w)
), p as materialized (
  select a.word, b.word as near, b.n from k a join k b on a.x = b.x and a.y = b.y and a.word <> b.word
  union select k.word, w.word, w.n from k join w on k.x || k.y = w.word union select w.word, k.word, k.n from k join w on k.x || k.y = w.word
), g as materialized (select word, count(*) as n_near, first(near order by n desc, encode(near)) as best, max(n) as best_n from p group by word
), f as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * w.n then best end as form, case when best_n >= 2 * w.n then best_n end as form_n from w left join g using (word)
), t as (select word, word as root from f union all select t.word, f.form from t join f on f.word = t.root where f.form is not null
), last as (select t.word, t.root from t join f on f.word = t.root where f.form is null)
select f.word, f.form, last.root, f.n, f.n_near, f.form_n from f join last using (word)
"""


QUERIES = {"op1_temporal_url_filter": op1_temporal_url_filter, "op5_hash_tree_shards": op5_hash_tree_shards, "op7_jaccard_components": op7_jaccard_components,
           "op9_secret_ownership": op9_secret_ownership, "op12_spelling_variants": op12_spelling_variants}
ORACLES = {"op1_temporal_url_filter": OP1_SQL, "op5_hash_tree_shards": _op5_sql(), "op12_spelling_variants": OP12_SQL, "op7_jaccard_components": OP7_SQL, "op9_secret_ownership": _op9_sql()}
