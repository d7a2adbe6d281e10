"""Registered queries over archives, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import warc
from doclake.llm.common import stored
from doclake.plans.registry import table
from doclake.session import work_dir


def op13_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as whole-file gzip streams, normalised, and read back, each record with its entry of the offset index."""
    streams, archives = work_dir(spark, "warc-streams"), work_dir(spark, "warc")
    warc.write_monolithic(warc.warc_records(table(spark, sf_dir, "pages"), "page_id", "url", "html"), streams)
    warc.normalize(spark, streams, archives)
    records = warc.resolve_revisits(stored(warc.record_facts(spark, archives), "warc-records"))

    def page(column: str):
        return F.nullif(F.regexp_extract(column, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")

    return records.select(page("record_id").alias("page_id"), "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


OP13_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages), d as (
  select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest from p
), h as (select payload_digest, max(page_id) as held from d where payload_bytes >= 1000 group by all)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when held is distinct from page_id and held is not null then 'revisit' else 'response' end as record_type,
  case when held is distinct from page_id then held end as refers_to
from d left join h using (payload_digest)
"""

QUERIES = {"op13_warc_normaliser": op13_warc_normaliser}
ORACLES = {"op13_warc_normaliser": OP13_SQL}
