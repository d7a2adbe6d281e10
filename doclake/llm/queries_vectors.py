"""Registered queries over embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm.polytope import near_vectors
from doclake.llm.topk import top_k
from doclake.plans.registry import table

OP3_SQL = """
with recursive sound as materialized (
  select vec_id, embedding::double[] as v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as norm
  from embeddings where embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))
), pairs as materialized (
  select a.vec_id as a, b.vec_id as b from sound a, sound b
  where a.vec_id <> b.vec_id and a.norm > 0 and b.norm > 0 and len(a.v) = len(b.v)
    and list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
), reach as (
  select vec_id as a, vec_id as b from embeddings union select r.a, p.b from reach r join pairs p on r.b = p.a
), root as (select a, min(b) as component_id from reach group by a)
select e.vec_id, (select count(*) from pairs p where p.a = e.vec_id)::bigint as n_links, r.component_id, e.vec_id = r.component_id as kept
from embeddings e join root r on r.a = e.vec_id
"""

OP4_SQL = """
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on c.vec_id <> q.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0
)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored) where rank <= 10
"""


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


QUERIES = {"op3_cross_polytope_near_vectors": op3_near_vectors, "op4_exact_top_k": op4_exact_top_k}
ORACLES = {"op3_cross_polytope_near_vectors": OP3_SQL, "op4_exact_top_k": OP4_SQL}
