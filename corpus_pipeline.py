"""From raw documents to packed training sequences, in four stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet and reads it again as the
next one's docs. All but the last return the columns of documents.

quality   documents that the classifier scores below 0.5 go (learnt from labels of the documents at hand)
near      of each group of texts that link by word shingles the row with the smallest doc_id stays
secrets   secrets that are not widely copied examples are replaced in the text
packing   the remaining texts become token sequences: one row a piece, with its sequence and offset
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm.common import free_name, stored
from doclake.llm.jaccard import jaccard_components
from doclake.llm.quality import score_quality
from doclake.llm.queries_models import packed, quality_model
from doclake.llm.secrets import credential_like, redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.5 or more; repeated rows and rows without an id score by their text like others, null texts like empty ones.

    Whole texts of any length are scored; an empty table gives no rows; a column ``score`` of the input stays what it is.
    """
    given = {c: free_name(docs, f"{c}_given") for c in docs.columns if c.lower() == "score"}
    scored = score_quality(docs.withColumnsRenamed(given), "text", quality_model(spark, sf_dir, docs))
    return scored.where("score >= 0.5").select(*[F.col(given.get(c, c)).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that link, that with the least (doc_id, hash of the text); others of the id are judged by their own text.

    Rows without words link with nothing and stay. Rows without an id cannot stand for a group and stay. Of rows that repeat
    both id and text one stays. Texts of any length are taken whole; an empty table gives no rows; other columns may have any name and type.
    """
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    group = jaccard_components(keyed, key, "text").groupBy("id").agg(F.min("component_id").alias("group")).withColumnRenamed("id", key)
    least = keyed.where(words & F.col("doc_id").isNotNull()).groupBy(key).agg(F.min("doc_id").alias("doc_id"))  # one row a text
    first = least.join(group, key).groupBy("group").agg(F.min(F.struct("doc_id", key)).alias("first")).select("first.*")
    kept = keyed.where(words & F.col("doc_id").isNotNull()).join(first, ["doc_id", key], "left_semi").select(*keyed.columns)
    kept = kept.union(keyed.where(~words | F.col("doc_id").isNull()))
    rest = F.struct(*[c for c in docs.columns if c != "doc_id"])
    return kept.groupBy("doc_id", key).agg(F.min_by(rest, F.to_json(rest)).alias("row")).select("doc_id", "row.*").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows; texts that changed have their new length in n_chars.

    Runs that only their one owner tells apart are replaced if they look like credentials, so UUIDs, slugs and names stay. Null and
    empty texts stay; repeated rows change alike; texts of any length are taken whole; an empty table gives no rows; other columns may have any name.
    """
    was = free_name(docs, "_was")
    cleaned = redact(docs.withColumn(was, F.col("text")), "doc_id", "text", F.col("lang"), F.col("source"), owned=credential_like)
    changed = ~F.col("text").eqNullSafe(F.col(was))
    return cleaned.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: a null or empty text is the end token alone, longer texts than a sequence are cut, repeated rows are packed each.

    An empty table gives no rows; other columns are not read.
    """
    return packed(docs)


STAGES = [("quality", quality), ("near", near), ("secrets", secrets), ("packing", packing)]

#: SQL cannot express the trained classifier and the tokenizer. Tests hold the operators against brute force, each stage against planted
#: rows and the chain against its stages on a planted table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
