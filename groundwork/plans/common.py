"""How the test tables play the platform's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, wide_table

# Sources whose documents only the ``restricted`` scope may read.
RESTRICTED = ("src4", "src9", "src14", "src19")

SQL_RESTRICTED = "source IN ('src4','src9','src14','src19')"
SQL_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """documents with an ACL; each document is one passage (its text has no blank lines)."""
    d = wide_table(spark, sf, "documents")
    acl = F.when(F.col("source").isin(*RESTRICTED), F.array(F.lit("restricted"))).otherwise(F.array(F.lit("public")))
    return d.withColumn("document_id", F.col("doc_id")).withColumn("passage_id", F.col("doc_id")).withColumn("acl", acl)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark items as questions; the longer ones are asked with the restricted scope."""
    b = table(spark, sf, "benchmark")
    wide = F.array(F.lit("public"), F.lit("restricted"))
    return b.select(
        F.col("item_id").alias("query_id"), "text",
        F.when(F.length("text") > 200, wide).otherwise(F.array(F.lit("public"))).alias("accessible"),
    )


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as stored vectors: four vectors make a document, ids give the order of arrival."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.expr("vec_id div 4").alias("document_id"),
        F.expr("vec_id div 4").alias("seq"), F.col("embedding").cast("array<double>").alias("vec"), "label",
    )
