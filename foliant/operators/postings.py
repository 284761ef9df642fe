"""Inverted index of character grams, and the coarse recall of similar documents over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import grams, squeeze
from foliant.session import spread


def document_grams(documents: DataFrame, n: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, grams): the distinct grams of each text that has any."""
    plain = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null"))
    return plain.select("doc_id", grams(squeeze(F.col("text")), n).alias("grams")).where(F.size("grams") > 0)


def postings(documents: DataFrame, n: int = 4, **columns: str) -> DataFrame:
    """(gram, doc_id), once for each document."""
    return document_grams(documents, n, **columns).select(F.explode("grams").alias("gram"), "doc_id")


def gram_frequency(index: DataFrame) -> DataFrame:
    """(gram, df): in how many documents a gram occurs. Counts are combined before the shuffle."""
    return index.groupBy("gram").agg(F.count("*").alias("df"))


def merge_frequency(old: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Document frequencies after an update: old ± the postings that came and went; grams at zero disappear."""
    delta = added.select("gram", F.lit(1).cast("long").alias("df")).unionByName(removed.select("gram", F.lit(-1).cast("long").alias("df")))
    return old.select("gram", F.col("df").cast("long").alias("df")).unionByName(delta).groupBy("gram").agg(F.sum("df").alias("df")).where("df > 0")


def coarse_recall(index: DataFrame, queries: DataFrame, max_df: int = 80, min_hits: int = 8, query_grams: int = 1200, top: int = 32) -> DataFrame:
    """(query_id, doc_id, hits, score, rank): the documents that share the rarest grams with a query.

    index: (gram, doc_id). queries: (query_id, grams). Grams in more than ``max_df`` documents don't vote: this is the
    operator's rule, and it also bounds what any gram can produce. A query votes with its first ``query_grams`` grams
    in lexical order. Score: the sum of 1 / df.
    """
    asked = queries.select("query_id", F.explode(F.slice(F.sort_array("grams"), 1, query_grams)).alias("gram"))
    wanted = index.join(asked.select("gram").distinct(), "gram", "left_semi")
    rare = gram_frequency(wanted).where(F.col("df") <= max_df)
    votes = asked.join(rare, "gram").join(wanted, "gram").where(F.col("query_id") != F.col("doc_id"))
    scored = votes.groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"), F.sum(1.0 / F.col("df")).alias("score")).where(F.col("hits") >= min_hits)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc("hits"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)
