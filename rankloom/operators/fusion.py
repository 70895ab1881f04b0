"""Weighted reciprocal rank fusion of routes, set-based."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(hits: DataFrame, rrf_k: int = 60, limit: int = 50, bypass: bool = False) -> DataFrame:
    """qid, rank, doc_id, chunk_key, score: score = sum of weight / (rrf_k + rank), larger first, ties by who is seen first in order of route and rank.

    hits: qid, route, route_ord, weight, rank, doc_id, chunk_key, score. A document that a route names twice adds up and keeps both places. Null and blank documents keep their place and are
    left out. The chunk is that of the first sight. ``bypass``: a question with hits of one route only keeps that route's order and its own scores.
    """
    if rrf_k < 0:
        raise ValueError("rrf_k must not be negative")
    if limit <= 0:
        raise ValueError("limit must be positive")
    positive = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.raise_error(F.lit("weights must be positive")))
    rows = hits.filter(F.trim("doc_id") != "").withColumn("_part", positive / (F.lit(rrf_k) + F.col("rank")))
    seen = F.struct("route_ord", "rank")
    fused = rows.groupBy("qid", "doc_id").agg(
        F.round(F.sum("_part"), 9).alias("score"), F.min(seen).alias("first"), F.min_by("chunk_key", seen).alias("chunk_key"), F.min_by("score", seen).alias("own")
    )
    order = [F.col("score").desc(), F.col("first")]
    if bypass:
        routes = rows.groupBy("qid").agg(F.min("route").alias("a"), F.max("route").alias("b")).select("qid", (F.col("a") == F.col("b")).alias("single"))
        fused = fused.join(routes, "qid").withColumn("score", F.when(F.col("single"), F.col("own")).otherwise(F.col("score")))
        order = [F.when(F.col("single"), F.col("first.rank")), F.col("score").desc(), F.col("first")]
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("bigint")
    return fused.withColumn("rank", place).filter(F.col("rank") <= limit).select("qid", "rank", "doc_id", "chunk_key", "score")
