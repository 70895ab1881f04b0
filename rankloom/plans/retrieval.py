"""From questions to fused rankings to metrics: all questions and routes in one plan."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.analysis import english_terms, standard_terms
from rankloom.functions.text import is_distinct_variant, keyword_query, token_count
from rankloom.operators import fusion, metrics, search
from rankloom.shared import stored

MODES = ("dense", "bm25", "hybrid")


@dataclass(frozen=True)
class RetrievalConfig:
    mode: str = "hybrid"
    retriever_k: int = 50
    dense_chunk_candidates: int = 500
    rrf_k: int = 60
    dense_weight: float = 0.5
    bm25_weight: float = 1.0
    keyword: bool = False
    keyword_weight: float = 1.25
    english: bool = False
    english_weight: float = 1.5
    top_k: int = 50
    k1: float = search.K1
    b: float = search.B
    tenant: str = "tenant_redwood"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if min(self.retriever_k, self.dense_chunk_candidates, self.top_k) <= 0 or self.rrf_k < 0:
            raise ValueError("k values must be positive, rrf_k at least 0")
        if min(self.dense_weight, self.bm25_weight, self.keyword_weight, self.english_weight) <= 0:
            raise ValueError("weights must be positive")


#: The four routes with the weights that served best.
FOUR_ROUTES = dict(rrf_k=10, dense_weight=0.75, bm25_weight=0.5, keyword=True, keyword_weight=1.25, english=True, english_weight=1.5)


def with_terms(chunks: DataFrame, english: bool = False) -> DataFrame:
    """Chunks with the term arrays of both fields; those of the English analyzer only where asked for."""
    out = chunks.withColumns({"title_terms": standard_terms(F.col("title")), "text_terms": standard_terms(F.col("text"))})
    return out.withColumns({"title_english_terms": english_terms(F.col("title")), "text_english_terms": english_terms(F.col("text"))}) if english else out


def each_route(questions: DataFrame, chunks: DataFrame, config: RetrievalConfig) -> list[tuple[str, Callable[[], DataFrame]]]:
    """The routes that the mode asks for, by name, each planned when called. questions: qid (unique), question, scope, vector. chunks: chunk_key, doc_id, title, text,
    tenant, source, allowed, denied, vector. The keyword route has only questions whose rewrite differs."""
    out: list[tuple[str, Callable[[], DataFrame]]] = []
    if config.mode != "bm25":
        out.append(("dense", lambda: search.dense(questions, chunks, config.retriever_k, config.dense_chunk_candidates, config.tenant, weight=config.dense_weight)))
    if config.mode != "dense":
        # Term arrays are made once, as a table: routes and statistics then read the columns they need.
        index = stored(with_terms(chunks, config.english).drop("title", "text", "vector"), "index")
        common = dict(k=config.retriever_k, k1=config.k1, b=config.b, tenant=config.tenant)
        plain, stemmed = {"title": 2.0, "text": 1.0}, {"title_english": 2.0, "text_english": 1.0}
        asked = questions.select("qid", "question", "scope")
        rewritten = asked.withColumn("rewritten", keyword_query(F.col("question"))).filter(is_distinct_variant(F.col("question"), F.col("rewritten")))
        out.append(("bm25", lambda: search.bm25(asked.withColumn("terms", standard_terms(F.col("question"))), index, plain, weight=config.bm25_weight, **common)))
        if config.keyword:
            out.append(("keyword", lambda: search.bm25(rewritten.withColumn("terms", standard_terms(F.col("rewritten"))), index, plain, route="keyword", route_ord=2, weight=config.keyword_weight, **common)))
        if config.english:
            out.append(("english", lambda: search.bm25(asked.withColumn("terms", english_terms(F.col("question"))), index, stemmed, route="english", route_ord=3, weight=config.english_weight, **common)))
    return out


def routes(questions: DataFrame, chunks: DataFrame, config: RetrievalConfig) -> DataFrame:
    """The hits of every route that the mode asks for."""
    return reduce(DataFrame.unionByName, [plan() for _, plan in each_route(questions, chunks, config)])


def retrieve(questions: DataFrame, chunks: DataFrame, config: RetrievalConfig, spent: dict | None = None) -> DataFrame:
    """qid, rank, doc_id, chunk_key, score of the fused ranking. A question with one route keeps that route's scores.
    The hits, at most k per question and route, are written first: fusion reads them twice, and a union of routes that are all partitioned by question
    must not be taken for a partitioned table itself. ``spent`` gets the seconds of every route and of fusion, which then run one after another, and the ranking is written."""
    if spent is None:
        return fusion.rrf(stored(routes(questions, chunks, config), "hits"), config.rrf_k, config.top_k, bypass=True)
    found, began = [], time.time()
    for name, plan in each_route(questions, chunks, config):
        found.append(stored(plan(), f"hits-{name}"))
        spent[name], began = time.time() - began, time.time()
    fused = stored(fusion.rrf(reduce(DataFrame.unionByName, found), config.rrf_k, config.top_k, bypass=True), "ranking")
    spent["fusion"] = time.time() - began
    return fused


def ranked_with_context(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """The fused ranking with what metrics and details need of its chunks; texts join after the top k, never before, and only those of ranked chunks are counted."""
    used = fused.select("chunk_key").distinct()
    parts = chunks.join(used, "chunk_key", "left_semi").select("chunk_key", F.col("source").alias("source_type"), "title", token_count(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))).alias("tokens"))
    return fused.join(parts, "chunk_key", "left")


def evaluate(questions: DataFrame, chunks: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Metrics overall and by slice. The fused ranking is written once, since gold, scopes and context each read it."""
    return metrics.evaluate(questions, ranked_with_context(stored(retrieve(questions, chunks, config), "ranking"), chunks))
