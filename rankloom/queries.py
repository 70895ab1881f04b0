"""Queries of the core over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom import embedding, sql
from rankloom.functions import text as T
from rankloom.functions.analysis import standard_terms
from rankloom.operators import acl, chunking, fusion, metrics, orphans, search
from rankloom.operators.current import current_rows
from rankloom.plans import retrieval
from rankloom.shared import fits, small, stored, table, work_path
from rankloom.sources import readers, sinks
from rankloom.streaming import ingest

TENANT = "tenant_redline"
CUT = 10


# --- Roles that the tables play.


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question id: rows of an id are repetitions, the last asked counts. Elements are trimmed, blank ones dropped; expected ids are in normal form."""
    rows = table(spark, sf_dir, "questions")
    columns = [c for c in rows.columns if c not in ("id", "asked_at")]
    last = F.max(F.struct("asked_at", *columns)).alias("r")
    kept = lambda c, f: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), f), lambda x: x.isNotNull() & (x != ""))
    return rows.filter("id is not null").groupBy("id").agg(last).select(
        F.col("id").alias("qid"), F.coalesce("r.question", F.lit("")).alias("question"), F.coalesce("r.question_type", F.lit("unknown")).alias("question_type"),
        kept(F.col("r.source_types"), F.trim).alias("scope"), kept(F.col("r.expected_doc_ids"), T.normal_id).alias("expected"),
    )


def chunks_of(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = (), keys: DataFrame | None = None) -> DataFrame:
    """The chunk table by key, each key once with the row of its latest indexing. only: the columns wanted, else all; keys: a table of the chunk_keys wanted, else all.

    Few keys come twice, and only their rows move, unless the keys themselves are too many for a broadcast."""
    made = {
        "doc_id": F.col("benchmarkDocId"), "title": F.coalesce("title", F.lit("")), "text": F.coalesce("textContent", F.lit("")), "tenant": F.coalesce("tenantId", F.lit("")),
        "source": F.coalesce("sourceType", F.lit("unknown")), "allowed": F.col("allowedGroupIds"), "denied": F.col("deniedGroupIds"), "vector": F.col("vector"),
    }
    names = [n for n in made if not only or n in only]
    raw = table(spark, sf_dir, "chunks").filter("chunk_key is not null")
    if keys is not None:
        raw = raw.join(small(keys), "chunk_key", "left_semi")
    rows = raw.select("chunk_key", "indexedAt", *[made[n].alias(n) for n in names])
    last = lambda df: df.groupBy("chunk_key").agg(F.max_by(F.struct(*names), F.struct("indexedAt")).alias("r")).select("chunk_key", "r.*")
    again = stored(raw.groupBy("chunk_key").count().filter("count > 1").select("chunk_key"), "again")
    if not fits(again):
        return last(rows)
    return rows.join(F.broadcast(again), "chunk_key", "left_anti").select("chunk_key", *names).unionByName(last(rows.join(F.broadcast(again), "chunk_key", "left_semi")))


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "docs"), "doc_id", "line_no", ["title", "text", "source_path", "source_dataset", "source_type"])


def route_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits table as rankings: per run, question and route the best score of every document, ranked by score, then document. qid is run and question.

    Ranks above 50 are left out before fusion, as a retriever of retriever_k = 50 would not have returned them; the README says how many.
    """
    rows = table(spark, sf_dir, "hits").filter("score is not null and not isnan(score)")
    best = rows.groupBy(F.concat_ws("/", "run_id", "qid").alias("qid"), "route", "route_ord", "doc_id").agg(F.max("score").alias("score"), F.max_by("chunk_id", F.struct("score", -F.col("chunk_id"))).alias("chunk_id"))
    order = Window.partitionBy("qid", "route").orderBy(F.col("score").desc(), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= 50)
    return ranked.select("qid", "route", "route_ord", F.lit(1.0).alias("weight"), "rank", "doc_id", F.format_string("%s:%05d", "doc_id", "chunk_id").alias("chunk_key"), "score")


def four_weights(hits: DataFrame) -> DataFrame:
    weight = F.when(F.col("route") == "dense", 0.75).when(F.col("route") == "bm25", 0.5).when(F.col("route") == "keyword", 1.25).otherwise(1.5)
    return hits.withColumn("weight", weight)


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions per run with the fused ranking of the hits table, ready for metrics. Latency is the time from hit_at to received_at."""
    raw = table(spark, sf_dir, "hits")
    fused = stored(fusion.rrf(four_weights(route_hits(spark, sf_dir)), 10, 50), "ranking")
    asked = raw.groupBy(F.concat_ws("/", "run_id", "qid").alias("run_qid"), F.col("qid").alias("_q")).agg(
        (F.max(F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("hit_at").cast("timestamp"))) / 1000.0).alias("latency_ms")
    )
    questions = asked.join(questions_of(spark, sf_dir).withColumnRenamed("qid", "_qid"), F.col("_q") == F.col("_qid")).select(
        F.col("run_qid").alias("qid"), "question_type", "scope", "expected", "latency_ms"
    )
    return questions, retrieval.ranked_with_context(fused, chunks_of(spark, sf_dir)).withColumn("doc_id", T.normal_id(F.col("doc_id")))


# --- Text functions.


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "docs").select("line_no", T.clean_text(F.col("text")).alias("cleaned"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks")
    own = F.sha2(F.encode(F.coalesce("textContent", F.lit("")), "UTF-8"), 256)
    return rows.select("chunk_key", own.alias("sha256"), (own == F.col("contentHash")).alias("same"))


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    passage = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "docs").select("line_no", T.token_count(passage).alias("tokens"))


def keyword_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "questions").withColumn("keywords", T.keyword_query(F.col("question")))
    return rows.select("id", "keywords", T.is_distinct_variant(F.col("question"), F.col("keywords")).alias("is_variant"))


def standard_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "docs").select(F.explode(standard_terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def embedding_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("chunk_key", F.sha2(chunking.passage(F.col("title"), F.col("textContent")), 256).alias("passage_sha256"))


# --- Ingest.


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(docs_of(spark, sf_dir).select("doc_id", "text"), size=400, overlap=80)


def chunk_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text", T.normal_id(F.col("source")).alias("source")), keep=("source",))
    return cut.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text_content")).alias("chars"), F.max("chunk_id").cast("bigint").alias("most"))


def chunk_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.build_chunks(docs_of(spark, sf_dir), table(spark, sf_dir, "acl_docs"))
    return made.select("chunk_key", "title", "source_type", "source_path", "source_dataset", "tenant_id", "classification", F.array_join("allowed", ",").alias("allowed"), F.array_join("denied", ",").alias("denied"), "content_hash")


def acl_join_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = chunking.with_acl(docs_of(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "acl_docs"))
    return full.select("doc_id", "tenant_id", "classification", F.array_join("allowed", ",").alias("allowed"), F.array_join("denied", ",").alias("denied"))


def acl_files_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access table delivered as three folders of JSON lines of unlike size, whose rows follow each other by file name and line; then the last row of every document."""
    folder = work_path(spark, "acl")
    rows = table(spark, sf_dir, "acl_docs").filter(F.trim("doc_id") != "")
    first, second = rows.agg(F.percentile_approx("line_no", F.array(F.lit(0.05), F.lit(0.3)), F.lit(10_000))).collect()[0][0]
    parts = (("a", F.col("line_no") <= first), ("b", (F.col("line_no") > first) & (F.col("line_no") <= second)), ("c", F.col("line_no") > second))
    for name, part in parts:
        rows.filter(part).orderBy("line_no").drop("line_no", "ingested_at").write.json(f"{folder}/{name}")
    last = chunking.last_acl(readers.read_acl(spark, f"{folder}/*"))
    return last.select("doc", "tenant_id", "classification", F.array_join("allowed", ",").alias("allowed"), F.array_join("denied", ",").alias("denied"))


def ingest_dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks")
    return rows.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("times"), F.max_by("contentHash", "indexedAt").alias("content_hash"), F.max("indexedAt").alias("indexed_at"))


def export_filler_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = questions_of(spark, sf_dir).select(F.explode("expected").alias("doc_id"))
    out = readers.export_corpus(docs_of(spark, sf_dir), wanted, 100)
    return out.select("doc_id", "source_type", "source_path", "expected")


def missing_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = questions_of(spark, sf_dir).select(F.explode("expected").alias("doc_id"))
    return readers.missing_expected(docs_of(spark, sf_dir).select(T.normal_id(F.col("doc_id")).alias("doc_id")), wanted)


def stream_ingest_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The docs table delivered as files in two halves and ingested in two runs, the second of which continues the first; then the chunk table."""
    folder = work_path(spark, "ingest")
    rows, acl_rows = table(spark, sf_dir, "docs"), table(spark, sf_dir, "acl_docs")
    half = rows.agg(F.floor((F.min("line_no") + F.max("line_no")) / 2)).collect()[0][0]
    acl_rows.filter(F.trim("doc_id") != "").orderBy("line_no").drop("line_no", "ingested_at").write.json(f"{folder}/acl")
    config = ingest.IngestConfig(f"{folder}/in/*", f"{folder}/acl", f"{folder}/index", "letters", 26, files_per_batch=200)
    sinks.create_index(config.index, config.model, config.dimension)
    for name, part in (("first", rows.filter(F.col("line_no") <= half)), ("second", rows.filter(F.col("line_no") > half))):
        current_rows(part, "doc_id", "line_no", ["title", "text", "source_path", "source_dataset", "source_type"]).write.json(f"{folder}/in/{name}")
        ingest.ingest(spark, config, embedding.Letters())
    letters = F.sha2(F.array_join(F.col("vector").cast("array<int>"), ","), 256)
    return ingest.read_index(spark, config.index).select("chunk_key", "doc_id", "source_type", "tenant_id", "content_hash", letters.alias("vector_hash"))


# --- Access.


def acl_visible_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each question with a scope sees. Chunks and scopes with equal access fields count as one row with a number before they meet."""
    asked = questions_of(spark, sf_dir).filter(F.size("scope") > 0).withColumn("scope", F.array_sort(F.array_distinct("scope")))
    scopes = asked.select("scope").distinct().withColumn("s", F.explode("scope"))
    kinds = chunks_of(spark, sf_dir).groupBy("tenant", "source", "allowed", "denied").agg(F.count(F.lit(1)).alias("n"))
    seen = scopes.join(kinds, scopes["s"] == kinds["source"]).filter(acl.visible(F.col("scope"), F.col("tenant"), F.col("source"), F.col("allowed"), F.col("denied"), TENANT))
    counts = seen.groupBy("scope").agg(F.sum("n").alias("visible_chunks"))
    return asked.join(counts, "scope", "left").select("qid", F.coalesce("visible_chunks", F.lit(0)).cast("bigint").alias("visible_chunks"))


def acl_unscoped_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = chunks_of(spark, sf_dir).count()
    return questions_of(spark, sf_dir).filter(F.size("scope") == 0).select("qid", F.lit(every).cast("bigint").alias("visible_chunks"))


# --- Retrieval.

ACCESS = ("doc_id", "tenant", "source", "allowed", "denied")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks with their term arrays, made once as a table: sizes, document frequencies and the search each read the columns they need."""
    return stored(retrieval.with_terms(chunks_of(spark, sf_dir, (*ACCESS, "title", "text"))).drop("title", "text"), "index")


def df_idf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = _indexed(spark, sf_dir)
    df, sizes = search.term_statistics(indexed, {"title": "title_terms", "text": "text_terms"})
    n = F.when(F.col("field") == "title", F.lit(float(sizes["title"][0]))).otherwise(F.lit(float(sizes["text"][0])))
    return df.select("field", "term", "df", F.round(F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def _bm25(spark: SparkSession, sf_dir: str, scoped: bool, keyword: bool = False) -> DataFrame:
    asked = questions_of(spark, sf_dir)
    if keyword:
        asked = asked.withColumn("rewritten", T.keyword_query(F.col("question"))).filter(T.is_distinct_variant(F.col("question"), F.col("rewritten"))).withColumn("question", F.col("rewritten"))
    asked = asked.select("qid", "scope", standard_terms(F.col("question")).alias("terms"))
    hits = search.bm25(asked, _indexed(spark, sf_dir), {"title": 2.0, "text": 1.0}, k=CUT, tenant=TENANT, scoped=scoped)
    return hits.select("qid", "rank", "doc_id", "chunk_key", "score")


def bm25_best_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, scoped=False)


def bm25_acl_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, scoped=True)


def bm25_keyword_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, scoped=True, keyword=True)


def bm25_english_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = retrieval.RetrievalConfig(mode="bm25", english=True, tenant=TENANT, retriever_k=CUT)
    hits = retrieval.routes(questions_of(spark, sf_dir), chunks_of(spark, sf_dir), config)
    return hits.filter("route = 'english'").select("qid", "rank", "doc_id", "chunk_key", "score")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "vector_probes").select("chunk_key").distinct()
    return chunks_of(spark, sf_dir, ("source", "vector"), keys).select(F.col("chunk_key").alias("qid"), "vector", F.array("source").alias("scope"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.dense(_probes(spark, sf_dir), chunks_of(spark, sf_dir, (*ACCESS, "vector")), k=CUT, k_chunks=500, scoped=False)
    return hits.select("qid", "rank", "doc_id", "chunk_key", "score")


def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.dense(_probes(spark, sf_dir), chunks_of(spark, sf_dir, (*ACCESS, "vector")), k=CUT, k_chunks=500, tenant=TENANT)
    return hits.select("qid", "rank", "doc_id", "chunk_key", "score")


def collapse_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "hits").filter("score is not null and not isnan(score)")
    best = F.min(F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("m")
    return rows.groupBy("run_id", "qid", "route", "doc_id").agg(best).select("run_id", "qid", "route", "doc_id", F.col("m.chunk_id").alias("chunk_id"), (-F.col("m.s")).alias("score"))


def route_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_hits(spark, sf_dir).select("qid", "route", "rank", "doc_id", "chunk_key")


def rrf_two_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = route_hits(spark, sf_dir).filter("route in ('dense', 'bm25')")
    return fusion.rrf(hits, 60, 20).select("qid", "rank", "doc_id", "chunk_key", "score")


def rrf_weighted_four_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(four_weights(route_hits(spark, sf_dir)), 10, 20).select("qid", "rank", "doc_id", "chunk_key", "score")


def rrf_single_route_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = route_hits(spark, sf_dir).filter("route in ('bm25', 'english')")
    return fusion.rrf(hits, 60, 20, bypass=True).select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


# --- Metrics.


def question_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_question(*_judged(spark, sf_dir)).select("qid", "question_type", "evaluable", "first_rank", "complete", "violated", "context_tokens", "latency_ms")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(*_judged(spark, sf_dir)).drop("answer_contains_at_10", "invalid_extra_docs_count")


def metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).filter("slice_kind = 'overall'").drop("slice_kind", "slice")


def metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).filter("slice_kind = 'by_question_type'").drop("slice_kind")


def metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).filter("slice_kind = 'by_source_type'").drop("slice_kind")


def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    late = metrics.nearest_rank(events, ["event_type"], "value").select(F.col("event_type").alias("_t"), F.col("value").alias("p95"))
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(late, counts["event_type"].eqNullSafe(late["_t"]), "left").select("event_type", "p95", "n")


def details_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, ranked = _judged(spark, sf_dir)
    nested = sinks.details(asked, ranked)
    return nested.select("qid", "evaluable", F.explode("ranked_documents").alias("d")).select("qid", "evaluable", F.col("d.rank").alias("rank"), F.col("d.doc_id").alias("doc_id"), F.col("d.chunk_key").alias("chunk_key"), F.col("d.source_type").alias("source_type"))


def _hybrid(spark: SparkSession, sf_dir: str, english: bool) -> DataFrame:
    chunks = chunks_of(spark, sf_dir).withColumn("vector", embedding.letter_counts(F.concat("title", F.lit("\n"), "text")))
    asked = questions_of(spark, sf_dir).withColumn("vector", embedding.letter_counts(F.col("question")))
    config = retrieval.RetrievalConfig(tenant=TENANT, **{**retrieval.FOUR_ROUTES, "english": english})
    return retrieval.evaluate(asked, chunks, config)


def hybrid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: questions by letter vectors and three BM25 routes over the chunk table, fused, measured overall and by slice."""
    return _hybrid(spark, sf_dir, True)


def hybrid_three_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without stems, so that SQL can follow all of it."""
    return _hybrid(spark, sf_dir, False).drop("answer_contains_at_10", "invalid_extra_docs_count")


# --- Orphans.


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, acl_docs = table(spark, sf_dir, "questions"), table(spark, sf_dir, "acl_docs")
    refs = [
        orphans.references("questions", questions, F.col("id"), F.col("expected_doc_ids"), F.col("asked_at")),
        orphans.references("acl_docs", acl_docs, F.col("line_no"), F.col("doc_id"), F.col("ingested_at")),
    ]
    parents = table(spark, sf_dir, "docs").select(F.col("doc_id").alias("key"), F.col("ingested_at").alias("at"))
    removed = table(spark, sf_dir, "doc_tombstones").select(F.col("doc_id").alias("key"), F.col("deleted_at").alias("gone"))
    return orphans.orphans(refs, parents, removed)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf_dir))


NAMES = """
clean_text content_hash token_count keyword_rewrite standard_term_counts embedding_input chunk_documents chunk_stats_by_source chunk_projection acl_join_defaults acl_files_last_wins
ingest_dedupe_last_wins export_filler_quota missing_gold stream_ingest_resume acl_visible_chunks acl_unscoped_bypass df_idf_stats bm25_best_fields bm25_acl_filtered bm25_keyword_route
bm25_english_route dense_topk dense_filtered collapse_best_chunk route_ranks rrf_two_route rrf_weighted_four_route rrf_single_route_bypass question_metrics
metrics_overall metrics_by_type metrics_by_source latency_p95 details_flat hybrid_metrics hybrid_three_routes p7_found p7_report
""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
