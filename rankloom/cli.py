"""Commands: create-index, import, evaluate, export. Options are pairs of a name and a value; a name may come once."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import embedding
from rankloom.operators import acl
from rankloom.plans import retrieval
from rankloom.shared import release, stored
from rankloom.sources import readers, sinks
from rankloom.streaming import ingest


class _Once(argparse.Action):
    def __call__(self, parser, namespace, values, option_string=None):
        seen = getattr(namespace, "_seen", set())
        if self.dest in seen:
            parser.error(f"{option_string} comes twice")
        namespace._seen = seen | {self.dest}
        setattr(namespace, self.dest, values)


def _flag(value: str) -> bool:
    if value.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return value.lower() == "true"


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rankloom", allow_abbrev=False)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, needed: list[str], options: dict) -> None:
        p = commands.add_parser(name, allow_abbrev=False)
        for n in needed:
            p.add_argument(f"--{n}", required=True, action=_Once)
        for n, default in options.items():
            kind = _flag if isinstance(default, bool) else type(default)
            p.add_argument(f"--{n}", default=default, type=kind, action=_Once)

    service = {"embedding-url": "", "embedding-api-format": "local", "embedding-api-key": os.environ.get("EMBEDDING_API_KEY", ""), "embedding-query-instruction": ""}
    command("create-index", ["index", "embedding-model"], {"embedding-dimension": 2048, "bm25-k1": 2.2, "bm25-b": 1.0, "skip-existing": False})
    command(
        "import", ["docs", "acl-docs", "index"],
        {"embedding-model": "Qwen/Qwen3-Embedding-4B", "embedding-dimension": 2048, "chunk-size": 1200, "chunk-overlap": 200, "files-per-batch": 20, "max-documents": 0,
         "embedding-batch-size": 32, "max-retries": 3, "checkpoint": "", "dead-letters": False, "failure-log": "", "output": "", **service},
    )
    command(
        "evaluate", ["questions", "output", "details-output", "index"],
        {"embedding-model": "intfloat/multilingual-e5-small", "embedding-dimension": 384, "retrieval-mode": "hybrid", "retriever-k": 50, "dense-chunk-candidates": 500, "rrf-k": 60,
         "dense-weight": 0.5, "bm25-weight": 1.0, "keyword-bm25-enabled": False, "keyword-bm25-weight": 1.25, "english-bm25-enabled": False, "english-bm25-weight": 1.5, "top-k": 50,
         "tenant": acl.TENANT, **service},
    )
    command("export", ["docs", "questions", "output"], {"filler": 0, "tenant": acl.TENANT})
    return top


def _provider(a: argparse.Namespace) -> embedding.EmbeddingProvider:
    if a.embedding_model == "hashed":
        return embedding.HashedWords(a.embedding_dimension)
    return embedding.HttpEmbeddings(a.embedding_url, a.embedding_model, a.embedding_dimension, a.embedding_api_format, a.embedding_api_key, a.embedding_query_instruction, getattr(a, "max_retries", 3))


def _chunks(spark: SparkSession, index: str) -> DataFrame:
    return ingest.read_index(spark, index).select(
        "chunk_key", "doc_id", "title", F.col("text_content").alias("text"), F.col("tenant_id").alias("tenant"), F.col("source_type").alias("source"), "allowed", "denied", "vector"
    )


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    manifest = readers.read_manifest(a.index)
    if a.retrieval_mode != "bm25" and manifest["dimension"] != a.embedding_dimension:
        raise ValueError("the index has vectors of another dimension")
    config = retrieval.RetrievalConfig(
        a.retrieval_mode, a.retriever_k, a.dense_chunk_candidates, a.rrf_k, a.dense_weight, a.bm25_weight, a.keyword_bm25_enabled, a.keyword_bm25_weight,
        a.english_bm25_enabled, a.english_bm25_weight, a.top_k, manifest["k1"], manifest["b"], a.tenant,
    )
    asked = readers.read_questions(spark, a.questions).select(F.col("id").alias("qid"), "question", "question_type", F.col("source_types").alias("scope"), F.col("expected_doc_ids").alias("expected"))
    began, spent = time.time(), {}
    if a.retrieval_mode != "bm25":
        asked = stored(asked.withColumn("vector", embedding.embed_column(F.col("question"), _provider(a), "query")), "asked")  # a vector must be asked for once only
        spent["embedding"] = time.time() - began
    chunks = _chunks(spark, a.index)
    fused = retrieval.ranked_with_context(retrieval.retrieve(asked, chunks, config, spent), chunks)
    number = max(1, asked.count())
    _say({"event": "retrieval_progress", "completed": number, "total": number, "qps": round(number / max(0.001, time.time() - began), 2)})
    # All questions run at once: a latency is a route's time divided by the questions.
    mean = {f"{name}_latency_ms": round(1000 * spent.get(name, 0.0) / number, 6) for name in ("embedding", "dense", "bm25", "keyword", "english", "fusion")}
    asked = asked.drop("vector").withColumns({n: F.lit(v) for n, v in mean.items()} | {"latency_ms": F.lit(sum(mean.values()))})
    sinks.write_details(sinks.details(asked, fused), a.details_output)
    summary = retrieval.metrics.evaluate(asked, fused)
    label = f"source_acl_{a.retrieval_mode}"
    run = f"{label}-{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}"
    return sinks.write_summary(summary, a.output, {"index": a.index, "retrieval": label, "run_id": run, "seconds": round(time.time() - began, 3), **mean, **{k: v for k, v in vars(config).items()}})


def _export(spark: SparkSession, a: argparse.Namespace) -> dict:
    """docs, acl_docs, questions, missing_expected as folders of JSON lines, and source.json, which says what they hold."""
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(a.questions)
    raw = raw.select(F.explode("questions").alias("q")).select("q.*") if "questions" in raw.columns else raw
    asked = stored(readers.normal_questions(raw), "asked")
    docs = readers.read_docs(spark, a.docs)
    wanted = asked.select(F.explode("expected_doc_ids").alias("doc_id")).filter(F.trim("doc_id") != "").distinct()
    readers.export_corpus(docs, wanted, a.filler).write.json(f"{a.output}/docs")
    held = spark.read.schema("doc_id string, source_type string, expected boolean").json(f"{a.output}/docs")
    readers.export_acl(held, a.tenant).write.json(f"{a.output}/acl_docs")
    asked.write.json(f"{a.output}/questions")
    missing = stored(readers.missing_expected(held, wanted), "missing")
    missing.write.json(f"{a.output}/missing_expected")
    sums = held.agg(F.count(F.lit(1)), F.count_if("expected")).collect()[0]
    out = {"documents": sums[0], "filler": sums[0] - sums[1], "questions": asked.count(), "expected": wanted.count(), "found": sums[1], "missing": missing.count()}
    sinks.write_json(f"{a.output}/source.json", {"docs": a.docs, "questions_from": a.questions, **out})
    return out


def _say(event: dict) -> None:
    print(json.dumps(event, default=str), flush=True)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("rankloom").getOrCreate()
    try:
        if a.command == "create-index":
            out = {"index": a.index, "created": sinks.create_index(a.index, a.embedding_model, a.embedding_dimension, a.bm25_k1, a.bm25_b, a.skip_existing)}
        elif a.command == "import":
            config = ingest.IngestConfig(
                a.docs, a.acl_docs, a.index, a.embedding_model, a.embedding_dimension, a.chunk_size, a.chunk_overlap, a.files_per_batch, a.max_documents,
                a.embedding_batch_size, a.max_retries, a.checkpoint, a.dead_letters,
            )
            out = ingest.ingest(spark, config, _provider(a), a.failure_log or None, _say)
            if a.output:
                sinks.write_json(a.output, out)
        elif a.command == "evaluate":
            out = _evaluate(spark, a)
        else:
            out = _export(spark, a)
    finally:
        release()  # all results have been written by now
    _say(out)
    if a.command == "export" and out["missing"]:
        sys.exit(1)
    return out


if __name__ == "__main__":
    main()
