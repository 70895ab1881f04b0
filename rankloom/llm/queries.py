"""Queries of the training-data operators over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import normal_id
from rankloom.llm import language, markup, mixing, neardup, neighbours, packing, ranking, sql, token_budget
from rankloom.operators.current import current_rows
from rankloom.shared import stored, table


#: A public tokenizer's file; the query that uses it is there only if the file is.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = ranking.fuse(table(spark, sf_dir, "hits"), ["run_id", "qid"], "route", "doc_id", "score")
    return ranking.first_of(fused, ["run_id", "qid"], "doc_id")


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten leading documents of every question with their fused score."""
    fused = ranking.fuse(table(spark, sf_dir, "hits"), ["run_id", "qid"], "route", "doc_id", "score")
    return ranking.top_n(fused, ["run_id", "qid"], "fused", ["doc_id"], 10)


def _blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def _budget_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "docs").filter("doc_id is not null").select(
        F.col("doc_id").alias("key"), F.regexp_replace(F.lower(_blank(F.col("source_type"))), " ", "_").alias("source"),
        token_budget.language_slice(F.col("lang")).alias("language"), _blank(F.col("source_dataset")).alias("domain"), "text", F.col("line_no").alias("at"),
    )


def _budget_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id is not null").select(
        F.col("doc_id").cast("string").alias("key"), F.lower(_blank(F.col("source"))).alias("source"),
        token_budget.language_slice(F.col("lang")).alias("language"), F.lower(_blank(F.col("domain"))).alias("domain"), "text", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at"),
    )


SLICES = ["source", "language", "domain"]


def p2_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget of docs and documents after a first load of what had arrived at the start and an update to the whole tables by another object on the same folder."""
    out = None
    for name, rows in (("docs", _budget_docs(spark, sf_dir)), ("documents", _budget_documents(spark, sf_dir))):
        first = token_budget.TokenBudget(spark, SLICES)
        early = rows.agg(F.percentile_approx("at", 0.9)).collect()[0][0]
        first.update(rows.filter(F.col("at") <= F.lit(early)), order="at")
        budget = token_budget.TokenBudget(spark, SLICES, path=first.path)
        budget.update(rows, order="at")
        part = budget.report().select(F.lit(name).alias("corpus"), "level", *SLICES, "documents", "tokens")
        out = part if out is None else out.unionByName(part)
    return out


def p2_after_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget of docs after a first load, and a change feed that removes the documents of doc_tombstones."""
    rows = _budget_docs(spark, sf_dir)
    budget = token_budget.TokenBudget(spark, SLICES)
    budget.update(rows, order="at")
    gone = table(spark, sf_dir, "doc_tombstones").select(normal_id(F.col("doc_id")).alias("_gone")).filter("_gone <> ''").distinct()
    keys = rows.select("key").distinct().withColumn("_gone", normal_id(F.col("key")))
    budget.apply(rows.limit(0), keys.join(gone, "_gone", "left_semi").select("key"), order="at")
    return budget.report().select("level", *SLICES, "documents", "tokens")


def p2_public_tokens(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """The budget of documents in tokens of a public tokenizer, a JSON file."""
    budget = token_budget.TokenBudget(spark, SLICES, token_budget.file_tokenizer(f"file://{path or TOKENIZER}"))
    budget.update(_budget_documents(spark, sf_dir), order="at")
    return budget.report().select("level", *SLICES, "documents", "tokens")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(current_rows(table(spark, sf_dir, "docs"), "doc_id", "line_no", ["text", "lang"]), "current")
    return markup.clean_markup(docs, "doc_id", "text", "lang")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_kinds(_cleaned(spark, sf_dir), "doc_id")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir)


def _near_docs(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    docs = current_rows(table(spark, sf_dir, "docs"), "doc_id", "line_no", ["title", "text"])
    return neardup.NearDuplicates(docs, "doc_id", "text", "title", threshold=0.6, width=3)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_docs(spark, sf_dir).pairs().select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_docs(spark, sf_dir).classes().withColumnRenamed("id", "doc_id")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("chunk_key", "vector", "indexedAt")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest(_chunks(spark, sf_dir), table(spark, sf_dir, "vector_probes"), "chunk_key", "vector", latest="indexedAt")
    return near.select(F.least("query", "neighbour").alias("key_a"), F.greatest("query", "neighbour").alias("key_b")).distinct()


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: keys whose CRC is divisible by 100, against all rows."""
    chunks = _chunks(spark, sf_dir)
    return neighbours.nearest(chunks, chunks.filter(F.crc32("chunk_key") % 100 == 0), "chunk_key", "vector", latest="indexedAt")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.top_n(table(spark, sf_dir, "hits"), ["run_id", "qid", "route"], "score", ["doc_id", "chunk_id"], 5)
    return top.select("run_id", "qid", "route", "doc_id", "chunk_id")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.split_texts(_packed(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def _mixed(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).report().filter("short").select("plan_id", "source")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).report()


def p9_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).sequence()


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.shares(_passages(spark, sf_dir), "doc_id")
    return language.unstated(table(spark, sf_dir, "documents"), found, "doc_id", "lang")


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.shares(_passages(spark, sf_dir), "doc_id")


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).drop("text_chars")


def queries() -> dict:
    names = "p1_found p1_ranking p2_token_budget p2_after_removals p3_found p3_clean p4_found p4_classes p5_found p5_neighbours p6_found p8_found p8_containers p9_found p9_report p9_sequence p10_found p10_languages p10_passages"
    known = {n: globals()[n] for n in names.split()}
    return known | ({"p2_public_tokens": p2_public_tokens} if os.path.exists(TOKENIZER) else {})


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
