"""Ranking metrics over questions and fused results, overall and by slice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.shared import cut, partitions, stored

CUTS = (1, 5, 10, 20)


def per_question(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per question with what the metrics need.

    questions: qid (unique), question_type, scope, expected (arrays), optional latency_ms. ranked: qid, rank, doc_id, source_type, tokens (of the chunk). Questions without results
    stay. first_rank: the rank of the first expected document, -1 if none. complete: all expected documents within ten. violated: a result of a source outside a scope.
    """
    gold = questions.select("qid", F.explode(F.array_distinct("expected")).alias("doc_id"))
    hit = ranked.join(gold, ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("first"), F.countDistinct(F.when(F.col("rank") <= 10, F.col("doc_id"))).alias("got"))
    scoped = ranked.join(questions.filter(F.size("scope") > 0).select("qid", "scope"), "qid")
    outside = scoped.groupBy("qid").agg(F.bool_or(~F.coalesce(F.array_contains("scope", F.col("source_type")), F.lit(False))).alias("outside"))
    context = ranked.filter("rank <= 10").groupBy("qid").agg(F.sum("tokens").alias("context"))
    latency = F.col("latency_ms").cast("double") if "latency_ms" in questions.columns else F.lit(None).cast("double")
    base = questions.select("qid", F.coalesce("question_type", F.lit("unknown")).alias("question_type"), "scope", F.array_distinct("expected").alias("expected"), latency.alias("latency_ms"))
    out = base.join(hit, "qid", "left").join(outside, "qid", "left").join(context, "qid", "left")
    return out.select(
        "qid", "question_type", "scope", (F.size("expected") > 0).alias("evaluable"), F.coalesce("first", F.lit(-1)).cast("bigint").alias("first_rank"),
        (F.coalesce("got", F.lit(0)) == F.size("expected")).alias("complete"), F.coalesce("outside", F.lit(False)).alias("violated"),
        F.coalesce("context", F.lit(0)).cast("bigint").alias("context_tokens"), "latency_ms",
    )


def _measures() -> list[Column]:
    able = F.count_if("evaluable")
    share = lambda c: F.round(F.try_divide(F.count_if(F.col("evaluable") & c), able), 6)
    hit = lambda k: share((F.col("first_rank") > 0) & (F.col("first_rank") <= k))
    inverse = F.when(F.col("evaluable") & (F.col("first_rank") > 0) & (F.col("first_rank") <= 10), 1.0 / F.col("first_rank")).otherwise(0.0)
    return [
        F.count("evaluable").alias("questions_total"), able.alias("questions_evaluable"), *[hit(k).alias(f"hit_at_{k}") for k in CUTS],
        F.round(F.try_divide(F.sum(inverse), able), 6).alias("mrr_at_10"), hit(10).alias("expected_doc_hit_at_10"), share(F.col("complete")).alias("all_expected_docs_hit_at_10"),
        F.count_if(~F.col("evaluable")).alias("no_gold_doc_count"), F.count_if("violated").alias("source_filter_violation_count"),
        F.lit(None).cast("double").alias("answer_contains_at_10"), F.lit(0).cast("bigint").alias("invalid_extra_docs_count"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("avg_latency_ms"),
        F.round(F.coalesce(F.avg("context_tokens"), F.lit(0.0)), 6).alias("avg_context_tokens"),
    ]


def nearest_rank(rows: DataFrame, groups: list[str], value: str, share: float = 0.95) -> DataFrame:
    """groups, value (double): of every group the smallest value that at least ``share`` of its values do not exceed. Nulls don't count; a group of nulls has no row.

    Exact, whatever a group's size: equal values are counted before the shuffle, counts are sorted by range over all tasks, and only the range in which the wanted
    place lies is added up row by row. No task holds a group.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie between 0 and 1")
    keys = [F.col(g) for g in groups]
    steps = rows.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    # Fixed by a checkpoint: ranges must be the same each time they are read.
    ranged = cut(steps.repartitionByRange(partitions(rows.sparkSession), *keys, F.col(value)).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*groups, "_part").agg(F.sum("_n").alias("_size"))
    # At most one row per group and range from here.
    whole, upto = Window.partitionBy(*groups), Window.partitionBy(*groups).orderBy("_part")
    wanted = sizes.withColumn("_place", F.ceil(F.sum("_size").over(whole) * F.lit(share) - 1e-9)).withColumn("_before", F.sum("_size").over(upto) - F.col("_size"))
    wanted = wanted.filter((F.col("_before") < F.col("_place")) & (F.col("_place") <= F.col("_before") + F.col("_size")))
    wanted = wanted.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"), "_place", "_before")
    meet = reduce(lambda a, b: a & b, (ranged[g].eqNullSafe(wanted[f"_g{i}"]) for i, g in enumerate(groups)), ranged["_part"] == wanted["_p"])
    inside = Window.partitionBy(*groups, "_part").orderBy(value)
    reached = ranged.join(wanted, meet).withColumn("_sum", F.sum("_n").over(inside) + F.col("_before")).filter(F.col("_sum") >= F.col("_place"))
    return reached.groupBy(*groups).agg(F.min(value).cast("double").alias(value))


def evaluate(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """slice_kind, slice and the measures: overall, by_question_type, by_source_type. A question counts once for each element of its scope, repeated ones included, and without scope as ``unknown``.
    Ratios are null where no question is evaluable; the overall row is there even without questions."""
    rows = per_question(questions, ranked)
    sources = F.when(F.size("scope") > 0, F.col("scope")).otherwise(F.array(F.lit("unknown")))
    named = lambda kind, name: F.struct(F.lit(kind).alias("slice_kind"), name.alias("slice"))
    slices = F.concat(
        F.array(named("overall", F.lit("all")), named("by_question_type", F.col("question_type"))), F.transform(sources, lambda s: F.struct(F.lit("by_source_type").alias("slice_kind"), s.alias("slice")))
    )
    # One row per question and slice: one grouping serves all, and it combines before its shuffle.
    each = stored(rows.withColumn("_s", F.explode(slices)).select("_s.*", "evaluable", "first_rank", "complete", "violated", "context_tokens", "latency_ms"), "judged")
    nobody = each.sparkSession.range(1).select(F.lit("overall").alias("slice_kind"), F.lit("all").alias("slice"))
    sums = each.unionByName(nobody, allowMissingColumns=True).groupBy("slice_kind", "slice").agg(*_measures())
    late = nearest_rank(each, ["slice_kind", "slice"], "latency_ms").select(F.col("slice_kind").alias("_k"), F.col("slice").alias("_s"), F.col("latency_ms").alias("p95_latency_ms"))
    out = sums.join(late, (sums["slice_kind"] == late["_k"]) & sums["slice"].eqNullSafe(late["_s"]), "left")
    return out.select(*[c for c in sums.columns if c != "avg_context_tokens"], F.coalesce("p95_latency_ms", F.lit(0.0)).alias("p95_latency_ms"), "avg_context_tokens")
