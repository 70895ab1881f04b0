"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rankloom.functions.text import normal_id, token_count
from rankloom.shared import heat_join, stored


def capped_mean(lam: float, most: int) -> float:
    """Mean of min(Poisson(lam), most): the sum over k < most of P(X > k)."""
    return float(most - _cumulative(lam, most).sum())


def _cumulative(lam: float, most: int) -> np.ndarray:
    """P(X <= k) for k = 0 .. most - 1."""
    if most <= 0:
        return np.zeros(0)
    k = np.arange(most)
    logs = np.cumsum(np.log(np.maximum(k, 1)))
    if lam <= 0:
        return np.ones(most)
    return np.minimum(1.0, np.cumsum(np.exp(k * math.log(lam) - lam - logs)))


def poisson_mean(rate: float, most: int) -> float:
    """The Poisson mean at which counts cut at ``most`` have the mean ``rate``; infinite where the rate reaches the cut."""
    if rate <= 0 or most <= 0:
        return 0.0
    if rate >= most:
        return math.inf
    low, high = rate, rate + 1.0
    while capped_mean(high, most) < rate and high < 1e6:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, most) < rate else (low, mid)
    return high


@F.pandas_udf(ArrayType(DoubleType()))
def _thresholds(rate: pd.Series, most: pd.Series) -> pd.Series:
    """P(X <= k) for k below the cut: a document's count is the number of these its random number reaches."""

    def one(r: float, m: float) -> list[float]:
        m = int(m) if m == m else 0
        lam = poisson_mean(r, m) if r == r else 0.0
        return [0.0] * m if math.isinf(lam) else [min(x, 1.0) for x in _cumulative(lam, m)]

    return pd.Series([one(r, m) for r, m in zip(rate, most, strict=True)])


@dataclass
class Mix:
    """plan: one row per plan and source of the targets. copies: one row per plan and document that is used."""

    plan: DataFrame
    copies: DataFrame

    def report(self) -> DataFrame:
        """Reached shares per plan and source; a source without documents or copies stays with zeros.

        ``short`` is read off the copies: every document of the source was repeated as often as allowed, and that is still less than needed.
        """
        got = self.copies.groupBy("plan_id", "source").agg(
            F.count(F.lit(1)).alias("documents_used"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_reached"), F.max("copies").alias("most_copies")
        )
        per_plan = got.groupBy("plan_id").agg(F.sum("tokens_reached").alias("plan_tokens"))
        zero = F.lit(0).cast("bigint")
        out = self.plan.select("plan_id", "source", "target_share", "max_repeats", "needed_tokens", "source_tokens").join(got, ["plan_id", "source"], "left")
        out = out.join(per_plan, "plan_id", "left")
        reached = F.coalesce("tokens_reached", zero)
        spent = (reached == F.col("max_repeats") * F.col("source_tokens")) & (F.col("needed_tokens") > reached.cast("double"))
        return out.select(
            "plan_id", "source", "target_share", "max_repeats", "needed_tokens", "source_tokens", spent.alias("short"),
            *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("documents_used", "copies", "most_copies", "tokens_reached")],
            F.coalesce(F.col("tokens_reached") / F.col("plan_tokens"), F.lit(0.0)).alias("actual_share"),
        )

    def sequence(self) -> DataFrame:
        """Every copy once, in a global order: sort by ``plan_id, order_key``. The sort is by range, over all tasks."""
        each = self.copies.select("plan_id", "source", "doc_id", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        return each.withColumn("order_key", F.xxhash64(F.lit("order"), "plan_id", "doc_id", "copy")).orderBy("plan_id", "order_key", "doc_id", "copy")


def mix(docs: DataFrame, targets: DataFrame, tokens: Column | None = None, seed: int = 0) -> Mix:
    """Replicate documents so that each plan's sources get their target shares of ``size_factor`` times all tokens.

    docs: doc_id, source, text (or ``tokens``, a column of sizes). targets: plan_id, source, target_share, max_repeats, size_factor.
    A source's rate is target_share * size_factor * all tokens / its own tokens. A document is repeated as often as a Poisson number of
    that rate says, made by inverting the distribution at a number in [0, 1) hashed from seed, plan and document, so a second run gives the same. Counts never exceed
    ``max_repeats``; the Poisson mean is raised so that the mean after the cut is the rate. Where the rate reaches the cut every document is repeated ``max_repeats`` times and the
    row is marked ``short`` when the need exceeds even that.

    Documents with null or blank source belong to no source and are left out of all totals. Null text counts no tokens. Null shares, factors and caps count as 0. Sources are
    compared without blanks around and case; a target's own spelling is kept. Repeated target rows stay apart only if they differ in plan or spelling: of equal ones the first
    by share counts. Rows of docs with equal doc_id get equal counts. Empty tables give zeros or no rows.
    """
    sized = docs.select(
        F.col("doc_id"), normal_id(F.col("source")).alias("_key"), (token_count(F.col("text")) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("bigint").alias("tokens")
    ).filter(F.col("_key") != "")
    sized = stored(sized, "sizes")  # texts are counted once
    stats = sized.groupBy("_key").agg(F.sum("tokens").alias("source_tokens"))
    everything = stats.agg(F.coalesce(F.sum("source_tokens"), F.lit(0))).collect()[0][0]  # one number
    wanted = targets.groupBy("plan_id", "source").agg(
        F.min(F.struct(
            (-F.coalesce(F.col("target_share").cast("double"), F.lit(0.0))).alias("share"),
            F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("most"),
            F.coalesce(F.col("size_factor").cast("double"), F.lit(0.0)).alias("factor"),
        )).alias("t")
    )
    wanted = wanted.select(
        "plan_id", "source", normal_id(F.col("source")).alias("_key"), (-F.col("t.share")).alias("target_share"), F.col("t.most").alias("max_repeats"), F.col("t.factor").alias("size_factor")
    )
    plan = wanted.join(stats, "_key", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)).cast("bigint"))
    plan = plan.withColumn("needed_tokens", F.col("target_share") * F.col("size_factor") * F.lit(float(everything)))
    plan = plan.withColumn("rate", F.when(F.col("source_tokens") > 0, F.col("needed_tokens") / F.col("source_tokens")).otherwise(0.0))
    steps = stored(plan.select("plan_id", "source", "_key", _thresholds("rate", "max_repeats").alias("_steps")), "steps")
    # One number a plan, so that plans draw apart; a source that holds a third of all documents is split over tasks where the plan is too large to be broadcast.
    number = F.concat_ws(":", F.lit(seed), "plan_id", "doc_id")
    chance = F.conv(F.substring(F.md5(number), 1, 13), 16, 10).cast("bigint").cast("double") / float(2**52)
    drawn = heat_join(sized, steps, ["_key"]).withColumn("_u", chance)
    copies = drawn.withColumn("copies", F.size(F.filter("_steps", lambda x: x <= F.col("_u"))).cast("bigint")).filter("copies > 0")
    return Mix(plan.drop("_key"), copies.select("plan_id", "source", "doc_id", "tokens", "copies"))
