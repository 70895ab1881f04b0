"""Ranks within groups of any size: fusion of differently scaled scores, and the best N of every group.

Groups are split by exact counts. A group is *heavy* when it holds more rows than a quarter of a task's fair share, so
there are at most ``4 * shuffle partitions`` heavy groups and their list may be broadcast. Heavy groups are salted and sorted by range over many
tasks; light ones go through ordinary windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.shared import cut, heat_join, partitions, same, stored

#: Groups of no more rows are light whatever the table's size; low, so that small tables take both ways too.
HEAVY_ROWS = 2_000


def heavy_groups(df: DataFrame, groups: list[str], least: int = HEAVY_ROWS) -> DataFrame | None:
    """The groups with more than max(least, rows / (4 * partitions)) rows, or None. Exact counts, combined before the shuffle."""
    spark = df.sparkSession
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    bound = max(least, total // (4 * partitions(spark)))
    rows = counts.filter(F.col("_n") > bound).select(*groups).collect()  # fewer than 4 * partitions rows
    return spark.createDataFrame(rows, df.select(*groups).schema) if rows else None


def _split(df: DataFrame, groups: list[str], heavy: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    if heavy is None:
        return df, None
    mark = F.broadcast(heavy)  # bounded, see heavy_groups
    return df.join(mark, same(df, mark, groups), "left_anti"), df.join(mark, same(df, mark, groups), "left_semi")


def _by_range(df: DataFrame, keys: list) -> DataFrame:
    """Rows sorted by range into partitions; ``_part`` keeps the partition's number, fixed by a checkpoint."""
    return cut(df.repartitionByRange(partitions(df.sparkSession), *keys).withColumn("_part", F.spark_partition_id()))


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int, least: int = HEAVY_ROWS) -> DataFrame:
    """The n best rows of every group: ``groups``, ``ties``, ``score`` and ``rank`` (bigint, from 1).

    Order: score descending, then the tie columns ascending (null first). Rows with null or NaN score take no part; rows that agree in groups and ties
    count once, with their best score; smaller groups give all they have; a null group key is a group of its own. Other columns are
    dropped, so their names cannot clash. An empty table gives none.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    if set(groups) & set(ties) or score in {*groups, *ties}:
        raise ValueError("group, tie and score columns must differ")
    rows = df.select(*groups, *ties, F.col(score).cast("double").alias(score)).filter(F.col(score).isNotNull() & ~F.isnan(score))
    heavy = heavy_groups(rows, groups, least)
    light, hot = _split(rows, groups, heavy)
    order = [F.col(score).desc(), *[F.col(t).asc() for t in ties]]
    best = Window.partitionBy(*groups).orderBy(*order)

    def once(x: DataFrame) -> DataFrame:
        return x.groupBy(*groups, *ties).agg(F.max(score).alias(score))

    def ranked(x: DataFrame) -> DataFrame:
        return x.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= n)

    out = ranked(once(light))
    if hot is not None:
        # Salts first: of each salt's share of a heavy group only the n best can be among the group's. What is left is sorted by range.
        share = Window.partitionBy(*groups, "_salt").orderBy(*order)
        salted = once(hot).withColumn("_salt", F.pmod(F.xxhash64(*ties), F.lit(4 * partitions(df.sparkSession))))
        leading = salted.withColumn("_place", F.row_number().over(share)).filter(F.col("_place") <= n).drop("_salt", "_place")
        ranged = _by_range(leading, [*[F.col(g) for g in groups], *order])
        sizes = ranged.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_n")
        # Only ranges that begin within the first n rows can hold a result: at most n of each heavy group.
        first = sizes.withColumn("_before", before).filter(F.col("_before") < n).select(*groups, "_part")
        out = out.unionByName(ranked(ranged.join(first, same(ranged, first, [*groups, "_part"]), "left_semi").drop("_part")))
    return out.select(*groups, *ties, score, "rank")


def ranked_scores(df: DataFrame, groups: list[str], score: str, least: int = HEAVY_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Every row with ``rank`` (bigint): 1 + the number of rows of its group with a larger score, so ties share a rank.
    counted: a table to count groups in, if df is costly and one of at least as many rows is at hand."""
    heavy = heavy_groups(df if counted is None else counted, groups, least)
    light, hot = _split(df, groups, heavy)
    place = Window.partitionBy(*groups).orderBy(F.col(score).desc())
    out = light.withColumn("rank", F.rank().over(place).cast("bigint"))
    if hot is not None:
        steps = hot.groupBy(*groups, score).agg(F.count(F.lit(1)).alias("_n"))
        ranged = _by_range(steps, [*[F.col(g) for g in groups], F.col(score).desc()])
        sizes = ranged.groupBy(*groups, "_part").agg(F.sum("_n").alias("_size"))
        sizes = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_size"))
        sizes = sizes.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_part").alias("_p"), "_before")
        meet = [ranged[g].eqNullSafe(sizes[f"_{g}"]) for g in groups]
        local = Window.partitionBy(*groups, "_part").orderBy(F.col(score).desc())
        placed = ranged.join(sizes, [*meet, ranged["_part"] == sizes["_p"]])
        placed = stored(placed.select(*groups, score, (F.sum("_n").over(local) - F.col("_n") + F.col("_before") + 1).cast("bigint").alias("rank")), "ranks")
        # One score may be that of a whole group: rows of such a score are dealt to many tasks.
        out = out.unionByName(heat_join(hot, placed, [*groups, score], least=least, nulls=True).select(*out.columns))
    return out


def fuse(df: DataFrame, questions: list[str], route: str, item: str, score: str, k: float = 60.0, least: int = HEAVY_ROWS) -> DataFrame:
    """Reciprocal rank fusion of all routes: ``questions``, ``item``, ``fused`` (double), ``routes`` (bigint).

    Items are ranked per question and route by their best score; only ranks enter, so the scale of a route's numbers cannot matter, and
    all routes weigh the same: fused = sum over routes of 1 / (k + rank). Equal scores share a rank. Null and NaN scores and null items don't count, repeated
    rows count once. The sum is rounded to 12 digits, so that its order of addition does not decide ties.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    rows = df.select(*questions, route, item, F.col(score).cast("double").alias(score))
    rows = rows.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull())
    best = rows.groupBy(*questions, route, item).agg(F.max(score).alias(score))
    ranks = ranked_scores(best, [*questions, route], score, least, counted=rows)
    total = F.round(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))), 12)
    return ranks.groupBy(*questions, item).agg(total.alias("fused"), F.count(F.lit(1)).alias("routes"))


def first_of(fused: DataFrame, questions: list[str], item: str) -> DataFrame:
    """The leading item of every question, ties by item ascending; an aggregate, so a hot question costs no task more than others."""
    best = F.min(F.struct((-F.col("fused")).alias("a"), F.col(item).alias("b")))["b"]
    return fused.groupBy(*questions).agg(best.alias(item))
