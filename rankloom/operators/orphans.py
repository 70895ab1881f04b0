"""References to records that do not exist at the time of the reference.

Keys fall into hash ranges. Within a range they are numbered, and the keys that each table refers to in each month form a compressed bitmap of these numbers, as do the
keys that exist throughout a month. Reference AND NOT parent leaves the bits of keys that may be orphans in that month; only those are decoded and checked against exact times.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import normal_id
from rankloom.shared import HEAT_ROWS, heat_join, stored

#: Keys of a range in the mean. Their spread by the hash is about 150, so numbers fit 16 bits.
RANGE_KEYS = 24_576


class Bitmap:
    """A set of numbers below ``size`` as whichever of three containers is smallest: a sorted array, runs, or plain bits."""

    def __init__(self, numbers: np.ndarray, size: int):
        at = np.unique(numbers).astype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.size = size
        first = np.flatnonzero(np.concatenate([[True], np.diff(at.astype(np.int64)) != 1])) if len(at) else np.zeros(0, np.int64)
        width = at.itemsize
        self.kind = min((len(at) * width, "array"), (2 * len(first) * width, "runs"), (-(-size // 8), "bits"))[1]
        if self.kind == "array":
            self.data = at
        elif self.kind == "runs":
            self.data = np.stack([at[first], at[np.append(first[1:], len(at)) - 1]])
        else:
            mask = np.zeros(size, bool)
            mask[at] = True
            self.data = np.packbits(mask)

    def numbers(self) -> np.ndarray:
        if self.kind == "array":
            return self.data.astype(np.int64)
        if self.kind == "runs":
            first, last = self.data.astype(np.int64)
            sizes = last - first + 1
            return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.flatnonzero(np.unpackbits(self.data, count=self.size))


def _month(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def references(table_name: str, df: DataFrame, ref_id: Column, keys: Column, at: Column) -> DataFrame:
    """ref_table, ref_id, doc_id (normal form), at: one row per element of ``keys`` (an array) or per key; null and blank elements are no references."""
    kind = df.select(keys.alias("k")).schema["k"].dataType.typeName()
    each = F.explode(keys) if kind == "array" else keys
    out = df.select(ref_id.cast("string").alias("ref_id"), each.alias("_key"), at.alias("at"))
    return out.select(F.lit(table_name).alias("ref_table"), "ref_id", normal_id(F.col("_key")).alias("doc_id"), "at").filter("doc_id <> ''")


def _gaps(parents: DataFrame, removed: DataFrame) -> DataFrame:
    """key, gone, back: times from a deletion to the next arrival of the key (null: none). Deletions that end alike are one, from the first."""
    later = heat_join(parents, removed, ["key"]).filter(F.col("at") > F.col("gone")).groupBy("key", "gone").agg(F.min("at").alias("back"))
    spans = removed.distinct().join(later, ["key", "gone"], "left")
    return spans.groupBy("key", "back").agg(F.min("gone").alias("gone"))


def _survivors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one key range: for every table and month the keys of references AND NOT the keys that exist all month. pdf: key, kind, ref_table, month."""
    codes, keys = pd.factorize(pdf["key"])
    size = len(keys)
    maps = {name: Bitmap(codes[rows], size) for name, rows in pdf.groupby(["kind", "ref_table", "month"]).indices.items()}
    begin = sorted(((m, b) for (k, _, m), b in maps.items() if k == "begin"), key=lambda x: x[0])
    gap = {m: b for (k, _, m), b in maps.items() if k == "gap"}
    alive, i, out = np.zeros(size, bool), 0, []
    for (_, t, m), b in sorted(((name, b) for name, b in maps.items() if name[0] == "ref"), key=lambda x: (x[0][2], x[0][1])):
        while i < len(begin) and begin[i][0] <= m:
            alive[begin[i][1].numbers()] = True
            i += 1
        there = alive
        if m in gap:
            there = alive.copy()
            there[gap[m].numbers()] = False
        at = b.numbers()
        left = at[~there[at]]
        if len(left):
            out.append(pd.DataFrame({"ref_table": t, "month": m, "doc_id": keys[left]}))
    return pd.concat(out) if out else pd.DataFrame({"ref_table": [], "month": [], "doc_id": []})


def orphans(refs: list[DataFrame], parents: DataFrame, removed: DataFrame, range_keys: int = RANGE_KEYS, least: int = HEAT_ROWS) -> DataFrame:
    """ref_table, ref_id, doc_id, period, reason of references whose key is not there at their time; one row per combination.

    refs: tables made by ``references``. parents: key, at: every arrival of a record. removed: key, gone: deletions. Keys compare without blanks around and case.

    reason: ``missing`` if the key never arrives; else ``late`` if its first arrival is after the reference; else ``deleted`` if it was deleted at or before the reference and did not
    arrive again after that and up to the reference. Null and blank keys are no records and no references. A reference without time has a null period and is reported only
    as ``missing``; an arrival without time counts as there from the start; a deletion without time is none. Empty tables are fine.
    """
    all_refs = reduce(DataFrame.unionByName, refs).withColumn("period", F.date_format("at", "yyyy-MM"))
    parents = parents.select(normal_id(F.col("key")).alias("key"), "at").filter("key <> ''")
    removed = removed.select(normal_id(F.col("key")).alias("key"), "gone").filter("key <> '' and gone is not null")
    # A hot key is one row per table and month from here on.
    asked = all_refs.groupBy("doc_id", "ref_table", _month(F.col("at")).alias("month")).agg(F.count(F.lit(1)).alias("n")).drop("n")
    first = parents.groupBy("key").agg(F.when(F.count("at") < F.count(F.lit(1)), F.lit(None)).otherwise(F.min("at")).alias("first"))
    keys = asked.select(F.col("doc_id").alias("key")).union(first.select("key"))
    ranges = max(1, -(-int(keys.agg(F.approx_count_distinct("key", 0.02)).collect()[0][0] * 1.05) // range_keys))
    gaps = stored(_gaps(parents, removed), "gaps")
    limits = all_refs.agg(F.min(_month(F.col("at"))), F.max(_month(F.col("at")))).collect()[0]
    low, high = (limits[0] or 0), (limits[1] or 0)
    # From the first month that begins at or after the first arrival; months that touch a gap are left to the exact check.
    starts = F.when(F.col("first").isNull(), F.lit(low)).otherwise(_month(F.col("first")) + F.when(F.trunc(F.to_date("first"), "month").cast("timestamp") == F.col("first").cast("timestamp"), 0).otherwise(1))
    begin = first.select("key", F.lit("begin").alias("kind"), F.lit("").alias("ref_table"), F.greatest(starts, F.lit(low)).cast("int").alias("month")).filter(F.col("month") <= high)
    a, b = F.greatest(_month(F.col("gone")), F.lit(low)), F.least(F.coalesce(_month(F.col("back")), F.lit(high)), F.lit(high))
    gap = gaps.filter(a <= b).select("key", F.lit("gap").alias("kind"), F.lit("").alias("ref_table"), F.explode(F.sequence(a, b)).alias("month"))
    ref = asked.filter("month is not null").select(F.col("doc_id").alias("key"), F.lit("ref").alias("kind"), "ref_table", "month")
    # Each key, table and month is one row by now, so that ranges are alike in size; they move once.
    marks = ref.unionByName(begin).unionByName(gap).withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
    left = marks.groupBy("range").applyInPandas(lambda pdf: _survivors(pdf), "ref_table string, month int, doc_id string")
    # References without time stand in no month's bitmap; only a key that never arrives concerns them.
    untimed = asked.filter("month is null").join(first.select(F.col("key").alias("doc_id")), "doc_id", "left_anti").select("ref_table", "month", "doc_id")
    left = left.unionByName(untimed)
    doubtful = left.join(first.withColumn("there", F.lit(True)), left["doc_id"] == first["key"], "left").drop("key")
    doubtful = stored(doubtful.withColumn("month", F.coalesce("month", F.lit(-1))), "doubtful")
    rows = all_refs.withColumn("month", F.coalesce(_month(F.col("at")), F.lit(-1)))
    checked = heat_join(rows, doubtful, ["ref_table", "month", "doc_id"], least=least).select("ref_table", "ref_id", "doc_id", "period", "at", "first", "there")
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("first") > F.col("at"), "late")
    checked = checked.withColumn("reason", reason).distinct()
    sure = checked.filter("reason is not null")
    rest = heat_join(checked.filter("reason is null"), gaps.withColumnRenamed("key", "doc_id"), ["doc_id"], least=least)
    gone = rest.filter((F.col("gone") <= F.col("at")) & (F.col("back").isNull() | (F.col("at") < F.col("back")))).withColumn("reason", F.lit("deleted"))
    names = ["ref_table", "ref_id", "doc_id", "period", "reason"]
    return sure.select(*names).unionByName(gone.select(*names)).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """The number of orphan references and of their keys per table, period and reason."""
    return found.groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("references"), F.countDistinct("doc_id").alias("keys"))
