"""Places and sizes that operators share: the checkpoint folder, working tables, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StringType, StructField, StructType

#: A side is broadcast only after its bytes were summed and found to be no more than this.
BROADCAST_BYTES = 16 << 20

#: Working tables this process has written and not yet dropped.
_WORKING: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a local session gets a folder of its own; on a cluster that is an error, since
    executors would each write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rankloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage there: later reads survive a lost executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A new, empty place for a working table in the shared folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/rankloom-{name}-{uuid.uuid4().hex[:12]}"
    _WORKING.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a working table to the shared folder and read it back, with its column statistics."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(path: str) -> None:
    """Delete a working table that is no longer read."""
    fs, target = _file(path)
    fs.delete(target, True)


def release() -> None:
    """Drop the working tables of this process. Results are lazy and still read them, so call it once what is wanted has been written."""
    while _WORKING:
        drop_path(_WORKING.pop())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to at least three tasks a core, for maps whose work per row costs far more than moving the row: files or earlier
    exchanges may hold them in fewer or uneven parts."""
    spark = df.sparkSession
    return df.repartition(max(partitions(spark), 3 * spark.sparkContext.defaultParallelism))


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of all the named columns, with null equal to null."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def _width(kind: DataType, column: Column) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 24
    if isinstance(kind, ArrayType):
        each = F.lit(16) * F.size(column) if not isinstance(kind.elementType, StringType) else F.octet_length(F.array_join(column, "", "")) + F.lit(24) * F.size(column)
        return F.coalesce(F.greatest(each, F.lit(0)), F.lit(0)) + 24
    if isinstance(kind, StructType):
        return reduce(lambda a, b: a + b, (_width(f.dataType, column[f.name]) for f in kind), F.lit(16))
    return F.lit(16)


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the table's bytes, summed over all its rows, are within the limit. One aggregate; store a costly table first."""
    width = reduce(lambda a, b: a + b, (_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema), F.lit(16))
    return (df.agg(F.sum(width.cast("bigint"))).collect()[0][0] or 0) <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a table for broadcast if its bytes prove it small; else leave the choice to the planner."""
    return F.broadcast(df) if fits(df, limit) else df


#: A key with no more rows than this is left to one task whatever the table's size.
HEAT_ROWS = 50_000


def heat_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", least: int = HEAT_ROWS, limit: int = BROADCAST_BYTES, nulls: bool = False
) -> DataFrame:
    """left joined with right on equal keys, however hot a key of the left side is. how: inner, left, left_semi or left_anti.

    A right side whose bytes are few is broadcast. Else left keys are counted, and one with more than ``bound`` rows is dealt to as many salts as it needs by a hash of its rows; the right
    rows of such a key are copied once per salt. bound is at least a quarter of a task's fair share, so there are at most four hot keys per task and their list is
    bounded. Null keys meet nothing, or with ``nulls`` each other. Other columns of the two sides must differ in name.
    """

    def meet(a: DataFrame, b: DataFrame, names: list[str], kind: str) -> DataFrame:
        """b's columns of these names are not kept."""
        other = b.withColumnsRenamed({n: f"_right_{n}" for n in names})
        test = [a[n].eqNullSafe(other[f"_right_{n}"]) if nulls else a[n] == other[f"_right_{n}"] for n in names]
        return a.join(other, reduce(lambda x, y: x & y, test), kind).drop(*[f"_right_{n}" for n in names])

    if fits(right, limit):
        return meet(left, F.broadcast(right), keys, how)
    spark = left.sparkSession
    bound = max(least, left.count() // (4 * partitions(spark)))
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound).select(*keys, F.ceil(F.col("_n") / bound).cast("int").alias("_salts")).collect()
    if not hot:
        return meet(left, right, keys, how)
    mark = F.broadcast(spark.createDataFrame(hot, StructType([*left.select(*keys).schema, StructField("_salts", IntegerType())])))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = meet(left, mark, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("_salts")
    copied = meet(right, mark, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return meet(dealt, copied, [*keys, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(path: str) -> tuple:
    """A path's file system, whichever it is, and the path in it."""
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(path: str) -> bool:
    fs, target = _file(path)
    return fs.exists(target)


def rename(path: str, to: str) -> None:
    fs, source = _file(path)
    if not fs.rename(source, _file(to)[1]):
        raise OSError(f"{path} could not be moved to {to}")


def read_text(path: str) -> str:
    fs, target = _file(path)
    stream = fs.open(target)
    try:
        return SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """A whole file or none: written beside and moved into place."""
    fs, target = _file(path)
    _, part = _file(f"{path}.tmp")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be moved into place")
