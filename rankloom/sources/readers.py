"""Readers for documents, access rows and questions, and for the driver-side settings of an index."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from rankloom.shared import read_text

DOC_SCHEMA = "doc_id string, title string, text string, source_path string, source_dataset string, source_type string"
_ACL_FIELDS = ("doc_id", "tenant_id", "classification", "allowed_group_ids", "denied_group_ids")


def text_list(value: Column) -> Column:
    """A JSON value as array<string>: a text becomes a list of one, a list keeps its elements as texts, anything else is an empty list."""
    bare = F.trim(F.coalesce(value, F.lit("")))
    listed = F.from_json(bare, ArrayType(StringType()))
    one = F.array(F.get_json_object(F.concat(F.lit('{"v":'), bare, F.lit("}")), "$.v"))
    none = F.array().cast("array<string>")
    return F.when(bare.startswith("["), F.coalesce(listed, none)).when(bare.startswith('"'), one).when(bare.isin("", "null") | bare.startswith("{"), none).when(
        bare.rlike(r"^(true|false|-?[0-9.eE+-]+)$"), none
    ).otherwise(F.array(bare))


def required(df: DataFrame, name: str) -> DataFrame:
    """The rows as they are; a null or blank value in the named column fails the query."""
    ok = F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) > 0
    return df.withColumn(name, F.when(ok, F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"missing {name} in "), F.to_json(F.struct("*"))))))


def read_docs(spark: SparkSession, path: str, limit: int = 0, done: int = 0) -> DataFrame:
    """Documents of JSON lines; a malformed line fails with its file, blank lines are skipped. limit: documents over all runs of which ``done`` are already taken, 0 for all."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    df = required(spark.read.schema(DOC_SCHEMA).option("mode", "FAILFAST").json(path), "doc_id")
    return df.limit(max(0, limit - done)) if limit else df


def stream_docs(spark: SparkSession, path: str, files: int = 20, broken: bool = False) -> DataFrame:
    """Documents as a stream of JSON-line files, so many files to a batch. A malformed line or a missing id fails the batch; with ``broken`` such lines stay, with
    their text in ``_broken`` (else null) and their file in ``_file``."""
    source = spark.readStream.option("maxFilesPerTrigger", files)
    if not broken:
        return required(source.schema(DOC_SCHEMA).option("mode", "FAILFAST").json(path), "doc_id")
    rows = source.schema(f"{DOC_SCHEMA}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    nameless = F.when(F.trim(F.coalesce("doc_id", F.lit(""))) == "", F.to_json(F.struct(*[c.split()[0] for c in DOC_SCHEMA.split(", ")])))
    return rows.withColumn("_broken", F.coalesce("_broken", nameless)).withColumn("_file", F.col("_metadata.file_path"))


def line_position(df: DataFrame, name: str) -> DataFrame:
    """Add where each row of a text table stands, as a struct that sorts by file name, then by place in the file, however files are split and dealt to tasks:
    rows of one split are read in order by one task."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn(name, place)


def read_acl(spark: SparkSession, path: str) -> DataFrame:
    """Access rows of JSON lines with lists coerced, and line_no, which grows with the file's name and along each file: the last row of a document counts. Name later
    deliveries so that they sort after earlier ones."""
    lines = line_position(spark.read.text(path), "line_no").filter(F.trim("value") != "").select("line_no", "value")
    fields = {f: F.get_json_object("value", f"$.{f}") for f in _ACL_FIELDS}
    known = F.from_json("value", StructType([StructField(f, StringType()) for f in _ACL_FIELDS]), {"mode": "FAILFAST"})
    rows = lines.select("line_no", known.alias("r"), *[fields[f].alias(f"_{f}") for f in _ACL_FIELDS])
    out = rows.select(
        "line_no", F.col("r.doc_id").alias("doc_id"), F.col("r.tenant_id").alias("tenant_id"), F.col("r.classification").alias("classification"),
        text_list(F.col("_allowed_group_ids")).alias("allowed_group_ids"), text_list(F.col("_denied_group_ids")).alias("denied_group_ids"),
    )
    return required(out, "doc_id")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """id, question, question_type, source_types, expected_doc_ids from a JSON array or an object with the field ``questions``."""
    whole = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("primitivesAsString", True).json(path)
    if "questions" in whole.columns:
        whole = whole.select(F.explode("questions").alias("q")).select("q.*")
    if not whole.columns:
        whole = whole.withColumn("id", F.lit(None).cast("string"))

    def field(name: str) -> Column:
        return F.col(name) if name in whole.columns else F.lit(None).cast("string")

    def listed(name: str) -> Column:
        none = F.array().cast("array<string>")
        if name not in whole.columns:
            return none
        kind = whole.schema[name].dataType.typeName()
        if kind == "array":
            return F.coalesce(F.col(name).cast("array<string>"), none)
        # Read as text where some rows hold a text and others a list.
        value = F.col(name).cast("string")
        return F.when(value.isNull(), none).when(value.startswith("["), F.coalesce(F.from_json(value, ArrayType(StringType())), none)).otherwise(F.array(value))

    return whole.select(
        F.coalesce(field("id"), F.lit("")).alias("id"), F.coalesce(field("question"), F.lit("")).alias("question"), F.coalesce(field("question_type"), F.lit("unknown")).alias("question_type"),
        listed("source_types").alias("source_types"), listed("expected_doc_ids").alias("expected_doc_ids"),
    )


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Add a dense number from 0 in reading order: one row per partition goes to the driver, no row moves."""
    placed = df.withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    sizes = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("n")).collect()
    before, total = {}, 0
    for task, n in sorted((r["_task"], r["n"]) for r in sizes):
        before[task], total = total, total + n
    pairs = [F.lit(x).cast("bigint") for pair in before.items() for x in pair]
    start = F.create_map(*pairs)[F.col("_task").cast("bigint")] if pairs else F.lit(0).cast("bigint")
    return placed.withColumn(name, start + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_task", "_row")


def normal_questions(raw: DataFrame) -> DataFrame:
    """Questions of a public benchmark: id = question_id, id or q_0001 and so on by order; a single expected document becomes a list; blank questions go."""
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    asked = raw.filter(F.trim(F.coalesce(has("question"), F.lit(""))) != "")
    ordered = numbered(asked, "_at") if {"question_id", "id"}.isdisjoint(raw.columns) or asked.filter(F.coalesce(has("question_id"), has("id")).isNull()).limit(1).count() else asked.withColumn("_at", F.lit(0))
    position = F.format_string("q_%04d", F.col("_at") + 1)
    listed = F.col("expected_doc_ids") if "expected_doc_ids" in raw.columns else F.lit(None)
    if "expected_doc_ids" not in raw.columns or raw.schema["expected_doc_ids"].dataType.typeName() != "array":
        value = listed.cast("string")
        listed = F.when(value.isNull(), F.array().cast("array<string>")).when(value.startswith("["), F.from_json(value, ArrayType(StringType()))).otherwise(F.array(value))
    ordered = ordered.withColumn("expected_doc_ids", F.coalesce(listed.cast("array<string>"), F.array().cast("array<string>")))
    return ordered.withColumn("id", F.coalesce(has("question_id"), has("id"), position)).withColumn("question_type", F.coalesce(has("question_type"), F.lit("unknown"))).drop("_at")


def export_corpus(docs: DataFrame, wanted: DataFrame, filler: int) -> DataFrame:
    """The documents that questions expect, and the first ``filler`` others by id: doc_id, title, text, source_type, source_path, expected.
    Blank ids and texts go; of repeated ids the first by text counts."""
    usable = docs.filter((F.trim(F.coalesce("doc_id", F.lit(""))) != "") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    once = usable.groupBy("doc_id").agg(F.min(F.struct("text", "title", "source_type")).alias("r")).select("doc_id", "r.*")
    need = wanted.select(F.col("doc_id").alias("_need")).distinct()
    marked = once.join(need, once["doc_id"] == need["_need"], "left").withColumn("expected", F.col("_need").isNotNull()).drop("_need")
    others = marked.filter("not expected").orderBy("doc_id").limit(filler)
    source = F.coalesce("source_type", F.lit("unknown"))
    path = F.concat_ws(":", F.lit("corpus"), source, F.col("doc_id"))
    return marked.filter("expected").unionByName(others).select("doc_id", F.coalesce("title", F.lit("")).alias("title"), "text", source.alias("source_type"), path.alias("source_path"), "expected")


def export_acl(exported: DataFrame, tenant: str, classification: str = "internal") -> DataFrame:
    """One access row per exported document: readable by everyone who may read its source."""
    groups = F.array(F.lit("role:admin"), F.lit("role:employee"), F.concat(F.lit("source:"), F.col("source_type")))
    none = F.array().cast("array<string>")
    return exported.select(
        "doc_id", F.lit(tenant).alias("tenant_id"), "source_type", F.lit(classification).alias("classification"), groups.alias("allowed_group_ids"), none.alias("denied_group_ids")
    )


def missing_expected(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Expected documents that the corpus lacks."""
    return wanted.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")


def read_manifest(path: str) -> dict:
    return json.loads(read_text(f"{path}/manifest.json"))
