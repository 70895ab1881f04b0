"""Overlapping chunks of long texts, and the chunk table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from rankloom.functions.text import clean_text, normal_id

SIZE, OVERLAP = 1200, 200
_BLANK = "".join(map(chr, range(33)))


def check_sizes(size: int, overlap: int) -> None:
    """An overlap beyond the earliest cut would never get ahead; such pairs are rejected."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap at least 0 and less than size")
    if overlap > int(size * 0.6):
        raise ValueError("overlap must not exceed 0.6 * size, else a chunk may begin where the last one did")


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of a cleaned text. Of the blanks and line ends in a window the last one ends the chunk, if it lies in the last two fifths;
    all finer separators end in one of these. Else the chunk ends with the window. The next one begins ``overlap`` characters before that end."""
    if not text.strip(_BLANK):
        return []
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    gaps = np.flatnonzero((raw == 32) | (raw == 10))
    out, start, least = [], 0, int(size * 0.6)
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            last = int(np.searchsorted(gaps, end)) - 1
            if last >= 0 and gaps[last] - start >= least:
                end = int(gaps[last]) + 1
        piece = text[start:end].strip(_BLANK)
        if piece:
            out.append(piece)
        if end >= len(text):
            return out
        start = end - overlap


def chunks_of(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<string> of a text's chunks after ``clean_text``; null and blank texts have none."""
    check_sizes(size, overlap)

    @F.pandas_udf(ArrayType(StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([split_text(t, size, overlap) for t in texts])

    return split(clean_text(text))


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, chunk_id (from 1), chunk_key, text_content and the kept columns."""
    each = docs.select(key, *keep, F.posexplode(chunks_of(F.col(text), size, overlap)).alias("_i", "text_content"))
    number = (F.col("_i") + 1).cast("int")
    return each.select(key, number.alias("chunk_id"), F.format_string("%s:%05d", F.col(key), number).alias("chunk_key"), *keep, "text_content")


def last_acl(acl: DataFrame) -> DataFrame:
    """The last row of every document (by line_no) with defaults: doc (normal id), tenant_id, classification, allowed, denied."""
    last = F.max(F.struct("line_no", "tenant_id", "classification", "allowed_group_ids", "denied_group_ids")).alias("r")
    rows = acl.withColumn("doc", normal_id(F.col("doc_id"))).filter("doc <> ''").groupBy("doc").agg(last)
    none = F.array().cast("array<string>")
    return rows.select(
        "doc", F.coalesce("r.tenant_id", F.lit("")).alias("tenant_id"), F.coalesce("r.classification", F.lit("")).alias("classification"),
        F.coalesce("r.allowed_group_ids", none).alias("allowed"), F.coalesce("r.denied_group_ids", none).alias("denied"),
    )


def with_acl(docs: DataFrame, acl: DataFrame) -> DataFrame:
    """Documents with their access rows; without one, empty texts and groups. Neither side is broadcast by hand: both grow."""
    rows = last_acl(acl)
    none = F.array().cast("array<string>")
    joined = docs.join(rows, normal_id(docs["doc_id"]) == rows["doc"], "left").drop("doc")
    for c in ("tenant_id", "classification"):
        joined = joined.withColumn(c, F.coalesce(c, F.lit("")))
    for c in ("allowed", "denied"):
        joined = joined.withColumn(c, F.coalesce(c, none))
    return joined


def build_chunks(docs: DataFrame, acl: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The chunk table of documents and access rows: every chunk with its document's fields, defaults and content hash."""
    full = with_acl(docs, acl).select(
        "doc_id", F.coalesce("title", F.lit("")).alias("title"), "text", F.coalesce("source_type", F.lit("unknown")).alias("source_type"),
        F.coalesce("source_path", F.lit("")).alias("source_path"), F.coalesce("source_dataset", F.lit("")).alias("source_dataset"), "tenant_id", "classification", "allowed", "denied",
    )
    keep = ("title", "source_type", "source_path", "source_dataset", "tenant_id", "classification", "allowed", "denied")
    out = chunk_documents(full, size=size, overlap=overlap, keep=keep)
    return out.withColumn("content_hash", F.sha2(F.encode("text_content", "UTF-8"), 256))


def passage(title: Column, text: Column) -> Column:
    """What an embedding model reads of a chunk."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
