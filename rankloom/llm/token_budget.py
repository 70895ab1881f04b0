"""Token totals per slice, kept up to date by signed deltas."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankloom.functions.text import TOKEN_PATTERN, token_count
from rankloom.shared import drop_path, exists, read_text, small, stored, work_path, write_text

LANGUAGES = "en de fr es pt zh".split()
# Three-letter codes and English names of the languages.
LANGUAGE_NAMES = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "fra": "fr", "fre": "fr", "french": "fr",
    "spa": "es", "spanish": "es", "por": "pt", "portuguese": "pt", "zho": "zh", "chi": "zh", "chinese": "zh",
}
NO_LANGUAGE = ["", "und", "unknown", "xx"]


def stated_languages(label: Column) -> Column:
    """The languages a label states, as a sorted array of codes: lists are split, case, region codes, three-letter codes and English
    names are understood. Null, blank, ``und``, ``unknown`` and ``xx`` state none; an unknown word stays as it is."""
    parts = F.split(F.lower(F.coalesce(label, F.lit(""))), r"[,;/+&|\s]+")
    stems = F.transform(parts, lambda p: F.regexp_extract(p, r"^([^_\-]*)", 1))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    known = F.transform(stems, lambda p: F.coalesce(names[p], p))
    return F.array_sort(F.array_distinct(F.filter(known, lambda p: ~p.isin(NO_LANGUAGE))))


def language_slice(label: Column) -> Column:
    """The stated languages joined by ``+``; null where none is stated."""
    found = stated_languages(label)
    return F.when(F.size(found) > 0, F.array_join(found, "+"))


def pattern_tokenizer() -> tuple[str, None]:
    """The project's own token: (hash, file)."""
    return hashlib.sha256(TOKEN_PATTERN.encode()).hexdigest()[:16], None


def file_tokenizer(path: str) -> tuple[str, str]:
    """A public tokenizer's JSON file on any file system, as (hash of its text, text): another file is another tokenizer. Tasks get the text, which is a few MB, and need no path."""
    text = read_text(path)
    return hashlib.sha256(text.encode()).hexdigest()[:16], text


def _counted(docs: DataFrame, model: str | None) -> DataFrame:
    """_content, text -> _content, tokens."""
    if model is None:
        return docs.select("_content", token_count(F.col("text")).alias("tokens"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sizes = [len(e) for e in tokenizer.encode_batch(part["text"].fillna("").tolist(), add_special_tokens=False)]
                yield pd.DataFrame({"_content": part["_content"].to_numpy(), "tokens": sizes})

    return docs.mapInPandas(encode, "_content string, tokens bigint")


class TokenBudget:
    """A count table by content and tokenizer, the state of every document, and a cube of totals, kept in a folder.

    ``update(rows)`` brings all three to a new snapshot, ``apply(changed, removed)`` to what a change feed says, without reading the other documents' texts. Only contents
    the table does not hold yet for this tokenizer are encoded. The cube changes by signed deltas: minus what a changed or removed document counted, plus what a changed or new
    one counts.

    Every change writes new files beside the old ones and then replaces ``state.json``, which names those that count; a change that fails half-way leaves the last state whole, and
    another object on the same ``path`` goes on from it. Documents are kept as segments, of each key the last one counts; segments and count tables are merged after
    ``MERGE`` changes. The state before the last one stays readable, older files are dropped.

    Columns of the rows: key, text, the slice columns named at creation and, if ``order`` names one, the column by which the last row of a
    key counts; else the largest content of a repeated key counts. Rows without key are dropped. Null text counts no tokens. Null
    slice values stay null (the unlabelled rest). Texts are hashed and counted where they are read and are not shuffled,
    unless more than ``small``'s bound of contents are new to a table that already holds some.
    """

    MERGE = 8

    def __init__(self, spark: SparkSession, slices: list[str], tokenizer: tuple[str, str | None] | None = None, path: str | None = None):
        self.spark, self.slices = spark, slices
        self.tokenizer, self.model = tokenizer or pattern_tokenizer()
        self.path = path or work_path(spark, "budget")
        self.state = {"slices": slices, "tokenizer": self.tokenizer, "version": 0, "counts": [], "docs": [], "cube": None, "old": []}
        if exists(f"{self.path}/state.json"):
            self.state = json.loads(read_text(f"{self.path}/state.json"))
            if self.state["slices"] != slices or self.state["tokenizer"] != self.tokenizer:
                raise ValueError("the budget was made for other slices or another tokenizer")

    @property
    def cube(self) -> DataFrame | None:
        return self._read([self.state["cube"]]) if self.state["cube"] else None

    def _write(self, df: DataFrame, name: str) -> str:
        name = f"{name}-{self.state['version'] + 1}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{n}") for n in names])

    def _table(self) -> DataFrame:
        return self._read(self.state["counts"]).filter(F.col("tokenizer") == self.tokenizer).select("_content", "tokens")

    def _current(self) -> DataFrame:
        """key and ``s``, the struct of slices, content and tokens, of every document that is there."""
        rows = self._read(self.state["docs"])
        return rows.groupBy("key").agg(F.max_by("s", "version").alias("s")).filter("s is not null")

    def _hashed(self, rows: DataFrame, order: str | None) -> DataFrame:
        """key and the struct of slices and content of its last row."""
        last = [F.col(order).alias("_o")] if order else []
        content = F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256).alias("_content")
        each = rows.filter(F.col("key").isNotNull()).select("key", *self.slices, *last, content)
        picked = F.max(F.struct(*[c for c in each.columns if c == "_o"], "_content", *self.slices)).alias("r")
        return each.groupBy("key").agg(picked).select("key", F.struct(*[F.col(f"r.{c}").alias(c) for c in (*self.slices, "_content")]).alias("n"))

    def update(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """Bring the budget to a whole snapshot: keys that it lacks are removed. Returns the cube."""
        now = self._hashed(rows, order)
        if not self.state["docs"]:
            changes = now.withColumn("o", F.lit(None).cast(self._kind(now)))
        else:
            old = self._current().select("key", F.col("s").alias("o"))
            # New and old of a key meet in one aggregate.
            both = now.unionByName(old, allowMissingColumns=True).groupBy("key").agg(F.max("n").alias("n"), F.max("o").alias("o"))
            changes = both.filter(~self._bare("n").eqNullSafe(self._bare("o")))
        return self._commit(changes, rows)

    def apply(self, changed: DataFrame, removed: DataFrame | None = None, order: str | None = None) -> DataFrame:
        """Take in a change feed: new and changed documents, and keys that went (column key). A key in both has changed. Returns the cube."""
        now = self._hashed(changed, order)
        touched = now.select("key")
        if removed is not None:
            touched = touched.union(removed.filter("key is not null").select("key")).distinct()
        changes = touched.join(now, "key", "left")
        if self.state["docs"]:
            # Few touched keys are broadcast: then the documents are scanned and not shuffled.
            keys = small(stored(touched, "touched"))
            old = self._read(self.state["docs"]).join(keys, "key", "left_semi").groupBy("key").agg(F.max_by("s", "version").alias("o"))
            changes = changes.join(old, "key", "left").filter(~self._bare("n").eqNullSafe(self._bare("o")))
        else:
            changes = changes.withColumn("o", F.lit(None).cast(self._kind(now))).filter("n is not null")
        return self._commit(changes, changed)

    def _kind(self, now: DataFrame) -> StructType:
        return StructType([*now.schema["n"].dataType.fields, StructField("tokens", LongType())])

    def _bare(self, side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.struct(*[F.col(f"{side}.{c}") for c in (*self.slices, "_content")]))

    def _commit(self, changes: DataFrame, rows: DataFrame) -> DataFrame:
        """changes: key, n and o: the document as it is now and as it was, null for absent."""
        state, version = {**self.state}, self.state["version"] + 1
        changes = stored(changes, "changes")
        fresh = changes.filter("n is not null").select("n._content").distinct()
        text = F.coalesce(F.col("text"), F.lit(""))
        texts = rows.filter(F.col("key").isNotNull()).select(F.sha2(F.encode(text, "UTF-8"), 256).alias("_content"), text.alias("text"))
        counts = list(state["counts"])
        if counts:
            unseen = stored(fresh.join(self._table().select("_content"), "_content", "left_anti"), "unseen")
            texts = texts.join(small(unseen), "_content", "left_semi")
        new = _counted(texts, self.model).groupBy("_content").agg(F.max("tokens").alias("tokens")).withColumn("tokenizer", F.lit(self.tokenizer))
        counts.append(self._write(new, "counts"))
        sized = self._read(counts).filter(F.col("tokenizer") == self.tokenizer).select("_content", "tokens")
        placed = changes.withColumn("_content", F.col("n._content")).join(sized, "_content", "left")
        full = F.when(F.col("n").isNotNull(), F.struct(*[F.col(f"n.{c}") for c in (*self.slices, "_content")], F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")))
        part = self._write(placed.select("key", full.alias("s"), "o", F.lit(version).alias("version")), "docs")
        segment = self.spark.read.parquet(f"{self.path}/{part}")
        plus = segment.filter("s is not null").select("s.*", F.lit(1).cast("bigint").alias("documents"))
        minus = segment.filter("o is not null").select("o.*", F.lit(-1).cast("bigint").alias("documents"))
        delta = plus.unionByName(minus).select(*self.slices, "documents", (F.col("documents") * F.col("tokens")).alias("tokens"))
        sums = [F.sum(c).cast("bigint").alias(c) for c in ("documents", "tokens")]
        whole = delta if self.cube is None else self.cube.unionByName(delta)
        cube = self._write(whole.groupBy(*self.slices).agg(*sums).filter("documents <> 0"), "cube")
        docs = [*state["docs"], part]
        gone = [state["cube"]] if state["cube"] else []
        if len(docs) > self.MERGE:
            latest = self._read(docs).groupBy("key").agg(F.max_by(F.struct("s", "version"), "version").alias("r")).select("key", "r.*").filter("s is not null")
            gone += docs
            docs = [self._write(latest.withColumn("o", F.lit(None).cast(segment.schema["o"].dataType)), "docs")]
            gone += counts
            counts = [self._write(self._read(counts).groupBy("_content", "tokenizer").agg(F.max("tokens").alias("tokens")), "counts")]
        state |= {"version": version, "counts": counts, "docs": docs, "cube": cube, "old": gone}
        write_text(f"{self.path}/state.json", json.dumps(state))
        before, self.state = self.state, state
        for name in before["old"]:
            drop_path(f"{self.path}/{name}")
        return self.cube

    def report(self) -> DataFrame:
        """The slices (level ``slice``), the total and the rest that lacks one of its labels: level, slices, documents, tokens."""
        cube = self.cube
        if cube is None:
            raise ValueError("update the budget first")
        lacking = F.lit(False)
        for c in self.slices:
            lacking = lacking | F.col(c).isNull()
        none = [F.lit(None).cast("string").alias(c) for c in self.slices]
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("documents", "tokens")]
        total = cube.agg(*sums).select(F.lit("total").alias("level"), *none, "documents", "tokens")
        rest = cube.filter(lacking).agg(*sums).select(F.lit("unlabelled").alias("level"), *none, "documents", "tokens")
        return cube.select(F.lit("slice").alias("level"), *self.slices, "documents", "tokens").unionByName(total).unionByName(rest)
