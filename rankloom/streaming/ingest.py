"""Incremental ingest: a stream of documents becomes rows of the chunk table, each batch committed once."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.embedding import EmbeddingProvider, embed_column
from rankloom.operators.chunking import build_chunks, check_sizes, passage
from rankloom.shared import drop_path, exists, read_text, rename, stored
from rankloom.sources.readers import read_acl, read_manifest, stream_docs
from rankloom.sources.sinks import CHUNK_SCHEMA, append_failure, write_json


#: The options of a config that may differ between runs that continue each other.
_FREE = ("files_per_batch", "max_documents", "embedding_batch", "retries", "state", "dead_letters")


class _Enough(Exception):
    """The limit of documents is reached; the batch stays open and is taken up again by a run with a higher limit."""


@dataclass(frozen=True)
class IngestConfig:
    """max_documents: documents over all runs, 0 for all. retries: further attempts at a batch. state: where progress is kept, else in the index. dead_letters: rows that
    cannot be read or embedded go to the index's table of dead letters instead of failing the batch."""

    docs: str
    acl: str
    index: str
    model: str
    dimension: int
    chunk_size: int = 1200
    chunk_overlap: int = 200
    files_per_batch: int = 20
    max_documents: int = 0
    embedding_batch: int = 32
    retries: int = 0
    state: str = ""
    dead_letters: bool = False

    def __post_init__(self) -> None:
        if self.max_documents < 0 or self.retries < 0 or self.embedding_batch <= 0 or self.files_per_batch <= 0:
            raise ValueError("limits and retries must not be negative, batches must be positive")

    @property
    def state_path(self) -> str:
        return self.state or f"{self.index}/_state"

    def signature(self) -> str:
        """What must stay the same between runs that continue each other. Numbers compare as text. Sizes and times of the files are kept beside it, see ``check_files``."""
        return hashlib.sha256(json.dumps({k: str(v) for k, v in asdict(self).items() if k not in _FREE}, sort_keys=True).encode()).hexdigest()


def check_signature(config: IngestConfig) -> None:
    """Reject an index of another model, dimension or analyzer and a checkpoint that other settings wrote."""
    manifest = read_manifest(config.index)
    if manifest["dimension"] != config.dimension or manifest["model"] != config.model:
        raise ValueError("the index was made for another model or dimension")
    if "standard" not in manifest.get("analyzers", []):
        raise ValueError("the index lacks the standard analyzer")
    state, own = f"{config.state_path}/signature.json", {"version": 1, "signature": config.signature()}
    if not exists(state):
        write_json(state, own)
    elif json.loads(read_text(state)) != own:
        raise ValueError("the checkpoint was written with other settings")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified of the files, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def check_files(spark: SparkSession, config: IngestConfig) -> DataFrame:
    """The files as they are now; an error if one that an earlier run took has another size or time since."""
    now, known = listing(spark, config.docs), f"{config.state_path}/files"
    if exists(known):
        then = spark.read.parquet(known)
        changed = then.join(now.withColumnsRenamed({"length": "l", "modified": "m"}), "path").filter("length <> l or modified <> m").limit(1).collect()
        if changed:
            raise ValueError(f"{changed[0]['path']} has changed since it was ingested")
    return now


def progress(config: IngestConfig) -> dict:
    """Sums over all runs, and the batch that was written last."""
    path = f"{config.state_path}/progress.json"
    return json.loads(read_text(path)) if exists(path) else {"documents": 0, "chunks": 0, "batches": 0, "failed": 0, "last": None}


def upsert(batch: DataFrame, index: str, batch_id: int) -> None:
    """Write a batch's chunks under its number. A replayed batch overwrites its own files, so its rows never stand twice; of rows with equal keys readers take
    the one of the last batch. Earlier batches are not rewritten, whatever the index's size."""
    batch.write.mode("overwrite").parquet(f"{index}/chunks/batch={batch_id:012d}")


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The chunk table: of every chunk key the row of the last batch. Batches beyond the published one are being written and are not read."""
    if not exists(f"{index}/chunks"):
        return spark.createDataFrame([], CHUNK_SCHEMA)
    rows = spark.read.schema(CHUNK_SCHEMA + ", batch string").parquet(f"{index}/chunks")
    if exists(f"{index}/published.json"):
        rows = rows.filter(F.col("batch") <= f"{json.loads(read_text(f'{index}/published.json'))['batch']:012d}")
    names = [f.name for f in rows.schema if f.name not in ("batch", "chunk_key")]
    last = F.max_by(F.struct(*names), F.col("batch").cast("bigint")).alias("r")
    return rows.groupBy("chunk_key").agg(last).select("chunk_key", "r.*")


def ingest(spark: SparkSession, config: IngestConfig, provider: EmbeddingProvider | None = None, failures: str | None = None, report: Callable[[dict], None] | None = None) -> dict:
    """Ingest all files that arrived since the last run and return what this run did and what all runs did.

    Files are the unit of progress: the stream's checkpoint advances only after a batch's chunks are written and published. Documents of one batch with equal ids: the last by text
    counts. Chunks of a document that is delivered again overwrite those with equal numbers; higher numbers of a longer earlier text stay. ``report`` gets an event after each
    batch; ``failures`` is a folder that gets a file for each failed attempt at a batch.
    """
    check_sizes(config.chunk_size, config.chunk_overlap)
    check_signature(config)
    files = check_files(spark, config)
    acl = read_acl(spark, config.acl)
    state = progress(config)
    began, first = time.time(), dict(state)
    chunk_columns = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def write(docs: DataFrame, batch_id: int, room: int) -> dict:
        names = [c for c in docs.columns if c not in ("doc_id", "_broken", "_file")]
        dead = None
        if config.dead_letters:
            dead = docs.filter("_broken is not null").select(F.lit("document").alias("kind"), F.col("_file").alias("source"), F.col("_broken").alias("content"))
            docs = docs.filter("_broken is null")
        once = docs.groupBy("doc_id").agg(F.max(F.struct("text", *[c for c in names if c != "text"])).alias("r")).select("doc_id", "r.*")
        count = once.count()
        if room < count:
            once, count = once.orderBy("doc_id").limit(room), room
        rows = build_chunks(once, acl, config.chunk_size, config.chunk_overlap)
        text = passage(F.col("title"), F.col("text_content"))
        vector = embed_column(text, provider, "document", config.embedding_batch, not config.dead_letters).cast("array<float>") if provider else F.lit(None).cast("array<float>")
        rows = rows.withColumns({"model": F.lit(config.model), "indexed_at": F.current_timestamp(), "vector": vector}).select(*chunk_columns)
        failed = 0
        if config.dead_letters:
            rows = stored(rows, "batch")  # a vector must be asked for once only
            lost = F.lit(provider is not None) & F.col("vector").isNull()
            dead = dead.unionByName(rows.filter(lost).select(F.lit("chunk").alias("kind"), F.col("chunk_key").alias("source"), F.col("text_content").alias("content")))
            rows = rows.filter(~lost)
            dead.write.mode("overwrite").parquet(f"{config.index}/dead_letters/batch={batch_id:012d}")
            failed = spark.read.parquet(f"{config.index}/dead_letters/batch={batch_id:012d}").count()
        upsert(rows, config.index, batch_id)
        return {"batch": batch_id, "documents": count, "chunks": spark.read.parquet(f"{config.index}/chunks/batch={batch_id:012d}").count(), "failed": failed}

    def each(docs: DataFrame, batch_id: int) -> None:
        last = state["last"]
        if last and last["batch"] == batch_id:  # a replay takes its own place in the sums too
            for k in ("documents", "chunks", "failed"):
                state[k] -= last[k]
            state["batches"] -= 1
            state["last"] = None
        room = config.max_documents - state["documents"] if config.max_documents else 1 << 62
        if room <= 0:
            raise _Enough
        for attempt in range(config.retries + 1):
            try:
                done = write(docs, batch_id, room)
                break
            except Exception as e:
                if failures:
                    append_failure(failures, e, batch=batch_id, attempt=attempt, **{k: state[k] for k in ("documents", "chunks", "batches")})
                if attempt == config.retries:
                    raise
                time.sleep(2 ** min(attempt, 5))
        for k in ("documents", "chunks", "failed"):
            state[k] += done[k]
        state["batches"] += 1
        state["last"] = done
        write_json(f"{config.index}/published.json", {"batch": batch_id})
        write_json(f"{config.state_path}/progress.json", state)
        if report:
            speed = (state["documents"] - first["documents"]) / max(0.001, time.time() - began)
            report({"event": "batch_complete", "batch": batch_id, "documents": state["documents"], "chunks": state["chunks"], "documents_per_second_this_run": round(speed, 3)})
        if done["documents"] >= room and config.max_documents:
            raise _Enough

    full = bool(config.max_documents) and state["documents"] >= config.max_documents
    if not full:
        query = (
            stream_docs(spark, config.docs, config.files_per_batch, config.dead_letters).writeStream.foreachBatch(each)
            .option("checkpointLocation", f"{config.state_path}/stream").trigger(availableNow=True).start()
        )
        try:
            query.awaitTermination()
        except Exception as e:
            if "_Enough" not in str(e):
                raise
            full = True
    if not full:
        files.write.mode("overwrite").parquet(f"{config.state_path}/files_new")
        if exists(f"{config.state_path}/files"):
            drop_path(f"{config.state_path}/files")
        rename(f"{config.state_path}/files_new", f"{config.state_path}/files")
    seconds = time.time() - began
    own = {k: state[k] - first[k] for k in ("batches", "documents", "chunks", "failed")}
    sums = {f"{k}_total": state[k] for k in own}
    return {
        "event": "import_complete", **own, **sums, "limit_reached": full, "model": config.model, "dimension": config.dimension, "seconds": round(seconds, 3),
        "documents_per_second": round(own["documents"] / seconds, 3), "finished_at": datetime.now(timezone.utc).isoformat(), "index": config.index, "checkpoint": config.state_path,
    }
