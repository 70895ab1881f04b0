"""Writers: the index folder, details and summary files, dead letters."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.shared import exists, write_text

CHUNK_SCHEMA = (
    "chunk_key string, doc_id string, chunk_id int, title string, text_content string, source_type string, source_path string, source_dataset string, tenant_id string, "
    "classification string, allowed array<string>, denied array<string>, content_hash string, model string, indexed_at timestamp, vector array<float>"
)


def write_json(path: str, value: dict) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2))


def create_index(path: str, model: str, dimension: int, k1: float = 2.2, b: float = 1.0, skip_existing: bool = False, extra: dict | None = None) -> bool:
    """Make an empty index: a folder with its manifest. True if made; an existing one is an error, or left alone with ``skip_existing``. Never deletes."""
    if dimension <= 0 or k1 < 0 or not 0 <= b <= 1:
        raise ValueError("dimension must be positive, k1 at least 0 and b between 0 and 1")
    if exists(f"{path}/manifest.json"):
        if skip_existing:
            return False
        raise FileExistsError(path)
    write_json(f"{path}/manifest.json", {"version": 1, "model": model, "dimension": dimension, "k1": k1, "b": b, "analyzers": ["standard", "english"], "chunks": None, **(extra or {})})
    return True


def write_details(details: DataFrame, path: str) -> None:
    """One JSON line per question."""
    details.write.mode("errorifexists").json(path)


def write_summary(summary: DataFrame, path: str, echo: dict | None = None) -> dict:
    """Overall measures and the two maps of slices with sorted keys, with the settings that made them."""
    rows = [r.asDict() for r in summary.collect()]  # one row per slice
    out: dict = {"finished_at": datetime.now(timezone.utc).isoformat(), **(echo or {}), "by_question_type": {}, "by_source_type": {}}
    for r in sorted(rows, key=lambda r: (r["slice_kind"], r["slice"] or "")):
        kind, name = r.pop("slice_kind"), r.pop("slice")
        out.update(r) if kind == "overall" else out[kind].__setitem__(name, r)
    write_json(path, out)
    return out


def append_failure(folder: str, error: Exception, **state: object) -> None:
    """One more file in a folder of failures, on whichever file system the folder lies."""
    now = datetime.now(timezone.utc).isoformat()
    name = f"failure-{now.replace(':', '')}-{uuid.uuid4().hex[:8]}.json"
    write_text(f"{folder.rstrip('/')}/{name}", json.dumps({"failed_at": now, **state, "error_type": type(error).__name__, "error": str(error)[:2000]}))


def details(questions: DataFrame, fused: DataFrame) -> DataFrame:
    """One row per question with its results in order as an array, and all columns of the questions, latencies among them. fused: qid, rank, doc_id, chunk_key, source_type,
    title, score."""
    entry = F.struct("rank", "doc_id", "chunk_key", "source_type", "title", "score")
    lists = fused.groupBy("qid").agg(F.sort_array(F.collect_list(entry)).alias("ranked_documents"))
    out = questions.join(lists, "qid", "left")
    none = F.array().cast(lists.schema["ranked_documents"].dataType)
    return out.withColumn("ranked_documents", F.coalesce("ranked_documents", none)).withColumn("evaluable", F.size("expected") > 0)
