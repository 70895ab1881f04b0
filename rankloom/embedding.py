"""Where vectors come from: a column at hand, letter counts, hashed words, or a service over HTTP."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import zlib
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

LETTERS = "abcdefghijklmnopqrstuvwxyz"


class EmbeddingProvider(Protocol):
    """Texts to vectors of one dimension; role is ``document`` or ``query``."""

    dimension: int

    def embed(self, texts: list[str], role: str) -> list[list[float]]: ...


def query_text(question: str, instruction: str = "") -> str:
    """What a model reads of a question: with an instruction in front, if there is one. Documents have none."""
    return f"Instruct: {instruction}\nQuery:{question}" if instruction.strip() else question


def letter_counts(text: Column) -> Column:
    """A vector that SQL can make: how often each of the 26 letters occurs. For tests and for tables without a model."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


@dataclass
class Letters:
    """The vectors of ``letter_counts`` as a provider."""

    dimension: int = len(LETTERS)

    def embed(self, texts: list[str], role: str) -> list[list[float]]:
        return [[float(low.count(c)) for c in LETTERS] for low in ((t or "").lower() for t in texts)]


@dataclass
class HashedWords:
    """Signed counts of hashed words, of length one: works offline and tells texts apart by their words."""

    dimension: int = 256

    def embed(self, texts: list[str], role: str) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dimension] += 1 if h & 0x80000000 else -1
        return (out / np.maximum(1e-12, np.linalg.norm(out, axis=1))[:, None]).tolist()


@dataclass
class HttpEmbeddings:
    """A service that embeds lists of texts. dialect: ``local``, ``openai`` or ``dashscope``. Tried again on 429, 5xx and broken connections."""

    url: str
    model: str
    dimension: int
    dialect: str = "local"
    api_key: str = ""
    instruction: str = ""
    retries: int = 3
    timeout: float = 120.0

    def __post_init__(self) -> None:
        if self.dialect not in ("local", "openai", "dashscope"):
            raise ValueError(f"unknown dialect {self.dialect}")
        if not self.url or not self.model or self.dimension <= 0:
            raise ValueError("url, model and a positive dimension are needed")
        if self.dialect != "local" and not self.api_key:
            raise ValueError("this service needs a key")

    def body(self, texts: list[str], role: str) -> dict:
        query = role == "query"
        if self.dialect == "dashscope":
            settings: dict = {"dimension": self.dimension, "output_type": "dense", "text_type": "query" if query else "document"}
            if query and self.instruction.strip():
                settings["instruct"] = self.instruction
            return {"model": self.model, "input": {"texts": texts}, "parameters": settings}
        told = [query_text(t, self.instruction) for t in texts] if query else texts
        body = {"model": self.model, "input": told, "encoding_format": "float"}
        if self.dialect == "openai":
            return {**body, "dimensions": self.dimension}
        return {**body, "input_type": "query" if query else "passage", "dimension": self.dimension}

    def parse(self, answer: dict, count: int) -> list[list[float]]:
        rows = answer["output"]["embeddings"] if self.dialect == "dashscope" else answer["data"]
        name = "text_index" if self.dialect == "dashscope" else "index"
        rows = [r for _, _, r in sorted((r.get(name, i), i, r) for i, r in enumerate(rows))]
        out = [r["embedding"] for r in rows]
        if len(out) != count or any(len(v) != self.dimension for v in out):
            raise ValueError("the service returned another number or dimension of vectors")
        return out

    def embed(self, texts: list[str], role: str) -> list[list[float]]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        for attempt in range(self.retries + 1):
            try:
                request = urllib.request.Request(self.url, json.dumps(self.body(texts, role)).encode(), head)
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return self.parse(json.load(answer), len(texts))
            except urllib.error.HTTPError as e:
                if attempt == self.retries or not (e.code == 429 or e.code >= 500):
                    raise
            except OSError:
                if attempt == self.retries:
                    raise
            time.sleep(2 ** min(attempt, 5))
        raise AssertionError


def embed_column(text: Column, provider: EmbeddingProvider, role: str, batch: int = 32, strict: bool = True) -> Column:
    """Vectors of a text column, in batches inside the tasks: a vector stays in its text's row and is never matched by position later. If a batch fails, the query fails;
    unless ``strict``, its texts are tried one by one then, and those that fail get null."""

    def vectors_of(part: list[str]) -> list:
        try:
            vectors = provider.embed(part, role)
            if len(vectors) != len(part) or any(len(v) != provider.dimension for v in vectors):
                raise ValueError("the provider returned another number or dimension of vectors")
            return vectors
        except Exception:
            if strict:
                raise
            return [None] if len(part) == 1 else [v for t in part for v in vectors_of([t])]

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        values, out = texts.fillna("").tolist(), []
        for at in range(0, len(values), batch):
            out += vectors_of(values[at : at + batch])
        return pd.Series(out)

    return run(text)
