"""Filling containers of fixed capacity with texts that belong together.

A shard's BM25 index is an inverted index over its texts. The longest unused text opens a container as its seed; the index returns the seed's unused
neighbours, best first, and those that fit go in. What room is left is given to the longest unused texts that fit, so that
containers end up full whether or not neighbours fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import TOKEN_PATTERN

#: Texts and characters of a shard in the mean: what one task holds in memory at a time.
SHARD_TEXTS, SHARD_CHARS = 4096, 16_000_000
K1, B = 1.2, 0.75
#: A term in more than one of so many texts is frequent: its whole row holds at most so many times its impacts.
FREQUENT = 16


class Bm25Index:
    """Inverted index of one shard: for each term its texts and their BM25 impacts, in two flat arrays."""

    def __init__(self, texts: list):
        """texts: of each text its terms, as words or as numbers."""
        known: dict = {}
        coded = [t if isinstance(t, np.ndarray) else np.array([known.setdefault(w, len(known)) for w in t], np.int64) for t in texts]
        lengths = np.array([len(t) for t in coded], np.float32)
        flat = np.concatenate([np.zeros(0, np.int64), *coded])
        number, row = np.unique(flat, return_inverse=True)
        terms = len(number)
        # One place for each term and text, in order of term, then text.
        place, tf = np.unique(row.astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), lengths.astype(np.int64)), return_counts=True)
        row, col, tf = (place // max(1, len(texts))).astype(np.int32), (place % max(1, len(texts))).astype(np.int32), tf.astype(np.float32)
        self.texts = col
        self.start = np.searchsorted(row, np.arange(terms + 1))
        df = np.diff(self.start).astype(np.float32)
        idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1e-9, float(lengths.mean()) if len(texts) else 1.0))
        self.impact = idf[row] * tf * (K1 + 1) / (tf + norm[self.texts]) if len(row) else tf
        # A text's own terms, rarest first: the seed's query. Terms of one text alone add to the score of that text only, which is never its own neighbour.
        shared = np.flatnonzero(df[row] > 1)
        by_text = shared[np.lexsort((df[row[shared]], self.texts[shared]))]
        self.own_terms = row[by_text]
        self.own_start = np.searchsorted(self.texts[by_text], np.arange(len(texts) + 1))
        # Frequent terms also as whole rows, which add up faster than scattered impacts.
        often = np.flatnonzero(df > len(texts) / FREQUENT)
        self.whole = np.zeros((len(often), len(texts)), np.float32)
        self.place = np.full(terms, -1, np.int64)
        self.place[often] = np.arange(len(often))
        hold = self.place[row]
        self.whole[hold[hold >= 0], self.texts[hold >= 0]] = self.impact[hold >= 0]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every text for all distinct terms of the seed; the seed's own score lacks the terms that it alone holds."""
        out = np.zeros(len(self.own_start) - 1, np.float32)
        for t in self.own_terms[self.own_start[seed] : self.own_start[seed + 1]]:
            if (at := self.place[t]) >= 0:
                out += self.whole[at]
                continue
            a, b = self.start[t], self.start[t + 1]
            out[self.texts[a:b]] += self.impact[a:b]
        return out


def pack_shard(sizes: np.ndarray, index: Bm25Index, capacity: int) -> np.ndarray:
    """The container's number of every text; every size is at most the capacity."""
    n = len(sizes)
    container = np.full(n, -1, np.int64)
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(n - 1, -1, -1):
        by_size[int(sizes[i])].append(i)
    filled = np.zeros(capacity + 1, bool)
    filled[[int(s) for s in np.unique(sizes)]] = True

    def longest(room: int) -> int:
        """An unused text of the largest size up to the room; -1 if none is left."""
        while True:
            at = np.flatnonzero(filled[: room + 1])
            if not len(at):
                return -1
            size = int(at[-1])
            while by_size[size] and container[by_size[size][-1]] >= 0:
                by_size[size].pop()
            if by_size[size]:
                return by_size[size].pop()
            filled[size] = False

    number = 0
    while (seed := longest(capacity)) >= 0:
        container[seed] = number
        room = capacity - int(sizes[seed])
        score = index.scores(seed)
        score[(container >= 0) | (sizes > room)] = 0
        near = np.flatnonzero(score)
        for i in near[np.lexsort((near, -score[near]))]:
            if sizes[i] <= room:
                container[i] = number
                room -= int(sizes[i])
                if room == 0:
                    break
        while room > 0 and (i := longest(room)) >= 0:
            container[i] = number
            room -= int(sizes[i])
        number += 1
    return container


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 512, shard_texts: int = SHARD_TEXTS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Every text's container: key, piece, pieces, tokens, shard, container.

    Sizes are tokens of the project. A text of more than ``capacity`` tokens is cut after each ``capacity`` tokens; its full pieces are containers of their own and its rest is packed like a
    text. No other text is split. Null and empty texts have no tokens and go into containers like others; rows without key are dropped; rows with equal keys are packed
    each. (shard, container) names a container. Shards hold about ``shard_texts`` texts and ``shard_chars`` characters at most in the mean, chosen by a hash of key and text, so their
    number follows the table; every task holds one shard at a time, as numbers. All distinct terms of a seed query the index.
    """
    if capacity <= 0 or shard_texts <= 0 or shard_chars <= 0:
        raise ValueError("capacity, shard_texts and shard_chars must be positive")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).collect()[0]
    shards = max(1, -(-count // shard_texts), -(-chars // shard_chars))
    hashed = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "key", "text"), F.lit(shards)))
    # One shuffle moves each text to its shard, and every shard to a task of its own, or to the tasks in turn.
    tasks = min(shards, 20_000)
    together = hashed.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard")
    pattern = TOKEN_PATTERN

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, known = regex.compile(pattern), {}

        def shard(rows: list[tuple]) -> pd.DataFrame:
            rows.sort(key=lambda r: (r[0], r[1]))
            words, owner, piece = [], [], []
            out: list[tuple] = []
            pieces = []
            for i, (_, _, found) in enumerate(rows):
                full = 0 if len(found) <= capacity else len(found) // capacity
                rest = found[full * capacity :]
                pieces.append(full + bool(len(rest) or not full))
                out += [(i, p, capacity, -1) for p in range(full)]
                if len(rest) or not full:
                    words.append(rest)
                    owner.append(i)
                    piece.append(full)
            sizes = np.array([len(w) for w in words], np.int64)
            at = pack_shard(sizes, Bm25Index(words), capacity) if words else np.zeros(0, np.int64)
            number = int(at.max()) + 1 if len(at) else 0
            out = [(i, p, n, number + j) for j, (i, p, n, _) in enumerate(out)]
            out += list(zip(owner, piece, sizes.tolist(), at.tolist(), strict=True))
            i = [x[0] for x in out]
            return pd.DataFrame({"key": [rows[x][0] for x in i], "piece": [x[1] for x in out], "pieces": [pieces[x] for x in i], "tokens": [x[2] for x in out], "shard": now, "container": [x[3] for x in out]})

        now, held = None, []
        for batch in batches:
            for k, t, s in batch[["key", "text", "shard"]].itertuples(index=False):
                if s != now and held:
                    yield shard(held)
                    held, known = [], {}
                now = s
                held.append((k, xxhash.xxh3_64_intdigest(t.encode()), np.array([known.setdefault(w, len(known)) for w in find.findall(t.lower())], np.int32)))
        if held:
            yield shard(held)

    schema = f"key {kind}, piece bigint, pieces bigint, tokens bigint, shard bigint, container bigint"
    return together.mapInPandas(each, schema).withColumnRenamed("key", key)


def split_texts(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys whose text the packing had to split: those with more than one piece."""
    return packed.filter("pieces > 1").select(key).distinct()


def container_report(packed: DataFrame, capacity: int = 512) -> DataFrame:
    """Containers, tokens and the share of room left over, per shard."""
    each = packed.groupBy("shard", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
    out = each.groupBy("shard").agg(F.count(F.lit(1)).alias("containers"), F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return out.withColumn("room_left", 1 - F.col("tokens") / (F.col("containers") * capacity))
