"""The k most similar vectors of every query vector: a robust-pruned graph per shard, searched by the queries that come near.

A coarse grid of cells, the means of a bounded sample, says where a direction lies. Cells that lie side by side make up a shard; a cell too full for one shard is dealt to several. A
query is sent to the shards of the cells nearest to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.graph import VectorGraph
from rankloom.shared import small, stored

#: Vectors of a shard at most: 8 MB of 64 components, about 4 MB of edges, and the time one task takes to build its graph. Fewer, where that gives every core three shards, but not
#: less than LEAST_VECTORS.
SHARD_VECTORS, LEAST_VECTORS = 32_768, 8192
BEAM = 96
#: Vectors from which cells are made at most, cells for each shard, and their bounds. A sixteenth of the cells, and 32 at least, are searched for a query.
SAMPLE_VECTORS, SHARD_CELLS, LEAST_CELLS, MOST_CELLS = 8192, 32, 512, 1024
PROBED_SHARE, PROBED_CELLS = 1 / 16, 32
#: Unit vectors nearer than LINK may form a group, whose members lie within RADIUS of its first; the graph's single precision could hardly tell them apart.
LINK, RADIUS = 1e-3, 2e-3


def usable(vector: Column, dims: int) -> Column:
    """Vectors of ``dims`` finite components that are not all zero."""
    low, high, infinite = F.array_min(vector), F.array_max(vector), float("inf")
    finite = ~F.isnan(high) & (high < infinite) & (low > -infinite)
    return F.coalesce((F.size(vector) == dims) & finite & ((low != 0) | (high != 0)) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))


def directions(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a column of vectors the unit vectors and a hash of each direction: vectors that differ by a power of two in length, or otherwise scale to the same bits, share it."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # else the squares of very small components vanish
    bits = (x + 0.0).view(np.uint64)
    same = np.zeros(len(x), np.uint64)
    for d in range(dims):
        same = (same ^ bits[:, d]) * np.uint64(0x9E3779B97F4A7C15)
        same ^= same >> np.uint64(29)
    return x / np.sqrt((x * x).sum(1))[:, None], same.view(np.int64)


def cells_of(sample: np.ndarray, number: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Centres of so many cells: unit vectors, means of the sample's vectors nearest to them."""
    sample = sample.astype(np.float32)
    centres = sample[np.random.default_rng(seed).choice(len(sample), number, replace=False)]
    for _ in range(rounds):
        at = np.concatenate([(sample[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(sample), 8192)])
        order = np.argsort(at, kind="stable")
        held, first = np.unique(at[order], return_index=True)
        means = np.add.reduceat(sample[order], first, axis=0)
        size = np.linalg.norm(means, axis=1)
        centres[held[size > 0]] = (means / np.maximum(size, 1e-30)[:, None])[size > 0]
    return centres


def shards_of(centres: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard of each cell, number of shards it is dealt to). Cells are halved by weight along the direction in which they are spread most, until a half holds no more
    than ``most`` vectors; a single cell that holds more has shards of its own."""
    first, parts, shards = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64), 0
    todo = [np.arange(len(centres))]
    while todo:
        held = todo.pop()
        weight = counts[held].sum()
        if weight <= most or len(held) == 1:
            first[held] = shards
            parts[held] = max(1, -(-int(weight) // most)) if len(held) == 1 else 1
            shards += int(parts[held[0]])
            continue
        x = centres[held] - centres[held].mean(0)
        line = np.linalg.svd(x, full_matrices=False)[2][0]
        held = held[np.argsort(x @ line, kind="stable")]
        sums = np.cumsum(counts[held])
        at = min(len(held) - 1, max(1, int(np.searchsorted(sums, weight / 2))))
        todo += [held[at:], held[:at]]
    return first, parts


def near_groups(x: np.ndarray, tries: int = 4, steps: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of nearly equal unit vectors: (order of the rows by group with the leader first, start of each group in it and the end, distance of its farthest member).

    Vectors that lie side by side along a random line are compared; chains of close ones are split around leaders, so a group never reaches farther than RADIUS.
    A close pair that is not noticed stays in two groups, which costs nothing but a place in the graph.
    """
    n = len(x)
    a, b = [], []
    for line in np.random.default_rng(7).normal(size=(tries, x.shape[1])):
        along = np.argsort(x @ line, kind="stable")
        for step in range(1, min(steps, n - 1) + 1):
            i, j = along[:-step], along[step:]
            gap = x[i] - x[j]
            close = np.einsum("ij,ij->i", gap, gap) <= LINK * LINK
            a.append(i[close])
            b.append(j[close])
    a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in (a, b))
    label = np.arange(n)
    while len(a) and (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
    order = np.argsort(label, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(label[order]) != 0, [True]]))
    rows, sizes, reach = [], [], []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        left = order[lo:hi]
        while len(left):
            gap = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(1)) if len(left) > 1 else np.zeros(1)
            near = gap <= RADIUS
            rows.append(left[near])
            sizes.append(int(near.sum()))
            reach.append(float(gap[near].max()))
            left = left[~near]
    return np.concatenate(rows), np.concatenate([[0], np.cumsum(sizes)]), np.array(reach)


def nearest(
    items: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, dims: int = 64, latest: str | None = None, shard_vectors: int | None = None, beam: int = BEAM
) -> DataFrame:
    """query, neighbour, similarity (double, cosine), rank (bigint): for every key of ``queries`` the k keys of ``items`` of highest cosine.

    All usable items are indexed, in shards of at most about ``shard_vectors`` (see SHARD_VECTORS); the graph of each shard that holds one of the cells nearest to a query is searched with a beam of ``beam``
    and its k best go into one ranking per query, ties by key. Misses are possible, the README states the measured share. Queries that are
    no usable item give no rows. A key counts once, with the vector of its largest ``latest`` (else the largest vector); a key is not its own neighbour.
    Nearly equal directions enter a graph once, and all of them are compared with a query that comes near. Only of items whose scaled directions are equal in every bit the k + 1 smallest keys suffice:
    their cosines are equal, so more cannot be among the best k. A cell that a large group of nearly equal ones fills is dealt to several shards, and its queries go to all of them. A table
    smaller than k + 1 gives what it has.
    """
    if k <= 0 or dims <= 0 or (shard_vectors is not None and shard_vectors <= 0) or beam < k:
        raise ValueError("k, dims and shard_vectors must be positive and beam at least k")
    spark = items.sparkSession
    order = F.struct(F.col(latest).alias("o"), F.col(vector).alias("v")) if latest else F.struct(F.col(vector).alias("v"))
    good = items.filter(F.col(key).isNotNull() & usable(F.col(vector), dims))
    once = stored(good.groupBy(F.col(key).alias("key")).agg(F.max(order).alias("m")).select("key", F.col("m.v").cast("array<float>").alias("v")), "vectors")
    number = once.count()
    if not number:
        return spark.createDataFrame([], "query string, neighbour string, similarity double, rank bigint")
    shard_vectors = shard_vectors or min(SHARD_VECTORS, max(LEAST_VECTORS, number // (3 * spark.sparkContext.defaultParallelism)))
    # A bounded sample, chosen by a hash of the key, of which only the cells' centres stay.
    share = min(1.0, SAMPLE_VECTORS / number)
    picked = once.filter(F.pmod(F.xxhash64(F.lit("cells"), "key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("key").limit(SAMPLE_VECTORS).select("v").toArrow()
    sample = np.concatenate([directions(c, dims)[0] for c in picked.column("v").chunks])
    cells = max(1, min(MOST_CELLS, max(LEAST_CELLS, SHARD_CELLS * -(-number // shard_vectors)), len(sample) // 8))
    centres = cells_of(sample, cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, same = directions(batch.column("v"), dims)
            x = x.astype(np.float32)
            cell = np.concatenate([np.zeros(0, np.int64), *[(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)]])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), pa.array(same), pa.array(cell.astype(np.int32))], names=["key", "v", "same", "cell"])

    placed = once.mapInArrow(place, "key string, v array<float>, same bigint, cell int")
    copies = Window.partitionBy("same").orderBy("key")
    held = stored(placed.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"), "placed")
    counts = np.zeros(cells, np.int64)
    for r in held.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per cell
        counts[r["cell"]] = r["n"]
    first, parts = shards_of(centres, counts, shard_vectors)
    shards = int((first + parts).max())
    near = min(cells, max(PROBED_CELLS, math.ceil(cells * PROBED_SHARE)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = directions(batch.column("v"), dims)[0].astype(np.float32) @ centres.T
            best = np.argpartition(-sims, near - 1, axis=1)[:, :near]
            goals = [np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in row])).astype(np.int32) for row in best]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), pa.array(goals, pa.list_(pa.int32()))], names=["key", "v", "shards"])

    # The queries' keys are rows of a table of any size: without broadcast they meet by a shuffle.
    asked = queries.select(F.col(key).alias("key")).filter("key is not null").distinct()
    ask = once.join(small(asked), "key", "left_semi").mapInArrow(route, "key string, v array<float>, shards array<int>")
    first_of, parts_of = (F.element_at(F.lit(a.tolist()), F.col("cell") + 1) for a in (first, parts))
    rows = held.select((first_of + F.pmod("same", parts_of)).cast("int").alias("shard"), F.lit(0).alias("kind"), "key", "v")
    rows = rows.unionByName(ask.select(F.explode("shards").alias("shard"), F.lit(1).alias("kind"), "key", "v"))
    # A shard's rows come first, then its queries in a stream of any length.
    together = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    schema = pa.schema([("query", pa.string()), ("neighbour", pa.string()), ("similarity", pa.float64())])

    def unit(column: pa.Array) -> np.ndarray:
        return directions(column, dims)[0]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts = [], []
        names, x, graph = None, None, None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            stored = int((kinds == 0).sum())
            name, v = batch.column("key"), batch.column("v")
            if stored:
                keys.append(name.slice(0, stored))
                parts.append(unit(v.slice(0, stored)))
            if stored == len(kinds):
                continue
            if graph is None:
                if not parts:
                    return
                names, x = pa.chunked_array(keys).combine_chunks().to_numpy(zero_copy_only=False), np.concatenate(parts)
                # Nearly equal directions enter the graph once; a group's members lie side by side.
                order, start, reach = near_groups(x)
                names, x = names[order], x[order]
                alphabet = np.empty(len(names), np.int64)
                alphabet[np.argsort(names, kind="stable")] = np.arange(len(names))
                graph = VectorGraph(x[start[:-1]].astype(np.float32))
            asked, q = name.slice(stored).to_numpy(zero_copy_only=False), unit(v.slice(stored))
            for at in range(0, len(q), 512):
                ids, sims = graph.search(q[at : at + 512].astype(np.float32), min(beam, max(1, len(graph.x))))
                # A member is at most its group's reach more similar than the leader, so groups that cannot come up to the (k + 1)th leader are left out.
                able = ids >= 0
                if ids.shape[1] > k:
                    able &= sims + reach[ids] + 1e-6 >= sims[:, k : k + 1]
                out_q, out_n, out_s = [], [], []
                for j in range(len(ids)):
                    groups = [slice(start[i], start[i + 1]) for i in ids[j][able[j]]]
                    found = np.concatenate([np.arange(p.start, p.stop) for p in groups])
                    # Large groups are multiplied where they lie, without a copy.
                    s = np.concatenate([x[p] @ q[at + j] for p in groups]) if len(found) > 1000 else x[found] @ q[at + j]
                    s = np.round(s, 12)
                    if len(found) > k + 1:
                        top = s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                        found, s = found[top], s[top]
                    for i in np.lexsort((alphabet[found], -s)):
                        if names[found[i]] != asked[at + j]:
                            out_n.append(names[found[i]])
                            out_s.append(float(s[i]))
                            out_q.append(asked[at + j])
                            if len(out_q) >= k and out_q[-k] == asked[at + j]:
                                break
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.string()), pa.array(out_n, pa.string()), pa.array(out_s, pa.float64())], schema=schema)

    found = together.mapInArrow(search, "query string, neighbour string, similarity double")
    best = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)
