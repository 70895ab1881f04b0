"""Retrieval routes: BM25 over several fields and exact cosine, each for all questions at once.

Items are cut into slices and questions into blocks by hashes; the task of a slice and a block holds its questions and takes its items as a stream. What a question has
found bounds what later items must reach. Collection-wide statistics come from Spark aggregates and travel with the query terms. Each task returns what can be among a
question's best; one window over these makes the ranking.

Every route returns ``hits``: qid, route, route_ord, weight, rank, doc_id, chunk_key, score. Scores are rounded to six digits before they are
compared; ties go by document, then chunk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K1, B = 2.2, 1.0
SHARD_ITEMS = 8192
HITS = ["qid", "route", "route_ord", "weight", "rank", "doc_id", "chunk_key", "score"]


def _ranked(found: DataFrame, route: str, route_ord: int, weight: float, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id", "chunk_key")
    out = found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
    return out.select("qid", F.lit(route).alias("route"), F.lit(route_ord).alias("route_ord"), F.lit(float(weight)).alias("weight"), "rank", "doc_id", "chunk_key", "score")


def term_statistics(chunks: DataFrame, fields: dict[str, str]) -> tuple[DataFrame, dict[str, tuple[int, float]]]:
    """(field, term, df) over all chunks, and per field the number of chunks and their mean length. fields: name -> column of term arrays."""
    each = None
    for name, column in fields.items():
        part = chunks.select(F.lit(name).alias("field"), F.explode(F.array_distinct(column)).alias("term"))
        each = part if each is None else each.unionByName(part)
    sizes = chunks.agg(*[F.struct(F.count_if(F.size(c) > 0).alias("n"), F.avg(F.when(F.size(c) > 0, F.size(c))).alias("mean")).alias(n) for n, c in fields.items()]).collect()[0]
    return each.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")), {n: (sizes[n]["n"], sizes[n]["mean"] or 1.0) for n in fields}


def bm25(
    questions: DataFrame, chunks: DataFrame, fields: dict[str, float], k: int = 50, k1: float = K1, b: float = B, tenant: str = "tenant_redwood",
    scoped: bool = True, route: str = "bm25", route_ord: int = 1, weight: float = 1.0, shard_items: int = 1 << 17,
) -> DataFrame:
    """Best-fields BM25: score = the largest, over fields, of boost * sum of qtf * idf * (k1 + 1) * tf / (tf + k1 * (1 - b + b * length / mean)).

    questions: qid, terms (array), scope (array). chunks: chunk_key, doc_id, tenant, source, allowed, denied and for each field ``<field>_terms``. The chunk is the unit of
    statistics, over all chunks that have the field, whatever a question may see. A document stands with its best chunk. Questions without terms, and chunks
    without document, take no part. Repeated qids count as one with all their terms, so make them unique.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    columns = {f: f"{f}_terms" for f in fields}
    df, sizes = term_statistics(chunks, columns)
    asked = questions.select("qid", F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    met = asked.join(df, "term")
    n = F.create_map(*[x for f, (c, _) in sizes.items() for x in (F.lit(f), F.lit(float(c)))])[F.col("field")]
    gain = F.col("qtf") * F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = met.select("qid", F.struct("field", "term", gain.alias("gain")).alias("t")).groupBy("qid").agg(F.sort_array(F.collect_list("t")).alias("t"))
    scopes = questions.groupBy("qid").agg(F.first("scope").alias("scope")) if scoped else None
    ready = weighted.join(scopes, "qid") if scoped else weighted.withColumn("scope", F.array().cast("array<string>"))
    at = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.lit(i))])
    scope = F.array_sort(F.array_distinct(F.filter(F.coalesce("scope", F.array().cast("array<string>")), lambda s: s.isNotNull())))
    ready = ready.select("qid", scope.alias("scope"), F.transform("t", lambda x: at[x["field"]]).alias("q_field"), F.transform("t", lambda x: x["term"]).alias("q_term"), F.transform("t", lambda x: x["gain"]).alias("q_gain"))
    joined = [F.array_join(c, _BETWEEN).alias(c) for c in columns.values()]
    items = chunks.filter(F.col("doc_id").isNotNull()).select("chunk_key", "doc_id", (_access() if scoped else F.lit("{}")).alias("access"), *joined)
    slices, blocks = _grid(items.sparkSession, items.count(), 300, ready.count(), 400, 200 * k, HELD_HITS // k)
    boosts, means = list(fields.values()), [sizes[f][1] for f in fields]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        asked: list[pa.RecordBatch] = []
        best: _Matches | None = None
        parts: list[_Tokens] = []
        for batch in batches:
            kind = np.asarray(batch["kind"])
            if (of := np.flatnonzero(kind == 0)).size:
                asked.append(batch.select(["qid", "scope", "q_field", "q_term", "q_gain"]).take(pa.array(of)))
            if (of := np.flatnonzero(kind == 1)).size:
                if not asked:
                    return
                best = best or _Matches(asked, boosts, k, tenant)
                given = batch.take(pa.array(of))
                parts.append(_Tokens(given, names.see(given["doc_id"], given["chunk_key"]), [given[c] for c in columns.values()], best.terms))
                if sum(len(p.doc) for p in parts) >= shard_items:
                    best.see(parts, means, k1, b)
                    parts = []
        if best is not None:
            if parts:
                best.see(parts, means, k1, b)
            yield from best.found(names)

    found = _cells(ready, items, slices, blocks).mapInArrow(search, "qid string, doc_id string, chunk_key string, score double")
    # A document's chunks may lie in several slices: its best one stands for it.
    best = found.groupBy("qid", "doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_key")).alias("m")).select("qid", "doc_id", F.col("m.chunk_key").alias("chunk_key"), (-F.col("m.s")).alias("score"))
    return _ranked(best, route, route_ord, weight, k)


#: Between the terms of a field in one text; no analyzer gives it.
_BETWEEN = "\x1f"
#: Hits that a task holds at most for its questions.
HELD_HITS = 1 << 21


class _Names:
    """Documents and keys of a stream sorted by them: rows get their place, documents a number, in this order."""

    def __init__(self) -> None:
        self.docs, self.keys, self.rows, self.last_doc, self.last = [], [], 0, 0, None

    def see(self, docs: pa.Array, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.ones(len(docs), bool)
        fresh[0] = docs[0].as_py() != self.last
        if len(docs) > 1:
            fresh[1:] = np.asarray(pc.not_equal(docs[1:], docs[:-1]))
        doc, place = self.last_doc + np.cumsum(fresh), self.rows + np.arange(len(docs))
        self.last_doc, self.last, self.rows = int(doc[-1]), docs[-1].as_py(), self.rows + len(docs)
        self.docs.append(docs)
        self.keys.append(keys)
        return place, doc

    def rows_of(self, qids: pa.Array, who: np.ndarray, place: np.ndarray, score: np.ndarray) -> list[pa.RecordBatch]:
        at = pa.array(place)
        columns = {"qid": qids.take(pa.array(who)), "doc_id": pa.chunked_array(self.docs).take(at), "chunk_key": pa.chunked_array(self.keys).take(at), "score": pa.array(score)}
        return pa.table(columns).combine_chunks().to_batches(max_chunksize=10_000)


class _Tokens:
    """A batch of items: of each field the asked terms by number, with their rows, and the number of all terms."""

    def __init__(self, batch: pa.RecordBatch, named: tuple[np.ndarray, np.ndarray], texts: list[pa.Array], terms: dict[str, int]):
        self.place, self.doc = named
        self.access = batch["access"].to_pylist()
        self.fields = []
        for text in texts:
            text = pc.fill_null(text, "")
            lists = pc.split_pattern(text, _BETWEEN)
            size = np.where(np.asarray(pc.equal(text, "")), 0, np.asarray(pc.list_value_length(lists)))
            codes = lists.flatten().dictionary_encode()
            number = np.array([terms.get(t, -1) for t in codes.dictionary.to_pylist()], np.int32)[np.asarray(codes.indices)]
            row = np.repeat(np.arange(len(size), dtype=np.int32), np.asarray(pc.list_value_length(lists)))
            asked = number >= 0
            self.fields.append((number[asked], row[asked], size))


def _looked_up(key: np.ndarray, row: np.ndarray, impact: np.ndarray, number: int, n: int, rows: np.ndarray) -> np.ndarray:
    """A term's impact in each of the rows, 0 where it is absent."""
    lo, hi = np.searchsorted(key, (number * n, number * n + n))
    if lo == hi:
        return np.zeros(len(rows))
    there = lo + np.searchsorted(row[lo:hi], rows)
    there[there == hi] = lo
    return np.where(row[there] == rows, impact[there], 0.0)


class _Matches:
    """The k best documents so far of each question, by BM25 over blocks of items.

    In a block, terms are taken by the most that they can add. Once what the remaining ones add together stays below the score of the k-th document, they only add to
    items already found, so the long lists of common words are looked up, not walked. Items are ordered by who may see them; a question walks those that it sees.
    """

    def __init__(self, asked: list[pa.RecordBatch], boosts: list[float], k: int, tenant: str):
        table = pa.Table.from_batches(asked).combine_chunks()
        self.qids, self.k, self.tenant, self.fields = table["qid"].combine_chunks(), k, tenant, len(boosts)
        lists = [table[c].combine_chunks() for c in ("q_field", "q_term", "q_gain")]
        size = np.asarray(pc.list_value_length(lists[0]))
        field, gain = np.asarray(lists[0].flatten()), np.asarray(lists[2].flatten())
        codes = lists[1].flatten().dictionary_encode()
        self.terms = {t: i for i, t in enumerate(codes.dictionary.to_pylist())}
        owner, number = np.repeat(np.arange(len(size)), size), np.asarray(codes.indices).astype(np.int64)
        self.asked = []
        for f, boost in enumerate(boosts):
            mine = field == f
            self.asked.append((number[mine], gain[mine] * boost, np.searchsorted(owner[mine], np.arange(len(size) + 1)).tolist()))
        by: dict[frozenset, list[int]] = {}
        for j, scope in enumerate(table["scope"].to_pylist()):
            by.setdefault(frozenset(scope), []).append(j)
        self.scopes = by
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(size)
        self.bound = np.full(len(size), -np.inf)

    def see(self, parts: list[_Tokens], means: list[float], k1: float, b: float) -> None:
        kinds: dict[str, int] = {}
        code = np.array([kinds.setdefault(a, len(kinds)) for p in parts for a in p.access], np.int64)
        order = np.argsort(code, kind="stable")
        n, code = len(order), code[order]
        row_of = np.empty(n, np.int64)
        row_of[order] = np.arange(n)
        place, doc = (np.concatenate([getattr(p, c) for p in parts])[order] for c in ("place", "doc"))
        begins = np.cumsum([0, *(len(p.doc) for p in parts)])
        index = []
        for f in range(self.fields):
            number = np.concatenate([p.fields[f][0] for p in parts]).astype(np.int64)
            row = row_of[np.concatenate([p.fields[f][1] + at for p, at in zip(parts, begins, strict=False)])]
            key, tf = np.unique(number * n + row, return_counts=True)
            number, row = np.divmod(key, n)
            size = np.concatenate([p.fields[f][2] for p in parts])[order]
            impact = tf * (k1 + 1) / (tf + (k1 * (1 - b + b * size / means[f]))[row])
            most = np.zeros(len(self.terms))
            if len(key):
                starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
                most[number[starts]] = np.maximum.reduceat(impact, starts)
            index.append((key, row.astype(np.int32), impact, most))
        bounds = np.searchsorted(code, np.arange(len(kinds) + 1))
        total = np.zeros(n)
        for scope, questions in self.scopes.items():
            sees = np.array([_sees(scope, a, self.tenant) for a in kinds], bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], sees, [False]]).astype(np.int8)))
            spans = [(int(bounds[i]), int(bounds[j])) for i, j in zip(edge[::2], edge[1::2], strict=True)]
            shown = None
            if len(spans) > 8:
                spans, shown = [(0, n)], np.repeat(sees, np.diff(bounds))
            if spans:
                for j in questions:
                    self._ask(j, n, spans, shown, index, total, place, doc)

    def _ask(self, j: int, n: int, spans: list[tuple[int, int]], shown: np.ndarray | None, index: list[tuple], total: np.ndarray, place: np.ndarray, doc: np.ndarray) -> None:
        least = self.bound[j] - 1e-6  # rounding at the sixth digit
        unbounded = self.bound[j] == -np.inf
        rows_, scores_ = [], []
        for (number, gain, at), (key, row, impact, most) in zip(self.asked, index, strict=True):
            number, gain = number[at[j] : at[j + 1]], gain[at[j] : at[j + 1]]
            adds = gain * most[number]
            order = np.argsort(-adds)
            order = order[adds[order] > 0]
            if not len(order):
                continue
            number, gain = number[order], gain[order]
            rest = np.append(np.cumsum(adds[order][::-1])[::-1], 0.0)
            if rest[0] < least:
                continue
            need = max(1, int(np.count_nonzero(rest[:-1] >= least)))
            edges = np.searchsorted(key, (number[:need, None] * n + np.array(spans, np.int64).ravel()).ravel()).reshape(need, -1, 2)
            length = (edges[:, :, 1] - edges[:, :, 0]).sum(1)
            walked, i = [], 0
            while i < need:
                for lo, hi in edges[i].tolist():
                    if hi > lo:
                        rows, more = row[lo:hi], gain[i] * impact[lo:hi]
                        had = total[rows]
                        total[rows] = had + more
                        walked.append(rows[had == 0.0])
                i += 1
                if unbounded and i < need and i > 1 and length[i:need].sum() > 3000 and walked:
                    unbounded = False
                    # The best found so far, scored in full, may show that the long lists that follow need no walk.
                    rows = np.concatenate(walked)
                    score = total[rows]
                    if shown is not None:
                        rows, score = rows[shown[rows]], score[shown[rows]]
                    if len(rows) > 8 * self.k:
                        best = np.argpartition(-score, 8 * self.k)[: 8 * self.k]
                        rows, score = rows[best], score[best]
                    if len(rows) >= self.k:
                        for t in range(i, len(number)):
                            score = score + gain[t] * _looked_up(key, row, impact, int(number[t]), n, rows)
                        order = np.argsort(-score)
                        _, once = np.unique(doc[rows[order]], return_index=True)
                        if len(once) >= self.k:
                            least = max(least, round(float(score[order[np.partition(once, self.k - 1)[self.k - 1]]]), 6) - 1e-6)
                            need = max(i, min(need, int(np.count_nonzero(rest[:-1] >= least))))
            if not walked:
                continue
            rows = np.concatenate(walked) if len(walked) > 1 else walked[0]
            score = total[rows]
            total[rows] = 0.0
            ok = score + rest[need] >= least
            if shown is not None:
                ok &= shown[rows]
            rows, score = rows[ok], score[ok]
            for t in range(need, len(number)):
                if not len(rows):
                    break
                score = score + gain[t] * _looked_up(key, row, impact, int(number[t]), n, rows)
                ok = score + rest[t + 1] >= least
                rows, score = rows[ok], score[ok]
            if len(rows):
                rows_.append(rows)
                scores_.append(score)
        if not rows_:
            return
        rows, score = np.concatenate(rows_), np.round(np.concatenate(scores_), 6)
        old = self.kept[j]
        places, docs = place[rows], doc[rows]
        if old is not None:
            places, docs, score = np.concatenate([old[0], places]), np.concatenate([old[1], docs]), np.concatenate([old[2], score])
        keep = score > 0
        if self.bound[j] > 0:
            keep = score >= self.bound[j]
        places, docs, score = places[keep], docs[keep], score[keep]
        order = np.lexsort((places, -score))
        _, once = np.unique(docs[order], return_index=True)
        order = order[np.sort(once)[: self.k]]
        self.kept[j] = places[order], docs[order], score[order]
        if len(order) == self.k:
            self.bound[j] = score[order[-1]]

    def found(self, names: _Names) -> Iterator[pa.RecordBatch]:
        some = [(j, x) for j, x in enumerate(self.kept) if x is not None and len(x[0])]
        for at in range(0, len(some), 10_000):
            part = some[at : at + 10_000]
            who = np.repeat([j for j, _ in part], [len(x[0]) for _, x in part])
            yield from names.rows_of(self.qids, who, np.concatenate([x[0] for _, x in part]), np.concatenate([x[2] for _, x in part]))


def _cells(questions: DataFrame, items: DataFrame, slices: int, blocks: int) -> DataFrame:
    """Rows of both tables in one task for each slice of the items and block of the questions: its questions (kind 0), then its items (kind 1) by document and key."""
    cell = lambda a, b: (a * blocks + b).cast("int")
    left = questions.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("kind", F.lit(0))
    left = left.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: cell(s, F.col("_b"))))).drop("_b")
    right = items.withColumn("_s", F.pmod(F.xxhash64("doc_id", "chunk_key"), F.lit(slices))).withColumn("kind", F.lit(1))
    right = right.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: cell(F.col("_s"), b)))).drop("_s")
    return left.unionByName(right, allowMissingColumns=True).repartitionById(slices * blocks, F.col("cell")).sortWithinPartitions("cell", "kind", "doc_id", "chunk_key")


#: Questions and names of items that a task holds at most, and questions that are compared at a time.
HELD_QUESTIONS, HELD_NAMES, TOGETHER = 32_768, 1 << 21, 256


def _grid(spark: SparkSession, items: int, item_bytes: int, questions: int, question_bytes: int, found_bytes: int, held: int) -> tuple[int, int]:
    """(slices of the items, blocks of the questions): each pair is one task, which holds its questions and takes its items as a stream. Every slice is copied for each
    block and every block for each slice, whose results add up; of the grids with enough tasks the one that moves the fewest bytes."""
    tasks = min(2 * spark.sparkContext.defaultParallelism, items * questions // (1 << 22) + 1)
    least = max(1, -(-questions // held))
    grids = [(max(-(-tasks // b), -(-items // HELD_NAMES)), b) for b in range(least, max(least, tasks) + 1)]
    return min(grids, key=lambda g: g[1] * items * item_bytes + g[0] * questions * (question_bytes + found_bytes))


def _access() -> Column:
    """What decides who sees an item, as one text; few texts serve many items."""
    return F.to_json(F.struct("tenant", "source", "allowed", "denied"))


@lru_cache(100_000)
def _sees(scope: frozenset, access: str, tenant: str) -> bool:
    """``acl.visible`` for one scope and one text of ``_access``."""
    if not scope:
        return True
    a, labels = json.loads(access), {f"source:{s}" for s in scope}
    return a.get("tenant") == tenant and a.get("source") in scope and bool(labels & set(a.get("allowed") or ())) and not labels & set(a.get("denied") or ())


def _units(lists: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of this length that have a direction, and these vectors at length one."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
    at = np.flatnonzero(lengths == dims)
    values = np.asarray(pc.cast(lists.take(pa.array(at)).flatten(), pa.float64()), np.float64).reshape(len(at), dims)  # null elements become nan
    with np.errstate(invalid="ignore", over="ignore"):
        size = np.sqrt((values * values).sum(1))
    ok = np.isfinite(size) & (size > 0)
    return at[ok], values[ok] / size[ok, None]


def _where(flags: np.ndarray) -> np.ndarray:
    """np.flatnonzero for flags of which few are set: eight are looked at as one number."""
    whole = len(flags) // 8 * 8
    some = (np.flatnonzero(flags[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([some[flags[some]], whole + np.flatnonzero(flags[whole:])])


class _Nearest:
    """The nearest items so far of up to TOGETHER questions of one scope and length.

    Kept of each question, in the order of the ranking: items until k documents have been seen, at most k_chunks. No later one can belong to the answer, whatever other
    tasks find. bound: the score that an item must reach to come in.
    """

    def __init__(self, rows: np.ndarray, q: np.ndarray, k: int, k_chunks: int):
        self.rows, self.q, self.q32, self.k, self.k_chunks = rows, q, q.astype(np.float32), k, k_chunks
        self.bound = np.full(len(rows), -np.inf)
        self.who, self.place, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.score = np.zeros(0)
        self.new: list[tuple] = []
        self.waiting, self.step = 0, 1024
        # Scores of single precision differ from the exact ones by less than the products' rounding; half a unit of the sixth digit is lost by rounding.
        self.slack = (q.shape[1] + 8) * 1.2e-7 + 1.5e-6

    def see(self, x: np.ndarray, x32: np.ndarray, place: np.ndarray, doc: np.ndarray) -> None:
        """Items in the order of their documents and keys; place and doc count up over the whole stream."""
        at = 0
        while at < len(x):
            to = min(len(x), at + self.step)
            near = self.q32 @ x32[at:to].T
            least = self.bound - self.slack
            if (open_ := np.flatnonzero(self.bound == -np.inf)).size:
                starts = np.flatnonzero(np.concatenate([[True], doc[at + 1 : to] != doc[at : to - 1]]))
                if len(starts) > self.k:
                    tops = np.maximum.reduceat(near[open_], starts, axis=1)
                    least[open_] = np.partition(tops, len(starts) - self.k, axis=1)[:, len(starts) - self.k] - 2 * self.slack
            hit = _where((near >= least.astype(np.float32)[:, None]).ravel())
            if len(hit):
                who, i = np.divmod(hit, to - at)
                i += at
                score = np.concatenate([np.einsum("ij,ij->i", self.q[who[c : c + 16384]], x[i[c : c + 16384]]) for c in range(0, len(hit), 16384)])
                self.new.append((who, place[i], doc[i], np.round(score, 6)))
                self.waiting += len(hit)
            if self.waiting > max(len(self.who) // 2, 2 * len(self.rows)):
                self.merge()
            at, self.step = to, min(4096, 2 * self.step)

    def merge(self) -> None:
        if not self.new:
            return
        who, place, doc, score = (np.concatenate([old, *new]) for old, new in zip((self.who, self.place, self.doc, self.score), zip(*self.new, strict=True), strict=True))
        self.new, self.waiting = [], 0
        order = np.lexsort((place, -score, who))
        who, place, doc, score = who[order], place[order], doc[order], score[order]
        starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        begin = np.repeat(starts, np.diff(np.append(starts, len(who))))
        by_doc = np.lexsort((doc, who))  # stable: the first of a document is its best
        first = np.zeros(len(who), bool)
        first[by_doc[np.concatenate([[True], (who[by_doc][1:] != who[by_doc][:-1]) | (doc[by_doc][1:] != doc[by_doc][:-1])])]] = True
        seen = np.cumsum(first)
        before = seen - first - (seen - first)[begin]
        rank = np.arange(len(who)) - begin
        keep = (before < self.k) & (rank < self.k_chunks)
        self.who, self.place, self.doc, self.score = who[keep], place[keep], doc[keep], score[keep]
        last = np.flatnonzero(np.concatenate([self.who[1:] != self.who[:-1], [True]]))
        full = ((before + first)[keep][last] >= self.k) | (rank[keep][last] + 1 >= self.k_chunks)
        self.bound[self.who[last[full]]] = self.score[last[full]]


def dense(
    questions: DataFrame, chunks: DataFrame, k: int = 50, k_chunks: int = 500, tenant: str = "tenant_redwood", scoped: bool = True,
    route: str = "dense", route_ord: int = 0, weight: float = 0.5, shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Exact cosine: the k_chunks nearest chunks of each question among those it may see, then the best chunk of each document, then k documents.

    questions: qid, vector (array of numbers), scope. chunks: chunk_key, doc_id, tenant, source, allowed, denied, vector. Vectors of zeros, with nulls, or of another length than
    the question's have no direction and no score. score is the cosine. Products in single precision leave out what cannot come in, the rest are exact. shard_items: items compared at a time.
    """
    if k <= 0 or k_chunks <= 0:
        raise ValueError("k and k_chunks must be positive")
    items = chunks.filter(F.col("doc_id").isNotNull() & F.col("vector").isNotNull()).select("chunk_key", "doc_id", (_access() if scoped else F.lit("{}")).alias("access"), "vector")
    scope = F.array_sort(F.array_distinct(F.filter(F.coalesce("scope", F.array().cast("array<string>")), lambda s: s.isNotNull()))) if scoped else F.array().cast("array<string>")
    ready = questions.filter("vector is not null").select("qid", scope.alias("scope"), F.col("vector").cast("array<double>").alias("q_vector"))
    n, dims = items.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).collect()[0]
    slices, blocks = _grid(items.sparkSession, n, 4 * dims + 60, ready.count(), 8 * dims + 40, 50 * k, HELD_QUESTIONS)
    k_kept = min(k, k_chunks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        groups: list[tuple[int, frozenset, list[_Nearest]]] | None = None
        waiting, count = [], 0
        names = _Names()

        def ask() -> list[tuple[int, frozenset, list[_Nearest]]]:
            if not held:
                return []
            table = pa.Table.from_batches(held).combine_chunks()
            vectors, out = table["q_vector"].combine_chunks(), []
            scopes = [frozenset(s) for s in table["scope"].to_pylist()]
            for dims_ in {int(x) for x in np.unique(np.asarray(pc.list_value_length(vectors))) if x > 0}:
                rows, q = _units(vectors, dims_)
                by: dict[frozenset, list[int]] = {}
                for j, r in enumerate(rows):
                    by.setdefault(scopes[r], []).append(j)
                for scope_, js in by.items():
                    out.append((dims_, scope_, [_Nearest(rows[part], q[part], k_kept, k_chunks) for c in range(0, len(js), TOGETHER) if len(part := js[c : c + TOGETHER])]))
            return out

        def take() -> None:
            nonlocal waiting, count
            block = pa.Table.from_batches(waiting).combine_chunks()
            waiting, count = [], 0
            place, doc = names.see(block["doc_id"].combine_chunks(), block["chunk_key"].combine_chunks())
            codes = block["access"].combine_chunks().dictionary_encode()
            kinds, code = codes.dictionary.to_pylist(), np.asarray(codes.indices)
            vectors = block["vector"].combine_chunks()
            for dims_ in {d for d, _, _ in groups}:
                rows, x = _units(vectors, dims_)
                x32 = x.astype(np.float32)
                for d, scope_, parts in groups:
                    if d != dims_ or not len(rows):
                        continue
                    sees = np.array([_sees(scope_, a, tenant) for a in kinds], bool)
                    if sees.all():
                        mine, mine32, own = x, x32, rows
                    else:
                        inside = np.flatnonzero(sees[code[rows]])
                        mine, mine32, own = x[inside], x32[inside], rows[inside]
                    for part in parts:
                        part.see(mine, mine32, place[own], doc[own])

        for batch in batches:
            kind = np.asarray(batch.column(batch.schema.get_field_index("kind")))
            if (asked := np.flatnonzero(kind == 0)).size:
                held.append(pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(pa.array(asked)) for c in ("qid", "scope", "q_vector")], ["qid", "scope", "q_vector"]))
            if (given := np.flatnonzero(kind == 1)).size:
                if groups is None:
                    groups = ask()
                waiting.append(pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(pa.array(given)) for c in ("chunk_key", "doc_id", "access", "vector")], ["chunk_key", "doc_id", "access", "vector"]))
                count += len(given)
                if count >= shard_items:
                    take()
        if waiting:
            take()
        if not groups:
            return
        qids = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
        for _, _, parts in groups:
            for part in parts:
                part.merge()
                if len(part.who):
                    yield from names.rows_of(qids, part.rows[part.who], part.place, part.score)

    found = _cells(ready, items, slices, blocks).mapInArrow(search, "qid string, doc_id string, chunk_key string, score double")
    near = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id", "chunk_key")
    found = found.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k_chunks)
    best = found.groupBy("qid", "doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_key")).alias("m")).select("qid", "doc_id", F.col("m.chunk_key").alias("chunk_key"), (-F.col("m.s")).alias("score"))
    return _ranked(best, route, route_ord, weight, k)
