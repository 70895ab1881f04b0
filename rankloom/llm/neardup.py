"""Near-duplicate texts by b-bit MinHash: signatures, bands, bit-count estimates, an exact check, classes.

1. Each text's set of word triples is hashed; 256 minima are taken. Their two low bits are packed into 8 words; groups of 4 minima are hashed into 64 band keys.
2. Texts with the same set are one class and go on as one representative.
3. Representatives that share a band key meet in a join whose condition is the estimate from bit counts, corrected for chance collisions of two bits; only
   pairs that may reach the threshold leave the join. A band key of more than ``BUCKET_ROWS`` texts, such as a standard paragraph makes, is no bucket itself: all texts that hold a hot key
   meet by the rarest triples that they share, where no pair at the threshold is lost (``_by_triples``).
4. Those pairs are checked exactly on the sets of triples.

At a similarity of 0.6 a pair shares no band with probability (1 - 0.6^4)^64 = 0.00014, and the estimate's margin of 0.17 is 4.5 standard deviations. Hot bands add nothing to that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import WORD_PATTERN
from rankloom.shared import cut, heat_join, stored

BANDS, ROWS, BITS = 64, 4, 2
MINIMA = BANDS * ROWS
WORDS = MINIMA * BITS // 64
MARGIN = 0.17
#: Rows of a band key that one task compares with each other; the texts of hotter keys meet by their triples, and what is still larger is cut into blocks of this size.
BUCKET_ROWS = 1000
#: So many longer keys are made of a hot one.
LONGER = 24
#: Exact copies of a text up to this number are written as all their pairs; larger groups as pairs with their first.
EXPAND_COPIES = 100

_A = np.random.default_rng(20).integers(0, 2**64, MINIMA, np.uint64) | np.uint64(1)
_B = np.random.default_rng(21).integers(0, 2**64, MINIMA, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of consecutive word runs as sorted 64-bit hashes."""

    def __init__(self, width: int = 3):
        self.find, self.width, self.known = regex.compile(WORD_PATTERN).findall, width, {}

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        ids = []
        for w in self.find(text.lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            ids.append(h)
        if len(ids) < self.width:
            return np.zeros(0, np.uint64)
        ids = np.array(ids, np.uint64)
        n = len(ids) - self.width + 1
        out = ids[:n]
        for k in range(1, self.width):
            out = _mix(out) + ids[k : k + n]
        return np.unique(_mix(out))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, MINIMA) minima of 32 bits; every set holds at least one hash."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), MINIMA), np.uint64)
    for i in range(MINIMA):
        out[:, i] = np.minimum.reduceat((flat * _A[i] + _B[i]) >> np.uint64(32), starts)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """(sets, WORDS): the BITS low bits of each minimum, 32 minima to a word."""
    low = (m & np.uint64(2**BITS - 1)).reshape(len(m), WORDS, -1)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)


def band_keys(m: np.ndarray) -> np.ndarray:
    groups = m.reshape(len(m), BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(m), 0)
    for k in range(ROWS):
        out = _mix(out + np.uint64(0x9E3779B97F4A7C15)) + groups[:, :, k]
    return _mix(out)


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Similarity from packed signatures: matches beyond those that chance makes, (share - 1/4) / (3/4) at two bits."""
    pattern = F.lit(0x5555555555555555)

    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(pattern))

    misses = reduce(lambda p, q: p + q, (differ(x, y) for x, y in zip(a, b, strict=True)))
    chance = 2.0**-BITS
    return ((1.0 - misses / F.lit(float(MINIMA))) - chance) / (1 - chance)


def _texts(docs: DataFrame, key: str, title: str | None, text: str) -> DataFrame:
    whole = F.col(text) if title is None else F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.col(text))
    return docs.filter(F.col(key).isNotNull() & F.col(text).rlike(r"\S")).select(F.col(key).alias("id"), whole.alias("text"))


def _signatures(texts: DataFrame, width: int) -> DataFrame:
    """id, same (hash of the whole set), exact (hash of the text), bands, s0 .. s7; texts with fewer words than a shingle's width give no row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                sets = [shingle(t) for t in part["text"]]
                keep = [i for i, s in enumerate(sets) if len(s)]
                if not keep:
                    continue
                m = minima([sets[i] for i in keep])
                sig = packed(m).view(np.int64)
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy()[keep], "same": [xxhash.xxh3_128_digest(sets[i].tobytes()) for i in keep],
                        "exact": [xxhash.xxh3_128_digest(t.encode()) for t in part["text"].iloc[keep]], "bands": list(band_keys(m).view(np.int64)),
                    }
                    | {f"s{w}": sig[:, w] for w in range(WORDS)}
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInPandas(each, f"id {kind}, same binary, exact binary, bands array<bigint>, " + ", ".join(f"s{w} bigint" for w in range(WORDS)))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "hashes": [shingle(t).view(np.int64) for t in batch["text"]]})

    return texts.mapInPandas(each, f"id {texts.schema['id'].dataType.simpleString()}, hashes array<bigint>")


def _counted(rows: DataFrame) -> DataFrame:
    """The rows whose key occurs more than once, with its number n. Most keys occur once; a hot key is dealt to many tasks."""
    counts = stored(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bands")
    return heat_join(rows, counts, ["band"])


def _shared(reps: DataFrame) -> DataFrame:
    """num, pos, band, n: each representative under each band key that it shares with others."""
    return stored(_counted(reps.select("num", F.posexplode("bands").alias("pos", "band"))), "shared")


def _buckets(reps: DataFrame, bucket_rows: int, longer: int = LONGER, met: DataFrame | None = None) -> DataFrame:
    """num, band, n: each representative under each key that it shares with others; hot keys give way to longer ones, or with ``longer`` 0 to none. Longer keys do not hold all pairs of a
    hot one, so the search takes none and finds those pairs by ``_by_triples``."""
    met = _shared(reps) if met is None else met
    light = met.filter(F.col("n") <= bucket_rows).select("num", "band", "n")
    hot = met.filter(F.col("n") > bucket_rows)
    if not longer or not hot.limit(1).count():
        return light
    own = hot.select("num", "pos", "band").join(reps.select("num", "bands"), "num")
    places = F.transform(F.sequence(F.lit(1), F.lit(longer)), lambda j: F.xxhash64("band", F.element_at("bands", ((F.col("pos") + j) % BANDS + 1).cast("int"))))
    return light.unionByName(_counted(own.select("num", F.explode(places).alias("band"))).select("num", "band", "n"))


def _by_triples(sets: DataFrame, threshold: float) -> DataFrame:
    """num, band, n, size, place, first: texts under the hashes of their own sets, such that every pair of them at or above the threshold shares one, first being true for the smaller text.

    Hashes that others hold stand in one order for all texts, the commonest first. Let c be the common hashes of a pair at similarity t: the rarest of them has at least c - 1 before it in both
    texts, c >= 2t / (1 + t) times the smaller set and c >= t times the larger. So only places from there on are kept: a standard paragraph's hashes stand before them unless the texts are
    little else.
    """
    t = threshold - 1e-9
    # Of an id's several texts each is ordered by itself.
    sets = stored(sets.withColumn("row", F.xxhash64("num", "hashes")), "sets")
    sizes = sets.select("row", "num", F.size("hashes").alias("size")).distinct()
    placed = _counted(sets.select("row", F.explode("hashes").alias("band"))).withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("n"), "band")))
    late = stored(placed.drop("n").join(sizes, "row").filter(F.col("place") >= F.ceil(F.col("size") * t)).drop("row"), "late")
    return stored(_counted(late).withColumn("first", F.col("place") >= F.ceil(F.col("size") * (2 * t / (1 + t)))), "rare")


def _meet(rows: DataFrame, reps: DataFrame, threshold: float, bucket_rows: int, test: Column, first: Column | None = None) -> DataFrame:
    """Pairs a, b of row numbers that share a band key, pass the test on the columns a_.. and b_.. of both, and whose estimate may reach the threshold. Only rows with ``first`` are a."""
    sig = [f"s{w}" for w in range(WORDS)]
    kept = [c for c in rows.columns if c not in ("band", "n")] + sig
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / bucket_rows).cast("int")).join(reps.select("num", *sig), "num")
    # Every row stands in one block of its bucket and meets all rows of the bucket there: a large bucket becomes many tasks' work.
    block = F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int")
    left = (rows if first is None else rows.filter(first)).select("band", block.alias("block"), *[F.col(c).alias(f"a_{c}") for c in kept])
    right = rows.select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"b_{c}") for c in kept])
    near = estimate([left[f"a_{s}"] for s in sig], [right[f"b_{s}"] for s in sig]) >= threshold - MARGIN
    met = left.join(right, (left["band"] == right["band"]) & (left["block"] == right["block"]) & test & near)
    return met.select(F.least("a_num", "b_num").alias("a"), F.greatest("a_num", "b_num").alias("b"))


def _candidates(reps: DataFrame, texts: DataFrame, width: int, threshold: float, bucket_rows: int) -> DataFrame:
    """Pairs a < b of row numbers that share a band key and whose estimate may reach the threshold; each pair once. Of the pairs that share hot keys only, those whose sets reach it."""
    met = _shared(reps)
    pairs = _meet(_buckets(reps, bucket_rows, 0, met), reps, threshold, bucket_rows, F.col("a_num") < F.col("b_num"))
    hot = met.filter(F.col("n") > bucket_rows).select("num").distinct()
    if hot.limit(1).count():
        held = texts.join(reps.join(hot, "num", "left_semi").select("id").distinct(), "id", "left_semi")
        rows = _by_triples(_sets(held, width).select(F.xxhash64("id").alias("num"), "hashes"), threshold)
        # The rarest common hash also bounds what is common to the two texts.
        t = threshold - 1e-9
        may = F.least("a_place", "b_place") * (1 + t) >= (F.col("a_size") + F.col("b_size")) * t
        ordered = F.struct("a_size", "a_num") < F.struct(F.col("b_size").alias("a_size"), F.col("b_num").alias("a_num"))
        pairs = pairs.unionByName(_meet(rows, reps, threshold, bucket_rows, (F.col("a_num") != F.col("b_num")) & may & ordered, F.col("first")))
    return pairs.distinct()


class NearDuplicates:
    """Near-duplicate records of a table.

    key: unique id; rows with null key or null or blank text take no part, nor do texts of fewer than ``width`` words. A null title counts as empty. Of repeated keys the rows are taken as
    copies or near-copies of each other under one id. Other columns are not read. An empty table gives empty results.

    ``members``: id, rep, exact: every text with the smallest id of its class of equal sets and that of its exact copies. ``links``: a, b, similarity between representatives, all pairs at or above the threshold.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, title: str | None = None, threshold: float = 0.8, width: int = 5, bucket_rows: int = BUCKET_ROWS):
        if not 0.3 <= threshold <= 1:
            raise ValueError("bands and margin are made for thresholds from 0.3 to 1; below 0.6 they lose links")
        texts = _texts(docs, key, title, text)
        self.key = key
        # Row numbers are hashes of ids: a rare collision makes a candidate more, which the exact check judges by the ids' own texts.
        signed = stored(_signatures(texts, width).withColumn("num", F.xxhash64("id")), "signatures")
        first = signed.groupBy("same", F.col("exact").alias("_exact")).agg(F.min("id").alias("exact"))
        classes = stored(first.withColumn("rep", F.min("exact").over(Window.partitionBy("same"))), "classes")
        # A class that holds a third of all texts is dealt to many tasks; where copies are few, classes of one need no row.
        held = stored(heat_join(signed.select("id", "same", F.col("exact").alias("_exact")), classes, ["same", "_exact"]).select("id", "rep", "exact", "same").distinct(), "members")
        copies = stored(held.filter("id <> rep").select("id", "same"), "copies")
        reps = stored(heat_join(signed, copies, ["id", "same"], "left_anti").drop("same", "exact"), "reps")
        self.members = held.select("id", "rep", "exact").distinct()
        pairs = cut(_candidates(reps, texts, width, threshold, bucket_rows))
        used = pairs.select(F.col("a").alias("num")).union(pairs.select(F.col("b").alias("num"))).distinct()
        wanted = reps.select("num", "id").join(used, "num").select("id").distinct()
        sets = _sets(texts.join(wanted, "id", "left_semi"), width).dropDuplicates(["id"]).withColumn("num", F.xxhash64("id"))
        sets = cut(sets.join(reps.select("id").distinct(), "id", "left_semi"))
        both = pairs.join(sets.select(F.col("num").alias("a"), F.col("id").alias("i"), F.col("hashes").alias("x")), "a")
        both = both.join(sets.select(F.col("num").alias("b"), F.col("id").alias("j"), F.col("hashes").alias("y")), "b")
        both = both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "x", "y").filter("a <> b")
        common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("n"))
        exact = common.withColumn("similarity", F.col("c") / (F.col("n") - F.col("c"))).filter(F.col("similarity") >= threshold - 1e-12)
        self.links = cut(exact.select("a", "b", "similarity").distinct())

    def pairs(self, expand: int = EXPAND_COPIES) -> DataFrame:
        """All pairs id_a < id_b at or above the threshold. Only exact copies of one text are written in short when they are more than ``expand``: as pairs with their first, which
        stands for them in all other pairs and to which ``members`` leads from each copy."""
        size = self.members.groupBy("exact").agg(F.count(F.lit(1)).alias("_n"))
        sized = stored(heat_join(self.members, size, ["exact"]), "sized")
        # rep -> the ids that stand for it in pairs.
        stand = sized.filter((F.col("_n") <= expand) | (F.col("id") == F.col("exact"))).select("rep", "id")
        between = self.links.select("a", "b").join(stand.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(stand.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
        more = self.members.filter("id <> rep").select("rep").distinct()
        several = heat_join(stand, more, ["rep"], "left_semi")
        within = several.select("rep", F.col("id").alias("x")).join(several.select("rep", F.col("id").alias("y")), "rep").filter("x < y").select("x", "y")
        many = sized.filter((F.col("_n") > expand) & (F.col("id") != F.col("exact"))).select(F.col("exact").alias("x"), F.col("id").alias("y"))
        out = between.unionByName(within).unionByName(many)
        return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def classes(self) -> DataFrame:
        """One row per text: id, class_id (the smallest id reached over links and copies), links (to other representatives)."""
        ends = self.links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        ends = ends.unionByName(self.links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        label = cut(components(ends))
        degree = ends.groupBy("u").agg(F.count(F.lit(1)).alias("links"))
        out = self.members.join(label.select(F.col("u").alias("rep"), "label"), "rep", "left").join(degree.withColumnRenamed("u", "rep"), "rep", "left")
        return out.select("id", F.coalesce("label", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def components(ends: DataFrame) -> DataFrame:
    """u, label: the smallest node of each node's component, for symmetric edges u, v.

    Each round a node takes the smallest label among its neighbours and then that label's own label, which shortens paths; rounds end when
    none changes. Labels stay in the shared folder between rounds.
    """
    label = cut(ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("label")))
    ends = cut(ends)
    while True:
        near = ends.join(label.select(F.col("u").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        step = label.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "l").alias("m"))
        jump = step.join(label.select(F.col("u").alias("m"), F.col("label").alias("j")), "m", "left")
        after = cut(jump.select("u", "old", F.least("m", F.coalesce("j", "m")).alias("label")))
        if not after.filter("label <> old").limit(1).count():
            return after.select("u", "label")
        label = after.select("u", "label")
