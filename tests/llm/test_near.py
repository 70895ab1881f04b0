import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import neardup, neighbours
from rankloom.llm.graph import VectorGraph

WORD = re.compile(r"[^\W_]+")


def shingles(title, text, width):
    w = WORD.findall(f"{title or ''} {text}".lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def corpus(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ärger", "上海", "x9"]
    boiler = " ".join(rng.choices(words, k=30))
    data = []
    for g in range(60):
        base = rng.choices(words, k=rng.randrange(20, 90))
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(words)
            data.append((f"d{len(data):04d}", rng.choice([None, "T"]), " ".join(w) + (" " + boiler if g % 3 == 0 else ""), "z"))
    hot = " ".join(rng.choices(words, k=40))
    data += [(f"h{i:03d}", None, hot, "z") for i in range(30)] + [("n1", None, None, "z"), ("n2", "t", "  ", "z"), ("s", None, "two words", "z"), (None, None, "a b c d e f g", "z")]
    return data


@pytest.mark.parametrize("width, threshold, bucket", [(3, 0.6, 1000), (5, 0.8, 3)])
def test_pairs_against_brute_force(spark, width, threshold, bucket):
    data = corpus()
    found = neardup.NearDuplicates(spark.createDataFrame(data, "id string, title string, text string, a string"), "id", "text", "title", threshold, width, bucket)
    sets = {i: shingles(t, x, width) for i, t, x, _ in data if i and x and x.strip()}
    sets = {i: s for i, s in sets.items() if s}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    got = [tuple(r) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # Few expanded copies: the others stay reachable over their representative.
    few = {tuple(r) for r in found.pairs(expand=5).collect()}
    assert few < want and {("h000", f"h{i:03d}") for i in range(1, 30)} <= few
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(want):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    classes = {r["id"]: r["class_id"] for r in found.classes().collect()}
    assert classes == {i: root(i) for i in sets}


def test_hot_band_is_no_quadratic_bucket(spark):
    n = 20_000
    rng = np.random.default_rng(4)
    bands = rng.integers(0, 2**62, (n, neardup.BANDS))
    bands[:, 7] = 42  # all share one band, as by a standard paragraph
    bands[10:13, 20:30] = bands[10, 20:30]  # three that share much more
    reps = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(bands)], "num long, bands array<long>")
    found = neardup._buckets(reps, 1000).groupBy("band").agg(F.count("*").alias("n"), F.max("num").alias("most")).collect()
    assert max(r["n"] for r in found) == 3 and all(r["most"] == 12 for r in found)
    # Only hot bands in common: they meet under longer keys.
    bands[:, 20:30] = bands[0, 20:30]
    reps = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(bands[:50])], "num long, bands array<long>")
    assert {r["num"] for r in neardup._buckets(reps, 10).filter("n = 50").collect()} == set(range(50))


def test_pair_that_shares_one_hot_band_alone(spark):
    rng = random.Random(8)
    paragraph = [f"p{i}" for i in range(47)]
    ends = [[f"e{k}x{i}" for i in range(15)] for k in range(200)]
    tails = [[f"t{k}x{i}" for i in range(rng.randrange(60, 90))] for k in range(300)]
    shingle = neardup.Shingler(3)
    keys = neardup.band_keys(neardup.minima([shingle(" ".join(paragraph + w)) for w in ends + tails]))
    shared = keys[:200, None] == keys[None, :200]
    one = shared.sum(2) == 1
    holders = (keys[:, None] == keys[None, :200]).sum(0)  # of each key of the first 200
    i, j = next((i, j) for i, j in np.argwhere(one) if i < j and holders[i, shared[i, j].argmax()] > 6)
    texts = {"a": ends[i], "b": ends[j]} | {f"t{k:03d}": w for k, w in enumerate(tails)}
    data = [(key, " ".join(paragraph + w)) for key, w in texts.items()]
    sets = {key: shingles(None, x, 3) for key, x in data}
    assert {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])} == {("a", "b")}
    found = neardup.NearDuplicates(spark.createDataFrame(data, "id string, text string"), "id", "text", threshold=0.6, width=3, bucket_rows=4)
    assert [tuple(r) for r in found.pairs().collect()] == [("a", "b")]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 1.0])
def test_triples_lose_no_pair_and_leave_the_standard_paragraph(spark, threshold):
    rng = np.random.default_rng(6)
    sets = {}
    for num in range(300):
        base = np.random.default_rng(num // 5).permutation(120)[: 40 + num // 5]  # groups over few hashes, of all sizes
        own = base[rng.random(len(base)) < rng.choice([0.8, 0.95, 1.0])]
        sets[num] = np.unique(np.concatenate([own, 1000 + np.arange(rng.integers(0, 30))]))
    for num in range(300, 340):  # half a paragraph, half their own
        sets[num] = np.concatenate([5000 + np.arange(50), 10_000 + 100 * num + np.arange(50)])
    rows = neardup._by_triples(spark.createDataFrame([(k, v.tolist()) for k, v in sets.items()], "num long, hashes array<long>"), threshold).collect()
    firsts, others = {}, {}
    for r in rows:
        others.setdefault(r["band"], set()).add(r["num"])
        if r["first"]:
            firsts.setdefault(r["band"], set()).add(r["num"])
    met = {(a, b) for band, nums in firsts.items() for a in nums for b in others[band]}
    like = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a in sets for b in sets if a < b}
    want = {tuple(sorted(p, key=lambda k: (len(sets[k]), k))) for p, s in like.items() if s >= threshold}
    assert want <= met and (threshold == 1 or len(want) > 100)
    if threshold >= 0.6:
        assert not any(r["num"] >= 300 for r in rows)


def test_hot_texts_against_brute_force(spark):
    data = corpus(7)
    found = neardup.NearDuplicates(spark.createDataFrame(data, "id string, title string, text string, a string"), "id", "text", "title", 0.6, 3, 1)
    sets = {i: s for i, t, x, _ in data if i and x and x.strip() and (s := shingles(t, x, 3))}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in found.pairs().collect()} == want


def test_equal_sets_of_different_texts_are_all_paired(spark):
    words = " ".join(f"w{i}" for i in range(30))
    data = [(f"a{i}", words, "t") for i in range(6)] + [(f"b{i}", words.upper() + "!" * i, "t") for i in range(3)]
    found = neardup.NearDuplicates(spark.createDataFrame(data, "id string, text string, title string"), "id", "text", "title", 0.6, 3)
    got = {tuple(r) for r in found.pairs(expand=4).collect()}
    ids = ["a0", "b0", "b1", "b2"]
    assert got == {("a0", f"a{i}") for i in range(1, 6)} | {(x, y) for x in ids for y in ids if x < y}
    assert len(found.pairs().collect()) == 9 * 8 // 2


def test_empty_near(spark):
    none = spark.createDataFrame([], "id string, text string")
    found = neardup.NearDuplicates(none, "id", "text")
    assert found.pairs().count() == 0 and found.classes().count() == 0
    with pytest.raises(ValueError):
        neardup.NearDuplicates(none, "id", "text", threshold=0.1)


def test_estimate_is_near_the_truth(spark):
    rng = np.random.default_rng(0)
    sets = []
    for share in (0.2, 0.5, 0.8, 1.0):
        a = rng.integers(0, 2**63, 3000, np.uint64)
        k = int(len(a) * share)
        sets += [np.unique(a), np.unique(np.concatenate([a[:k], rng.integers(0, 2**63, 3000 - k, np.uint64)]))]
    sig = neardup.packed(neardup.minima(sets)).view(np.int64)
    from pyspark.sql import functions as F

    for i in range(0, len(sets), 2):
        truth = len(np.intersect1d(sets[i], sets[i + 1])) / len(np.union1d(sets[i], sets[i + 1]))
        lit = lambda row: [F.lit(int(x)) for x in row]
        got = spark.range(1).select(neardup.estimate(lit(sig[i]), lit(sig[i + 1]))).collect()[0][0]
        assert abs(got - truth) < 0.17


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300)]
    ends = spark.createDataFrame(chain + [(b, a) for a, b in chain], "u long, v long")
    assert {r["u"]: r["label"] for r in neardup.components(ends).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def unit(n, d=64, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_graph_recall():
    x, q = unit(3000, 16), unit(100, 16, 1)
    ids, sims = VectorGraph(x).search(q, 64)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(truth, ids, strict=True)]) > 0.95
    assert np.all(np.diff(sims, axis=1) <= 0)


def test_tiny_graphs():
    assert len(VectorGraph(unit(0)).edges) == 0
    ids, _ = VectorGraph(unit(1)).search(unit(2, seed=3), 4)
    assert ids.tolist() == [[0, -1, -1, -1]] * 2
    same = np.repeat(unit(1), 5, axis=0)
    assert (VectorGraph(same).search(same, 3)[0] >= 0).all(0)[0]


def nearest(items, keys, k):
    good = {}
    for key, v, at in items:
        if key is not None and v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v) and any(v):
            if key not in good or at >= good[key][0]:
                good[key] = (at, np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)))
    names = sorted(good)
    x = np.array([good[n][1] for n in names])
    out = {}
    for q in set(keys) & set(names):
        s = x @ good[q][1]
        order = sorted((-round(float(s[i]), 12), names[i]) for i in range(len(names)) if names[i] != q)
        out[q] = order[:k]
    return out


def test_nearest_against_brute_force(spark):
    x = unit(900)
    rng = np.random.default_rng(5)
    items = [(f"k{i:04d}", (x[i] * rng.uniform(0.01, 50)).astype(float).tolist(), i) for i in range(900)]
    items += [("n1", None, 0), ("z", [0.0] * 64, 0), ("short", [1.0], 0), ("hole", [None] + [1.0] * 63, 0), ("nan", [float("nan")] * 64, 0), (None, x[0].tolist(), 0)]
    items += items[:50] + [("k0001", x[700].astype(float).tolist(), 10**6)]
    items += [(f"copy{i:03d}", (x[5] * (i + 1)).astype(float).tolist(), 0) for i in range(40)]
    df = spark.createDataFrame(items, "key string, v array<float>, at long")
    asked = [f"k{i:04d}" for i in range(0, 900, 30)] + ["k0005", "copy000", "z", "absent", None]
    queries = spark.createDataFrame([(a,) for a in asked], "key string")
    got = {}
    for r in neighbours.nearest(df, queries, "key", "v", k=10, latest="at", shard_vectors=300).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"], r["similarity"]))
    want = nearest(items, asked, 10)
    assert set(got) == set(want)
    hit = np.mean([len({n for _, n, _ in got[q]} & {n for _, n in want[q]}) / 10 for q in want if not q.startswith(("k0005", "copy"))])
    assert hit >= 0.95
    assert [n for _, n, _ in sorted(got["k0005"])] == [f"copy{i:03d}" for i in range(10)]
    assert [n for _, n, _ in sorted(got["copy000"])][-1] in ("k0005", "copy010")
    assert all(len(v) == 10 for v in got.values())


def test_cells_and_shards():
    x = unit(4000, 16)
    centres = neighbours.cells_of(x, 64)
    at = (x @ centres.T).argmax(1)
    counts = np.bincount(at, minlength=64)
    counts[5] += 5000  # one cell holds more than half
    first, parts = neighbours.shards_of(centres, counts, 700)
    load = np.zeros(int((first + parts).max()))
    for c in range(64):
        load[first[c] : first[c] + parts[c]] += counts[c] / parts[c]
    assert load.max() <= 700 and (load > 0).all() and parts[5] == -(-counts[5] // 700) and (np.delete(parts, 5) == 1).all()


def test_routed_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_CELLS", 128)
    monkeypatch.setattr(neighbours, "PROBED_CELLS", 24)
    rng = np.random.default_rng(12)
    x = unit(60)[rng.integers(0, 60, 4000)] * 1.5 + rng.normal(size=(4000, 64)) / 8  # gathered around topics
    third = x[7] + rng.normal(size=(1500, 64)) * 1e-4  # and a third side by side
    items = [(f"k{i:04d}", v.astype(np.float32).astype(float).tolist(), 0) for i, v in enumerate(np.concatenate([x, third]))]
    df = spark.createDataFrame(items, "key string, v array<float>, at long")
    asked = [f"k{i:04d}" for i in range(0, 5500, 25)]
    found = neighbours.nearest(df, spark.createDataFrame([(a,) for a in asked], "key string"), "key", "v", shard_vectors=300)
    got, want = {}, nearest(items, asked, 10)
    for r in found.collect():
        got.setdefault(r["query"], set()).add(r["neighbour"])
    assert np.mean([len(got[q] & {n for _, n in want[q]}) / 10 for q in asked]) >= 0.97
    assert np.mean([len(got[q] & {n for _, n in want[q]}) / 10 for q in asked if q >= "k4000"]) >= 0.97


def test_few_vectors(spark):
    df = spark.createDataFrame([("a", [1.0] * 64), ("b", [2.0] * 64), ("c", [-1.0] * 64)], "key string, v array<float>")
    got = sorted(tuple(r) for r in neighbours.nearest(df, df, "key", "v").select("query", "neighbour", "rank").collect())
    assert got == [("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 2), ("c", "a", 1), ("c", "b", 2)]
    assert neighbours.nearest(df.limit(0), df, "key", "v").count() == 0
    assert neighbours.nearest(df, df.limit(0), "key", "v").count() == 0


@pytest.mark.parametrize("jitter", [1e-7, 1e-5, 5e-5])
def test_nearest_among_nearly_equal(spark, jitter):
    rng = np.random.default_rng(11)
    x = unit(600).astype(np.float64)
    x[400:] = x[400] + np.abs(x[400]).max() * rng.uniform(-jitter, jitter, (200, 64))
    items = [(f"k{i:03d}", x[i].astype(np.float32).astype(float).tolist(), 0) for i in range(600)]
    asked = [f"k{i:03d}" for i in range(400, 600, 20)]
    df, queries = spark.createDataFrame(items, "key string, v array<float>, at long"), spark.createDataFrame([(a,) for a in asked], "key string")
    got = {}
    for r in neighbours.nearest(df, queries, "key", "v", k=10, shard_vectors=300).collect():
        got.setdefault(r["query"], set()).add(r["neighbour"])
    want = nearest(items, asked, 10)
    assert got == {q: {n for _, n in want[q]} for q in asked}


def test_groups_do_not_chain():
    angle = np.arange(3000) * 4e-4
    order, start, reach = neighbours.near_groups(np.stack([np.cos(angle), np.sin(angle)], 1))
    assert sorted(order) == list(range(3000)) and start[-1] == 3000
    assert len(reach) > 100 and reach.max() <= neighbours.RADIUS
