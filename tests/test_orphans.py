import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from rankloom.operators import orphans
from rankloom.operators.current import current_rows
from rankloom.shared import heat_join

REF = "id string, keys array<string>, at timestamp_ntz"
ONE = "id string, key string, at timestamp_ntz"


def brute(refs, parents, removed):
    norm = lambda k: (k or "").strip(" ").lower()
    out = set()
    for name, rid, keys, at in refs:
        for k in map(norm, keys or []):
            if not k:
                continue
            arrivals = [a for p, a in parents if norm(p) == k]
            why = None
            if not arrivals:
                why = "missing"
            elif at is None:
                continue
            elif None not in arrivals and min(arrivals) > at:
                why = "late"
            elif any(norm(p) == k and d is not None and d <= at and not any(a is not None and d < a <= at for a in arrivals) for p, d in removed):
                why = "deleted"
            if why:
                out.add((name, rid, k, at and at.strftime("%Y-%m"), why))
    return out


def run(spark, lists, singles, parents, removed, **more):
    refs = [
        orphans.references("questions", spark.createDataFrame(lists, REF), F.col("id"), F.col("keys"), F.col("at")),
        orphans.references("acl_docs", spark.createDataFrame(singles, ONE), F.col("id"), F.col("key"), F.col("at")),
    ]
    found = orphans.orphans(refs, spark.createDataFrame(parents, "key string, at timestamp_ntz"), spark.createDataFrame(removed, "key string, gone timestamp_ntz"), **more)
    return found, brute([("questions", *r) for r in lists] + [("acl_docs", i, [k], at) for i, k, at in singles], parents, removed)


def test_bitmaps():
    rng = np.random.default_rng(1)
    kinds = set()
    for size in (1, 9, 24_576, 70_000):
        for numbers in ([], [0], range(size), range(size // 3, size // 2), rng.integers(0, size, size), rng.integers(0, size, 1 + size // 50)):
            b = orphans.Bitmap(np.array(list(numbers), np.int64), size)
            kinds.add(b.kind)
            assert b.numbers().tolist() == sorted(set(map(int, numbers))) and b.data.nbytes <= -(-size // 8)
    assert kinds == {"array", "runs", "bits"}


def test_heat_join(spark):
    rng = random.Random(3)
    left = [(rng.choice(["hot", "hot", "a", "b", None]), i) for i in range(600)]
    right = [("hot", "x"), ("hot", "y"), ("a", "z"), (None, "n"), ("c", "w")]
    ldf, rdf = spark.createDataFrame(left, "k string, i int"), spark.createDataFrame(right, "k string, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, ldf.join(rdf, "k", how).collect()), key=repr)
        for limit in (0, 1 << 20):
            assert sorted(map(tuple, heat_join(ldf, rdf, ["k"], how, 20, limit).collect()), key=repr) == want
    other = rdf.withColumnRenamed("k", "o")
    want = sorted(map(tuple, ldf.join(other, ldf["k"].eqNullSafe(other["o"])).select("k", "i", "v").collect()), key=repr)
    assert sorted(map(tuple, heat_join(ldf, rdf, ["k"], "inner", 20, 0, nulls=True).collect()), key=repr) == want


def test_random_tables_against_brute_force(spark):
    rng = random.Random(4)
    day = lambda: datetime(2025, 1, 1) + timedelta(hours=rng.randrange(24 * 150))
    key = lambda: rng.choice([f"k{rng.randrange(40)}", f" K{rng.randrange(40)} ", "hot"])
    lists = [(f"q{i}", rng.choice([None, [], [key(), None, " ", key()], [key()] * 2]), day() if rng.random() > 0.05 else None) for i in range(150)]
    singles = [(str(i), rng.choice([key(), None, ""]), day()) for i in range(150)]
    parents = [(key(), day() if rng.random() > 0.03 else None) for _ in range(60)]
    removed = [(key(), day() if rng.random() > 0.1 else None) for _ in range(30)]
    found, want = run(spark, lists + lists[:5], singles, parents, removed, range_keys=10, least=20)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert {r[-1] for r in want} == {"missing", "late", "deleted"}
    report = orphans.orphan_report(found).collect()
    assert sum(r["references"] for r in report) == len(want)


def test_month_edges(spark):
    first = datetime(2025, 3, 1)
    at = [first, first - timedelta(microseconds=1), first + timedelta(days=30, hours=23)]
    found, want = run(spark, [(f"q{i}", ["a"], t) for i, t in enumerate(at)], [], [("a", first)], [("a", datetime(2025, 4, 1))])
    assert {tuple(r) for r in found.collect()} == want == {("questions", "q1", "a", "2025-02", "late")}


def test_empty_tables(spark):
    found, want = run(spark, [], [], [], [])
    assert found.count() == 0 and not want
    found, want = run(spark, [("q", ["a"], datetime(2025, 1, 1))], [], [], [])
    assert {tuple(r) for r in found.collect()} == want


def test_current_rows(spark, rows):
    df = spark.createDataFrame([(1, "a", "x"), (3, "a", None), (2, "b", "y"), (None, "b", "z"), (5, None, "n")], "line_no long, k string, t string")
    assert rows(current_rows(df, "k", "line_no", ["t"])) == [("a", None), ("b", "y")]
