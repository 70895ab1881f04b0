import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm import ranking

SCHEMA = "run string, q string, route string, doc string, chunk int, score double, extra string"


def table(spark, n=3000, seed=1):
    rng = random.Random(seed)
    score = lambda: rng.choice([None, math.nan, float(rng.randrange(12)), round(rng.gauss(0, 100), 1), -0.0, math.inf])
    data = []
    for i in range(n):
        q = rng.choice(["hot", "hot", "hot", "a", "b", None])
        data.append(("r", q, rng.choice(["x", "y"]), rng.choice(["d1", None, f"d{rng.randrange(400)}"]), rng.randrange(3), score(), str(i)))
    return spark.createDataFrame(data + data[: n // 5], SCHEMA), data


def live(data):
    best = {}
    for run, q, route, doc, chunk, score, _ in data:
        if score is not None and not math.isnan(score):
            key = (run, q, route, doc, chunk)
            best[key] = max(score, best.get(key, -math.inf))
    return best


def first_null(x):
    return (x is not None, x or 0)


@pytest.mark.parametrize("least", [100, 10**9])
def test_top_n_against_brute_force(spark, least):
    df, data = table(spark)
    got = [tuple(r) for r in ranking.top_n(df, ["run", "q", "route"], "score", ["doc", "chunk"], 5, least).collect()]
    groups = {}
    for (run, q, route, doc, chunk), s in live(data).items():
        groups.setdefault((run, q, route), []).append((-s, (doc is not None, doc or ""), chunk, doc, s))
    want = {(*g, r[3], r[2], r[4], i + 1) for g, rows in groups.items() for i, r in enumerate(sorted(rows, key=lambda r: r[:3])[:5])}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("least", [100, 10**9])
def test_fusion_against_brute_force(spark, least):
    df, data = table(spark, seed=2)
    got = {(r["run"], r["q"], r["doc"]): r["fused"] for r in ranking.fuse(df, ["run", "q"], "route", "doc", "score", 60, least).collect()}
    best = {}
    for (run, q, route, doc, _), s in live(data).items():
        if doc is not None:
            best.setdefault((run, q, route), {})
            best[run, q, route][doc] = max(s, best[run, q, route].get(doc, -math.inf))
    want = {}
    for (run, q, _), docs in best.items():
        for d, s in docs.items():
            want[run, q, d] = want.get((run, q, d), 0) + 1 / (60 + 1 + sum(x > s for x in docs.values()))
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-11) for k in want)


def test_scale_does_not_matter(spark):
    data = [("r", "q", "x", d, 0, s, "") for d, s in (("a", 3.0), ("b", 2.0), ("c", 1.0))] + [("r", "q", "y", d, 0, s, "") for d, s in (("b", 9000.0), ("a", 8000.0), ("c", -5.0))]
    df = spark.createDataFrame(data + [("r", "q", "z", "b", 0, 0.1, "")], SCHEMA)
    big = df.withColumn("score", F.when(F.col("route") == "x", F.col("score") * 1e9).otherwise(F.col("score")))
    for d in (df, big):
        fused = ranking.fuse(d, ["run", "q"], "route", "doc", "score")
        assert [tuple(r) for r in ranking.first_of(fused, ["run", "q"], "doc").collect()] == [("r", "q", "b")]


def test_edges(spark):
    none, _ = table(spark, 5)
    none = none.limit(0)
    assert ranking.top_n(none, ["q"], "score", ["doc"], 3).count() == 0
    assert ranking.fuse(none, ["q"], "route", "doc", "score").count() == 0
    for bad in (lambda: ranking.top_n(none, ["q"], "score", ["doc"], 0), lambda: ranking.top_n(none, ["q"], "q", ["doc"], 1), lambda: ranking.fuse(none, ["q"], "route", "doc", "score", -1)):
        with pytest.raises(ValueError):
            bad()


def test_one_score_for_all(spark):
    df = spark.range(500).select(F.lit("q").alias("q"), F.col("id").cast("string").alias("doc"), F.lit(1.0).alias("score"))
    assert [r["doc"] for r in ranking.top_n(df, ["q"], "score", ["doc"], 3, 50).orderBy("rank").collect()] == ["0", "1", "10"]
    assert {r["rank"] for r in ranking.ranked_scores(df, ["q"], "score", 50).collect()} == {1}


def test_tied_score_is_dealt_to_tasks(spark, monkeypatch):
    join = ranking.heat_join
    monkeypatch.setattr(ranking, "heat_join", lambda a, b, keys, **more: join(a, b, keys, limit=0, **more))
    data = [(q, f"d{i}", float(i % 3 == 0)) for q in ("hot", None) for i in range(400)] + [("cold", "x", 2.0)]
    df = spark.createDataFrame(data, "q string, doc string, score double")
    got = {(r["q"], r["doc"]): r["rank"] for r in ranking.ranked_scores(df, ["q"], "score", 50).collect()}
    assert got == {(q, d): (1 if s > 0 else 135) for q, d, s in data}
