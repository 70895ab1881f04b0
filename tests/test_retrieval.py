import datetime
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import acl, fusion, metrics, search
from rankloom.plans import retrieval

HITS = "qid string, route string, route_ord int, weight double, rank long, doc_id string, chunk_key string, score double"
CHUNKS = "chunk_key string, doc_id string, title string, text string, tenant string, source string, allowed array<string>, denied array<string>, vector array<double>"


def hits(spark, *routes, weights=None):
    data = [("q", f"r{o}", o, (weights or [1.0] * len(routes))[o], i + 1, d, f"{d}:{o}", 10.0 - i) for o, docs in enumerate(routes) for i, d in enumerate(docs)]
    return spark.createDataFrame(data, HITS)


def order(df):
    return [r["doc_id"] for r in df.orderBy("rank").collect()]


def test_rrf_shared_document_leads(spark):
    got = fusion.rrf(hits(spark, ["dense-only", "shared", "tail"], ["bm25-only", "shared", "other"]), 60, 4)
    assert order(got) == ["shared", "dense-only", "bm25-only", "tail"]


def test_rrf_repeated_documents_add_up(spark):
    assert order(fusion.rrf(hits(spark, ["a", "a", "b"], ["c"]), 10, 3)) == ["a", "c", "b"]


def test_rrf_weights(spark):
    assert order(fusion.rrf(hits(spark, ["dense", "shared"], ["bm25", "shared"], weights=[0.5, 1.0]), 60, 3)) == ["shared", "bm25", "dense"]


def test_rrf_blank_ids_keep_their_place(spark):
    got = {r["doc_id"]: r["score"] for r in fusion.rrf(hits(spark, [" ", "b"], [None, "c"]), 0, 9).collect()}
    assert got == {"b": 0.5, "c": 0.5}


def test_rrf_rejects(spark):
    h = hits(spark, ["a"])
    for k, n in ((-1, 5), (5, 0)):
        with pytest.raises(ValueError):
            fusion.rrf(h, k, n)
    with pytest.raises(Exception, match="positive"):
        fusion.rrf(h.withColumn("weight", F.lit(0.0)), 5, 5).collect()


def test_single_route_keeps_its_scores(spark):
    got = fusion.rrf(hits(spark, ["a", "b"]), 60, 5, bypass=True).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [("a", 10.0), ("b", 9.0)]


@pytest.mark.parametrize(
    "scope, tenant, source, allowed, denied, sees",
    [
        ([], "x", "jira", [], [], True), (None, "x", "jira", None, None, True), (["jira"], "t", "jira", ["source:jira"], [], True), (["jira"], "t", "jira", ["source:jira"], None, True),
        (["jira"], "u", "jira", ["source:jira"], [], False), (["slack"], "t", "jira", ["source:jira"], [], False), (["jira"], "t", "jira", ["role:x"], [], False),
        (["jira"], "t", "jira", None, [], False), (["jira"], "t", "jira", ["source:jira"], ["source:jira"], False), (["jira"], None, "jira", ["source:jira"], [], False),
    ],
)
def test_visible(spark, scope, tenant, source, allowed, denied, sees):
    df = spark.createDataFrame([(scope, tenant, source, allowed, denied)], "s array<string>, t string, o string, a array<string>, d array<string>")
    got = df.select(acl.visible(F.col("s"), F.col("t"), F.col("o"), F.col("a"), F.col("d"), "t")).collect()[0][0]
    assert got is sees


def small_index(spark):
    data = [
        ("d1:1", "d1", "red apple", "apple apple pie", "t", "jira", ["source:jira"], [], [1.0, 0.0]),
        ("d1:2", "d1", "red apple", "nothing here", "t", "jira", ["source:jira"], [], [0.9, 0.1]),
        ("d2:1", "d2", "green", "one apple", "t", "slack", ["source:slack"], [], [0.0, 2.0]),
        ("d3:1", "d3", "", "", "t", "jira", None, None, None),
        ("d4:1", "d4", "pie", "pie pie", "u", "jira", ["source:jira"], [], [0.0, 0.0]),
    ]
    return spark.createDataFrame(data, CHUNKS)


def test_bm25_by_hand(spark):
    chunks = retrieval.with_terms(small_index(spark))
    asked = spark.createDataFrame([("q1", ["apple"], []), ("q2", ["apple"], ["slack"]), ("q3", ["absent"], []), ("q4", [], [])], "qid string, terms array<string>, scope array<string>")
    got = {(r["qid"], r["doc_id"]): (r["chunk_key"], r["score"]) for r in search.bm25(asked, chunks, {"title": 2.0, "text": 1.0}, tenant="t", shard_items=2).collect()}
    assert set(got) == {("q1", "d1"), ("q1", "d2"), ("q2", "d2")}
    n, df, mean = 4, 2, (3 + 2 + 2 + 2) / 4
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    assert got["q1", "d2"][1] == pytest.approx(idf * 3.2 / (1 + 2.2 * 2 / mean), abs=1e-6)
    title = math.log(1 + (4 - 2 + 0.5) / 2.5) * 3.2 / (1 + 2.2 * 2 / (6 / 4)) * 2
    text = idf * 3.2 * 2 / (2 + 2.2 * 3 / mean)
    assert got["q1", "d1"] == ("d1:1", pytest.approx(max(title, text), abs=1e-6))


def test_dense(spark):
    chunks = small_index(spark)
    asked = spark.createDataFrame([("q", [1.0, 0.0], []), ("z", [0.0, 0.0], []), ("s", [1.0, 0.0], ["slack"]), ("l", [1.0], [])], "qid string, vector array<double>, scope array<string>")
    got = [(r["qid"], r["rank"], r["doc_id"], r["chunk_key"], r["score"]) for r in search.dense(asked, chunks, tenant="t", shard_items=2).orderBy("qid", "rank").collect()]
    assert got == [("q", 1, "d1", "d1:1", 1.0), ("q", 2, "d2", "d2:1", 0.0), ("s", 1, "d2", "d2:1", 0.0)]
    one = search.dense(asked.filter("qid = 'q'"), chunks, k=1, k_chunks=1, tenant="t").collect()
    assert [r["chunk_key"] for r in one] == ["d1:1"]


def test_empty_inputs(spark):
    chunks = small_index(spark)
    none = chunks.limit(0)
    asked = spark.createDataFrame([("q", "apple", [], [1.0, 0.0])], "qid string, question string, scope array<string>, vector array<double>")
    assert retrieval.retrieve(asked, none, retrieval.RetrievalConfig(tenant="t")).count() == 0
    assert retrieval.retrieve(asked.limit(0), chunks, retrieval.RetrievalConfig(tenant="t")).count() == 0


def test_modes(spark):
    chunks = small_index(spark)
    asked = spark.createDataFrame([("q", "what about apple", [], [1.0, 0.0])], "qid string, question string, scope array<string>, vector array<double>")
    routes = lambda **c: {r["route"] for r in retrieval.routes(asked, chunks, retrieval.RetrievalConfig(tenant="t", **c)).select("route").distinct().collect()}
    assert routes(mode="dense") == {"dense"}
    assert routes(mode="bm25") == {"bm25"}
    assert routes(**retrieval.FOUR_ROUTES) == {"dense", "bm25", "keyword", "english"}
    for bad in ({"mode": "x"}, {"top_k": 0}, {"rrf_k": -1}, {"bm25_weight": 0.0}):
        with pytest.raises(ValueError):
            retrieval.RetrievalConfig(**bad)


def test_metrics_by_hand(spark):
    questions = spark.createDataFrame(
        [("a", "basic", ["jira"], ["d1", "d2"], 10.0), ("b", None, ["jira", "jira"], ["d9"], 20.0), ("c", "basic", [], [], 30.0), ("e", "x", ["slack"], ["d10"], 40.0), ("f", "x", [], ["d11"], 50.0)],
        "qid string, question_type string, scope array<string>, expected array<string>, latency_ms double",
    )
    data = [("a", 1, "d2", "jira", 5), ("a", 3, "d1", "jira", 7), ("b", 1, "d1", "slack", 1)]
    data += [("e", i, f"d{i}", "slack", 1) for i in range(1, 12)] + [("f", i, f"d{i}", None, 1) for i in range(1, 12)]
    ranked = spark.createDataFrame(data, "qid string, rank long, doc_id string, source_type string, tokens long")
    got = {(r["slice_kind"], r["slice"]): r.asDict() for r in metrics.evaluate(questions, ranked).collect()}
    o = got["overall", "all"]
    assert (o["questions_total"], o["questions_evaluable"], o["no_gold_doc_count"], o["source_filter_violation_count"]) == (5, 4, 1, 1)
    assert (o["hit_at_1"], o["hit_at_5"], o["hit_at_10"], o["hit_at_20"]) == (0.25, 0.25, 0.5, 0.75)
    assert o["mrr_at_10"] == pytest.approx((1 + 0.1) / 4)
    assert o["all_expected_docs_hit_at_10"] == 0.5
    assert (o["avg_latency_ms"], o["p95_latency_ms"], o["avg_context_tokens"]) == (30.0, 50.0, (12 + 1 + 10 + 10) / 5)
    assert got["by_source_type", "jira"]["questions_total"] == 3
    assert got["by_source_type", "unknown"]["questions_total"] == 2
    assert got["by_question_type", "unknown"]["hit_at_1"] == 0.0
    none = metrics.evaluate(questions.filter("qid = 'c'"), ranked).filter("slice_kind = 'overall'").collect()[0]
    assert none["hit_at_1"] is None and none["mrr_at_10"] is None and none["questions_total"] == 1


def test_nearest_rank(spark):
    rng = random.Random(6)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(40)), rng.random()])) for _ in range(3000)] + [("hot", float(i % 7)) for i in range(4000)] + [("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    for share in (0.95, 0.5, 1.0, 0.001):
        want = {}
        for g in {g for g, v in data if v is not None}:
            values = sorted(v for x, v in data if x == g and v is not None)
            want[g] = values[math.ceil(len(values) * share - 1e-9) - 1]
        found = metrics.nearest_rank(df, ["g"], "v", share)
        assert {r["g"]: r["v"] for r in found.collect()} == want
    assert metrics.nearest_rank(spark.range(1, 501).select(F.lit("x").alias("g"), "id"), ["g"], "id").collect()[0]["id"] == 475.0
    assert metrics.nearest_rank(df.limit(0), ["g"], "v").count() == 0
    assert "percentile" not in found._jdf.queryExecution().toString()


def test_metrics_without_questions(spark):
    questions = spark.createDataFrame([], "qid string, question_type string, scope array<string>, expected array<string>, latency_ms double")
    ranked = spark.createDataFrame([], "qid string, rank long, doc_id string, source_type string, tokens long")
    got = metrics.evaluate(questions, ranked).collect()
    assert [(r["slice_kind"], r["questions_total"], r["hit_at_1"], r["p95_latency_ms"]) for r in got] == [("overall", 0, None, 0.0)]


def nearest_by_hand(question, scope, items, k, k_chunks):
    """items: chunk_key, doc_id, tenant, source, allowed, denied, vector."""
    labels, found = {f"source:{s}" for s in scope}, []
    for key, doc, tenant, source, allowed, denied, v in items:
        if v is None or len(v) != len(question) or not any(v) or (scope and not (tenant == "t" and source in scope and labels & set(allowed or ()) and not labels & set(denied or ()))):
            continue
        found.append((-round(float(np.dot(v, question) / np.linalg.norm(v) / np.linalg.norm(question)), 6), doc, key))
    out = {}
    for s, doc, key in sorted(found)[:k_chunks]:
        out.setdefault(doc, (doc, key, -s))
    return list(out.values())[:k]


@pytest.mark.parametrize("scoped", [False, True])
def test_dense_against_every_pair(spark, scoped, monkeypatch):
    rng = random.Random(4)
    # Few values, so that scores tie; a document of 60 equal chunks fills the candidates.
    vector = lambda: rng.choice([None, [0.0] * 4, [1.0, 2.0], *[[float(rng.randrange(-2, 3)) for _ in range(4)] for _ in range(9)]])
    items = [(f"d{i % 90:02d}:{i:04d}", f"d{i % 90:02d}", rng.choice(["t", "u"]), s := rng.choice(["jira", "slack"]), [f"source:{s}"], rng.choice([None, [], ["source:slack"]]), vector()) for i in range(600)]
    items += [(f"hot:{i:03d}", "hot", "t", "jira", ["source:jira"], [], [1.0, 1.0, 1.0, 1.0]) for i in range(60)]
    asked = [(f"q{i}", [float(rng.randrange(-2, 3)) for _ in range(4)] if i else [1.0] * 4, rng.choice([[], ["jira"], ["slack", "jira"]])) for i in range(40)]
    monkeypatch.setattr(search, "_grid", lambda *a: (3, 2))
    chunks = spark.createDataFrame(items, "chunk_key string, doc_id string, tenant string, source string, allowed array<string>, denied array<string>, vector array<double>").repartition(3)
    questions = spark.createDataFrame(asked, "qid string, vector array<double>, scope array<string>")
    for k, k_chunks in ((5, 40), (7, 100), (50, 20)):
        got = search.dense(questions, chunks, k, k_chunks, tenant="t", scoped=scoped, shard_items=64).orderBy("qid", "rank").collect()
        for qid, v, scope in asked:
            want = nearest_by_hand(v, scope if scoped else [], items, k, k_chunks) if any(v) else []
            assert [(r["doc_id"], r["chunk_key"], r["score"]) for r in got if r["qid"] == qid] == want, (qid, k, k_chunks)


def test_dense_tasks_give_few_rows(spark, monkeypatch):
    """a task once gave k_chunks rows a question, 500 for 10 documents."""
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(9000, 8)), rng.normal(size=(20, 8))
    x, q = x / np.linalg.norm(x, axis=1)[:, None], q / np.linalg.norm(q, axis=1)[:, None]
    near, doc = search._Nearest(np.arange(20), q, 10, 500), np.arange(9000) // 3
    for at in range(0, 9000, 2000):
        part = slice(at, at + 2000)
        near.see(x[part], x[part].astype(np.float32), np.arange(9000)[part], doc[part])
    near.merge()
    assert len(near.who) < 20 * 20
    for j in range(20):
        best = {}
        for i in np.lexsort((np.arange(9000), -np.round(x @ q[j], 6))):
            best.setdefault(doc[i], i)
            if len(best) == 10:
                break
        kept = {}
        for d, p in zip(near.doc[near.who == j], near.place[near.who == j], strict=True):
            kept.setdefault(d, p)
        assert kept == best


def test_chunks_of_moves_few_rows(spark, tmp_path):
    """each reading of the chunk table once sorted and moved all of it; keys that come once now stay where they are."""
    columns = "chunk_key string, benchmarkDocId string, title string, textContent string, sourceType string, tenantId string, allowedGroupIds array<string>, deniedGroupIds array<string>, indexedAt timestamp, vector array<float>"
    at = lambda d: None if d is None else datetime.datetime(2025, 1, d)
    data = [(k, f"d{k}", t, None, None, None, None, None, at(d), [1.0]) for k, t, d in (("a", "old", 1), ("a", "new", 2), ("b", "once", None), ("c", "late", 3), ("c", "unknown", None), (None, "x", 1))]
    spark.createDataFrame(data, columns).write.parquet(f"{tmp_path}/chunks.parquet")
    from rankloom import queries

    assert {(r["chunk_key"], r["title"], r["source"]) for r in queries.chunks_of(spark, str(tmp_path)).collect()} == {("a", "new", "unknown"), ("b", "once", "unknown"), ("c", "late", "unknown")}
    some = queries.chunks_of(spark, str(tmp_path), ("vector",), spark.createDataFrame([("a",)], "chunk_key string"))
    assert [tuple(r) for r in some.collect()] == [("a", [1.0])]


def test_bm25_against_every_pair(spark, monkeypatch):
    rng = random.Random(9)
    words = ["the"] * 12 + ["of"] * 6 + [f"w{i}" for i in range(25)]
    some = lambda n: [rng.choice(words) for _ in range(rng.randrange(n))]
    items = [(f"d{i % 150:03d}:{i:04d}", f"d{i % 150:03d}", rng.choice(["t", "u"]), s := rng.choice(["jira", "slack"]), [f"source:{s}"], rng.choice([None, ["source:slack"]]), some(4), some(14)) for i in range(700)]
    asked = [(f"q{i}", some(7), rng.choice([[], ["jira"], ["slack", "jira"]])) for i in range(30)]
    monkeypatch.setattr(search, "_grid", lambda *a: (2, 2))
    chunks = spark.createDataFrame(items, "chunk_key string, doc_id string, tenant string, source string, allowed array<string>, denied array<string>, title_terms array<string>, text_terms array<string>").repartition(3)
    got = search.bm25(spark.createDataFrame(asked, "qid string, terms array<string>, scope array<string>"), chunks, {"title": 2.0, "text": 1.0}, k=6, tenant="t", shard_items=100).orderBy("qid", "rank").collect()
    lists = {f: [x[c] for x in items] for f, c in (("title", 6), ("text", 7))}
    n = {f: sum(bool(x) for x in v) for f, v in lists.items()}
    mean = {f: sum(map(len, v)) / n[f] for f, v in lists.items()}
    for qid, terms, scope in asked:
        labels, found = {f"source:{s}" for s in scope}, []
        gain = {f: {t: math.log1p((n[f] - (d := sum(t in x for x in v)) + 0.5) / (d + 0.5)) for t in terms} for f, v in lists.items()}
        for i, (key, doc, tenant, source, allowed, denied, *_) in enumerate(items):
            if scope and not (tenant == "t" and source in scope and labels & set(allowed) and not labels & set(denied or ())):
                continue
            part = lambda f: sum(gain[f][t] * 3.2 * c / (c + 2.2 * len(lists[f][i]) / mean[f]) for t in terms if (c := lists[f][i].count(t)))  # noqa: B023, E731
            if (score := round(max(2 * part("title"), part("text")), 6)) > 0:
                found.append((-score, doc, key))
        want = {}
        for s, doc, key in sorted(found):
            want.setdefault(doc, (doc, key, -s))
        assert [(r["doc_id"], r["chunk_key"], r["score"]) for r in got if r["qid"] == qid] == list(want.values())[:6], qid


def test_bm25_looks_common_words_up(monkeypatch):
    """the list of a common word once was walked for every question; it is looked up for the few items that can still come in."""
    asked = pa.RecordBatch.from_pydict({"qid": ["q"], "scope": pa.array([[]], pa.list_(pa.string())), "q_field": pa.array([[0, 0]], pa.list_(pa.int32())), "q_term": [["rare", "the"]], "q_gain": [[9.0, 0.1]]})
    best, names, sizes = search._Matches([asked], [1.0], 3, "t"), search._Names(), []
    real = search._looked_up
    monkeypatch.setattr(search, "_looked_up", lambda *a: sizes.append(len(a[-1])) or real(*a))
    for block in range(3):
        keys = pa.array([f"d{block}{i:05d}" for i in range(5000)])
        rows = pa.RecordBatch.from_pydict({"doc_id": keys, "chunk_key": keys, "access": ["{}"] * 5000})
        text = pa.array([search._BETWEEN.join(["the"] * (1 + i % 3) + ["rare"] * (i % 1000 == 7)) for i in range(5000)])
        best.see([search._Tokens(rows, names.see(keys, keys), [text], best.terms)], [2.0], 2.2, 1.0)
    found = pa.Table.from_batches(list(best.found(names))).to_pydict()
    assert found["chunk_key"] == ["d002007", "d102007", "d202007"]  # of equal scores the first documents; the other rare ones are longer
    assert sizes and max(sizes) <= 5
