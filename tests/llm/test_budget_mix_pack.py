import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import mixing, packing, token_budget

TOKEN = re.compile("[a-z0-9_][a-z0-9_./:+#-]*|[一-鿿]")


def count(text):
    return len(TOKEN.findall((text or "").lower()))


@pytest.mark.parametrize(
    "label, stated",
    [("en", ["en"]), ("EN_gb", ["en"]), ("zh-CN", ["zh"]), ("German", ["de"]), ("por", ["pt"]), ("en+zh", ["en", "zh"]), ("fr, en", ["en", "fr"]), ("en/fr", ["en", "fr"]),
     (None, []), (" ", []), ("und", []), ("Unknown", []), ("xx", []), ("it", ["it"])],
)
def test_stated(spark, label, stated):
    assert spark.createDataFrame([(label,)], "l string").select(token_budget.stated_languages(F.col("l"))).collect()[0][0] == stated


def cube(snapshot):
    out = {}
    for _, source, text in snapshot:
        n, t = out.get(source, (0, 0))
        out[source] = (n + 1, t + count(text))
    return {k: v for k, v in out.items()}


def test_budget_follows_changes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "key string, source string, text string")
    budget = token_budget.TokenBudget(spark, ["source"])
    steps = [
        [("a", "s1", "one two"), ("b", "s1", None), ("c", None, "上海 x"), ("d", "s2", "one two")],
        [("a", "s1", "one two three"), ("b", "s1", ""), ("c", "s2", "上海 x"), ("e", "s3", "one two")],  # changed, moved, removed, new with a known text
        [("e", "s3", "one two")],
        [],
        [("e", "s3", "one two"), ("e", "s3", "one two")],
    ]
    for step in steps:
        got = {r["source"]: (r["documents"], r["tokens"]) for r in budget.update(frame(step)).collect()}
        assert got == cube(list(dict.fromkeys(step)))
    report = {r["level"]: (r["documents"], r["tokens"]) for r in budget.report().collect() if r["level"] != "slice"}
    assert report == {"total": (1, 2), "unlabelled": (0, 0)}
    encoded = [spark.read.parquet(f"{budget.path}/{name}").count() for name in budget.state["counts"]]
    assert encoded == [3, 1, 0, 0, 0]  # contents are counted once


def test_budget_goes_on_from_its_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_budget.TokenBudget, "MERGE", 3)
    frame = lambda rows: spark.createDataFrame(rows, "key string, source string, text string")
    rng, path, held = random.Random(8), str(tmp_path / "budget"), {}
    for step in range(9):
        budget = token_budget.TokenBudget(spark, ["source"], path=path)
        changed = {f"k{rng.randrange(12)}": (rng.choice(["s", "t", None]), rng.choice([None, "one", "one two", "上海", f"new {step}"])) for _ in range(rng.choice([0, 3, 5]))}
        removed = {f"k{rng.randrange(12)}" for _ in range(3)}
        if step % 3 == 2:
            held = {**{k: v for k, v in held.items() if k not in removed}, **changed}
            cubes = budget.update(frame([(k, *v) for k, v in held.items()]))
        else:
            held = {**{k: v for k, v in held.items() if k not in removed}, **changed}
            cubes = budget.apply(frame([(k, *v) for k, v in changed.items()]), spark.createDataFrame([(k,) for k in removed] + [(None,)], "key string"))
        assert {r["source"]: (r["documents"], r["tokens"]) for r in cubes.collect()} == cube([(k, *v) for k, v in held.items()])
        assert len(budget.state["docs"]) <= 3 and len(budget.state["counts"]) <= 3
    assert budget.state["version"] == 9
    folders = {p.name for p in (tmp_path / "budget").iterdir() if p.is_dir()}
    assert folders == {*budget.state["docs"], *budget.state["counts"], budget.state["cube"], *budget.state["old"]}
    with pytest.raises(ValueError):
        token_budget.TokenBudget(spark, ["domain"], path=path)


def test_failed_update_leaves_the_state(spark, monkeypatch):
    frame = lambda rows: spark.createDataFrame(rows, "key string, source string, text string")
    budget = token_budget.TokenBudget(spark, ["source"])
    budget.update(frame([("a", "s", "one two")]))

    def broken(*_):
        raise OSError("disk")

    with monkeypatch.context() as m:
        m.setattr(token_budget, "write_text", broken)
        with pytest.raises(OSError):
            budget.update(frame([("b", "s", "x")]))
    again = token_budget.TokenBudget(spark, ["source"], path=budget.path)
    assert [tuple(r) for r in again.cube.collect()] == [tuple(r) for r in budget.cube.collect()] == [("s", 1, 2)]
    assert [tuple(r) for r in again.update(frame([("b", "s", "x")])).collect()] == [("s", 1, 1)]


def test_budget_last_row_counts(spark):
    rows = spark.createDataFrame([("a", "s", "x y z", 1, "c"), ("a", "t", "x", 2, "c"), (None, "s", "x", 3, "c")], "key string, source string, text string, at int, tokens string")
    budget = token_budget.TokenBudget(spark, ["source"])
    assert [tuple(r) for r in budget.update(rows, order="at").collect()] == [("t", 1, 1)]


def test_budget_with_public_tokenizer(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    one = Tokenizer.from_file(path)
    one.encode_special_tokens = True
    texts = ["Hello <|endoftext|> world", "", "年 état", "x" * 5000]
    budget = token_budget.TokenBudget(spark, ["source"], token_budget.file_tokenizer(path))
    got = budget.update(spark.createDataFrame([(str(i), "s", t) for i, t in enumerate(texts)], "key string, source string, text string")).collect()[0]
    assert got["tokens"] == sum(len(one.encode(t, add_special_tokens=False)) for t in texts)


DOCS = "doc_id long, source string, text string"
TARGETS = "plan_id string, source string, target_share double, max_repeats int, size_factor double, tokens int"


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["A", " a ", "b", "B"]) if i % 3 else "c", " ".join(["w"] * rng.randrange(1, 30))) for i in range(12000)]
    docs += [(90001, None, "w w"), (90002, " ", "w"), (90003, "a", None), (90004, "tiny", "w w w")]
    targets = [("p", "a", 0.5, 4, 1.0, 1), ("p", "B ", 0.3, 1, 1.0, 1), ("p", "C", 0.1, 2, 1.0, 1), ("p", "tiny", 0.05, 3, 1.0, 1), ("p", "none", 0.05, 3, 1.0, 1), ("q", "c", 1.0, 9, 0.2, 1)]
    m = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    total = {}
    for _, s, t in docs:
        if s and s.strip():
            total[s.strip().lower()] = total.get(s.strip().lower(), 0) + count(t)
    every = sum(total.values())
    got = {(r["plan_id"], r["source"]): r for r in m.report().collect()}
    for plan, source, share, most, factor, _ in targets:
        r = got[plan, source]
        mine = total.get(source.strip().lower(), 0)
        assert r["short"] == (share * factor * every > most * mine)
        assert r["source_tokens"] == mine and r["most_copies"] <= most
        if r["short"]:
            assert r["tokens_reached"] == most * mine
        else:
            assert r["tokens_reached"] == pytest.approx(share * factor * every, rel=0.1)
    assert sum(r["actual_share"] for k, r in got.items() if k[0] == "p") == pytest.approx(1)
    order = m.sequence().collect()
    assert len(order) == sum(r["copies"] for r in got.values())
    assert len({(r["plan_id"], r["doc_id"], r["copy"]) for r in order}) == len(order)
    assert [tuple(r) for r in mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)).sequence().collect()] == [tuple(r) for r in order]


def test_short_rows_come_from_the_draw(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w w w") for i in range(40)], DOCS)
    targets = spark.createDataFrame([("p", "a", 0.9, 1, 1.0, 1), ("p", "b", 0.1, 1, 1.0, 1)], TARGETS)
    found = mixing.mix(docs, targets).report().filter("short").select("plan_id", "source")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Both the thresholds' join and the counts that the draw made are in the plan.
    assert "md5(" in plan and "_steps" in plan and plan.count("Join") >= 2
    assert [tuple(r) for r in found.collect()] == [("p", "a")]
    # A large plan and a hot source: the join is salted instead of broadcast, with the same rows.
    want = sorted(map(tuple, mixing.mix(docs, targets).copies.collect()))
    join = mixing.heat_join
    monkeypatch.setattr(mixing, "heat_join", lambda a, b, keys: join(a, b, keys, least=5, limit=0))
    assert sorted(map(tuple, mixing.mix(docs, targets).copies.collect())) == want


def test_mix_empty(spark):
    targets = spark.createDataFrame([("p", "a", 0.5, 2, 1.0, 1), ("p", "a", None, None, None, 1)], TARGETS)
    m = mixing.mix(spark.createDataFrame([], DOCS), targets)
    assert [(r["short"], r["copies"], r["actual_share"]) for r in m.report().collect()] == [(False, 0, 0.0)]
    assert mixing.mix(spark.createDataFrame([(1, "a", "x")], DOCS), targets.limit(0)).report().count() == 0


@pytest.mark.parametrize("rate, most", [(0.3, 1), (0.9, 2), (1.7, 2), (3.0, 9), (0.01, 5)])
def test_poisson_mean(rate, most):
    assert mixing.capped_mean(mixing.poisson_mean(rate, most), most) == pytest.approx(rate, rel=1e-6)


def test_poisson_bounds():
    assert mixing.poisson_mean(0, 3) == 0 and mixing.poisson_mean(1, 0) == 0 and mixing.poisson_mean(3, 3) == np.inf


def test_packing(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 20, 40, 64, 65, 200]))) for _ in range(400)] + [None, "", "上" * 129]
    data = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x"), (None, "gone", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, tokens string")
    packed = packing.pack(df, capacity=64, shard_texts=150)
    got = packed.collect()
    held = {}
    for r in got:
        held[r["shard"], r["container"]] = held.get((r["shard"], r["container"]), 0) + r["tokens"]
    assert max(held.values()) <= 64
    assert sum(held.values()) / (64 * len(held)) > 0.9
    size = {}
    for r in got:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["tokens"]
    want = {}
    for i, t, _ in data[:-1]:
        want[i] = want.get(i, 0) + count(t)
    assert size == want
    assert all((r["pieces"] > 1) == (count(texts[r["doc_id"]]) > 64) for r in got)
    assert {r[0] for r in packing.split_texts(packed).collect()} == {i for i, t in enumerate(texts) if count(t) > 64}
    assert packing.container_report(packed, 64).agg(F.sum("containers")).collect()[0][0] == len(held)
    assert packing.pack(df.limit(0), capacity=64).count() == 0
    # Long texts make more shards, and each shard is a task of its own.
    many = packing.pack(df, capacity=64, shard_chars=9000)
    assert many.select("shard").distinct().count() > 5 and many.withColumn("t", F.spark_partition_id()).groupBy("t").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=0)


def test_neighbours_share_a_container(spark):
    fill = lambda *w: " ".join(w * 10)
    docs = [(i, fill(f"{topic}{j}" if j else topic, topic)) for i, (topic, j) in enumerate((t, j) for j in range(2) for t in ("ship", "tree", "coin"))]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=40).collect()
    at = {r["doc_id"]: r["container"] for r in got}
    assert at[0] == at[3] and at[1] == at[4] and at[2] == at[5]


def test_every_term_of_a_seed_counts():
    rng = np.random.default_rng(3)
    weight = 1 / np.arange(1, 901)
    texts = [[f"w{i}" for i in rng.choice(900, int(rng.integers(60, 300)), p=weight / weight.sum())] + [f"own{j}_{i}" for i in range(40)] for j in range(120)]
    index = packing.Bm25Index(texts)
    held = [set(t) for t in texts]
    mean = np.mean([len(t) for t in texts])
    df = Counter(w for h in held for w in h)
    idf = {w: np.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    counts = [Counter(t) for t in texts]
    for seed in range(0, 120, 7):
        got, want = index.scores(seed), np.zeros(len(texts))
        for i, c in enumerate(counts):
            norm = packing.K1 * (1 - packing.B + packing.B * len(texts[i]) / mean)
            want[i] = sum(idf[w] * c[w] * (packing.K1 + 1) / (c[w] + norm) for w in held[seed] & held[i])
        others = np.arange(len(texts)) != seed
        np.testing.assert_allclose(got[others], want[others], rtol=1e-4)
