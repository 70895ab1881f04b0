import json

import pytest
from pyspark.sql import functions as F

from rankloom import cli, embedding, queries
from rankloom.operators.chunking import last_acl
from rankloom.sources import readers, sinks
from rankloom.streaming import ingest

DOCS = [
    {"doc_id": "g1", "title": "Build", "text": "The build server restarts at night.", "source_type": "github", "extra": 1},
    {"doc_id": "c1", "title": "Greenhouse", "text": "Seedlings in bay four are watered twice a day.", "source_type": "confluence"},
    {"doc_id": "s1", "text": "Lunch is at noon."},
]
ACL = [
    {"doc_id": "g1", "tenant_id": "tenant_redwood", "allowed_group_ids": "source:github"},
    {"doc_id": "c1", "tenant_id": "other"},
    {"doc_id": "c1", "tenant_id": "tenant_redwood", "allowed_group_ids": ["source:confluence"], "denied_group_ids": []},
]
QUESTIONS = [
    {"id": "q1", "question": "When does the build server restart?", "question_type": "basic", "source_types": ["github"], "expected_doc_ids": ["g1"]},
    {"id": "q2", "question": "How often are seedlings watered?", "source_types": "confluence", "expected_doc_ids": "c1"},
    {"id": "q3", "question": "Anything else?"},
]


def lines(path, items):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(["", *map(json.dumps, items), "  ", ""]))
    return str(path)


def test_readers(spark, tmp_path):
    docs = readers.read_docs(spark, lines(tmp_path / "d.jsonl", DOCS))
    assert sorted(r["doc_id"] for r in docs.collect()) == ["c1", "g1", "s1"]
    assert readers.read_docs(spark, str(tmp_path / "d.jsonl"), limit=3, done=2).count() == 1
    with pytest.raises(ValueError):
        readers.read_docs(spark, str(tmp_path / "d.jsonl"), limit=-1)
    acl = readers.read_acl(spark, lines(tmp_path / "a.jsonl", ACL)).orderBy("line_no").collect()
    assert acl[0]["allowed_group_ids"] == ["source:github"] and acl[1]["allowed_group_ids"] == []
    lines(tmp_path / "bad.jsonl", [{"title": "x"}])
    with pytest.raises(Exception, match="doc_id"):
        readers.read_docs(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "broken.jsonl").write_text('{"doc_id": ')
    with pytest.raises(Exception):
        readers.read_docs(spark, str(tmp_path / "broken.jsonl")).collect()


@pytest.mark.parametrize("wrap", [lambda q: q, lambda q: {"questions": q}])
def test_questions(spark, tmp_path, wrap):
    (tmp_path / "q.json").write_text(json.dumps(wrap(QUESTIONS)))
    got = {r["id"]: r for r in readers.read_questions(spark, str(tmp_path / "q.json")).collect()}
    assert got["q1"]["source_types"] == ["github"] and got["q2"]["source_types"] == ["confluence"] and got["q2"]["expected_doc_ids"] == ["c1"]
    assert got["q3"]["expected_doc_ids"] == [] and got["q3"]["question_type"] == "unknown"


def test_text_list(spark):
    values = [('"a"', ["a"]), ('["a", 1, null]', ["a", "1", None]), ("a", ["a"]), ("null", []), (None, []), ("{}", []), ("3", [])]
    df = spark.createDataFrame([(v,) for v, _ in values], "v string")
    assert [r[0] for r in df.select(readers.text_list(F.col("v"))).collect()] == [w for _, w in values]


def test_last_access_row_by_file_and_line(spark, tmp_path):
    row = lambda i, tenant: {"doc_id": f"d{i % 50}", "tenant_id": tenant}
    lines(tmp_path / "acl" / "a.jsonl", [row(i, f"old{i}") for i in range(60)])
    lines(tmp_path / "acl" / "b.jsonl", [row(i, f"new{i}") for i in range(40_000)])  # larger, so that it is packed first
    lines(tmp_path / "acl" / "c.jsonl", [{"doc_id": " D7", "tenant_id": "last"}])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # b comes in several splits
    try:
        found = readers.read_acl(spark, str(tmp_path / "acl"))
        assert found.rdd.getNumPartitions() > 3
        got = {r["doc"]: r["tenant_id"] for r in last_acl(found).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"d{i}": f"new{39_950 + i}" for i in range(50)} | {"d7": "last"}


def test_question_numbers_are_dense(spark):
    raw = spark.createDataFrame([(None, f"q {i}", "d1") for i in range(40)] + [("own", "x", None), (None, " ", None)], "id string, question string, expected_doc_ids string").repartition(3)
    got = readers.normal_questions(raw).collect()
    numbers = {int(r["id"][2:]) for r in got if r["id"] != "own"}
    assert len(numbers) == 40 and numbers < set(range(1, 42))  # the row with its own id has a place too
    assert {tuple(r["expected_doc_ids"]) for r in got} == {("d1",), ()}


def config(tmp_path, **more):
    return ingest.IngestConfig(docs=str(tmp_path / "in"), acl=str(tmp_path / "acl.jsonl"), index=str(tmp_path / "index"), model="hashed", dimension=16, **more)


def test_ingest_resumes_and_replays(spark, tmp_path):
    provider = embedding.HashedWords(16)
    lines(tmp_path / "acl.jsonl", ACL)
    lines(tmp_path / "in" / "1.jsonl", DOCS[:2])
    c = config(tmp_path)
    assert sinks.create_index(c.index, "hashed", 16)
    with pytest.raises(FileExistsError):
        sinks.create_index(c.index, "hashed", 16)
    assert not sinks.create_index(c.index, "hashed", 16, skip_existing=True)
    assert ingest.ingest(spark, c, provider)["documents"] == 2
    assert ingest.ingest(spark, c, provider)["documents"] == 0
    lines(tmp_path / "in" / "2.jsonl", [DOCS[2], DOCS[0] | {"text": "It restarts at dawn."}])
    assert ingest.ingest(spark, c, provider)["documents"] == 2
    got = {r["chunk_key"]: r for r in ingest.read_index(spark, c.index).collect()}
    assert sorted(got) == ["c1:00001", "g1:00001", "s1:00001"]
    assert got["g1:00001"]["text_content"] == "It restarts at dawn." and len(got["g1:00001"]["vector"]) == 16
    # A replayed batch takes its own place.
    again = spark.read.parquet(f"{c.index}/chunks/batch={0:012d}").limit(1)
    ingest.upsert(spark.createDataFrame(again.collect(), again.schema), c.index, 0)
    assert ingest.read_index(spark, c.index).count() == 3
    with pytest.raises(ValueError, match="settings"):
        ingest.check_signature(config(tmp_path, chunk_size=600, chunk_overlap=100))
    with pytest.raises(ValueError, match="dimension"):
        ingest.check_signature(ingest.IngestConfig(**{**c.__dict__, "dimension": 8}))


def test_limit_events_and_changed_files(spark, tmp_path):
    lines(tmp_path / "acl.jsonl", ACL)
    for n in range(3):
        lines(tmp_path / "in" / f"{n}.jsonl", [{"doc_id": f"d{n}{i}", "text": f"text {n} {i}"} for i in range(3)])
    sinks.create_index(config(tmp_path).index, "hashed", 16)
    seen = []
    run = lambda **more: ingest.ingest(spark, config(tmp_path, files_per_batch=1, **more), embedding.HashedWords(16), report=seen.append)
    first = run(max_documents=4)
    assert (first["documents"], first["documents_total"], first["limit_reached"], first["batches"]) == (4, 4, True, 2)
    assert run(max_documents=4)["documents"] == 0
    more = run(max_documents=7)
    assert (more["documents"], more["documents_total"]) == (3, 7)
    assert ingest.read_index(spark, config(tmp_path).index).count() == 7
    rest = run()
    assert (rest["documents_total"], rest["chunks_total"], rest["batches_total"], rest["limit_reached"]) == (9, 9, 3, False)
    assert ingest.read_index(spark, config(tmp_path).index).count() == 9
    assert seen[0]["event"] == "batch_complete" and seen[-1]["documents"] == 9 and seen[-1]["documents_per_second_this_run"] > 0
    lines(tmp_path / "in" / "1.jsonl", [{"doc_id": "other", "text": "and longer than before, by far, in every way"}])
    with pytest.raises(ValueError, match="changed"):
        run()
    with pytest.raises(ValueError):
        config(tmp_path, max_documents=-1)


def test_dead_letters(spark, tmp_path):
    class Picky(embedding.HashedWords):
        """Cannot embed some texts. Defined here so that tasks get it by value."""

        def embed(self, texts, role):
            if any("poison" in t for t in texts):
                raise RuntimeError("no")
            return embedding.HashedWords.embed(self, texts, role)

    lines(tmp_path / "acl.jsonl", ACL)
    lines(tmp_path / "in" / "1.jsonl", [*DOCS, {"doc_id": "p", "text": "poison"}, {"title": "no id"}])
    with open(tmp_path / "in" / "1.jsonl", "a") as f:
        f.write('{"doc_id": "cut off\n')
    c = config(tmp_path, dead_letters=True)
    sinks.create_index(c.index, "hashed", 16)
    out = ingest.ingest(spark, c, Picky(16))
    assert (out["chunks"], out["failed"]) == (3, 3)
    dead = spark.read.parquet(f"{c.index}/dead_letters").collect()
    assert sorted(r["kind"] for r in dead) == ["chunk", "document", "document"] and {"poison"} < {r["content"] for r in dead}
    strict = config(tmp_path / "strict", retries=1)
    lines(tmp_path / "strict" / "in" / "1.jsonl", [{"doc_id": "p", "text": "poison"}])
    lines(tmp_path / "strict" / "acl.jsonl", ACL)
    sinks.create_index(strict.index, "hashed", 16)
    with pytest.raises(Exception, match="no"):
        ingest.ingest(spark, strict, Picky(16), str(tmp_path / "failures"))
    failures = [json.loads(p.read_text()) for p in (tmp_path / "failures").glob("failure-*.json")]
    assert sorted(f["attempt"] for f in failures) == [0, 1]


def test_stale_tail_stays(spark, tmp_path):
    lines(tmp_path / "acl.jsonl", [])
    c = config(tmp_path, chunk_size=20, chunk_overlap=5)
    sinks.create_index(c.index, "hashed", 16)
    lines(tmp_path / "in" / "1.jsonl", [{"doc_id": "a", "text": "one two three four five six seven"}])
    ingest.ingest(spark, c)
    before = ingest.read_index(spark, c.index).count()
    lines(tmp_path / "in" / "2.jsonl", [{"doc_id": "a", "text": "short"}])
    ingest.ingest(spark, c)
    got = {r["chunk_id"]: r["text_content"] for r in ingest.read_index(spark, c.index).collect()}
    assert len(got) == before > 1 and got[1] == "short"


def test_commands(spark, tmp_path):
    lines(tmp_path / "acl.jsonl", ACL)
    lines(tmp_path / "in" / "1.jsonl", DOCS)
    (tmp_path / "q.json").write_text(json.dumps(QUESTIONS))
    index = str(tmp_path / "index")
    cli.main(["create-index", "--index", index, "--embedding-model", "hashed", "--embedding-dimension", "64"], spark)
    cli.main(["import", "--index", index, "--docs", str(tmp_path / "in"), "--acl-docs", str(tmp_path / "acl.jsonl"), "--embedding-model", "hashed", "--embedding-dimension", "64", "--output", str(tmp_path / "import.json")], spark)
    assert json.loads((tmp_path / "import.json").read_text())["documents"] == 3
    args = ["evaluate", "--index", index, "--questions", str(tmp_path / "q.json"), "--output", str(tmp_path / "summary.json"), "--details-output", str(tmp_path / "details")]
    summary = cli.main([*args, "--embedding-model", "hashed", "--embedding-dimension", "64", "--keyword-bm25-enabled", "true", "--english-bm25-enabled", "true"], spark)
    assert (summary["questions_total"], summary["questions_evaluable"], summary["hit_at_1"], summary["mrr_at_10"]) == (3, 2, 1.0, 1.0)
    assert (summary["no_gold_doc_count"], summary["source_filter_violation_count"]) == (1, 0)
    assert json.loads((tmp_path / "summary.json").read_text())["by_source_type"]["unknown"]["questions_total"] == 1
    details = spark.read.json(str(tmp_path / "details"))
    assert details.count() == 3
    latencies = [f"{n}_latency_ms" for n in ("embedding", "dense", "bm25", "keyword", "english", "fusion")]
    one = details.select("latency_ms", *latencies).first()
    assert one["latency_ms"] == pytest.approx(sum(one[n] for n in latencies)) and min(one[n] for n in latencies) > 0
    with pytest.raises(SystemExit):
        cli.main(["evaluate", "--index", index], spark)
    with pytest.raises(SystemExit):
        cli.main(["create-index", "--index", "a", "--index", "b", "--embedding-model", "m"], spark)


def test_embedding_requests():
    ask = "where"
    local = embedding.HttpEmbeddings("http://x", "m", 4, instruction="Find it")
    assert local.body([ask], "query") == {"model": "m", "input": ["Instruct: Find it\nQuery:where"], "encoding_format": "float", "input_type": "query", "dimension": 4}
    assert local.body([ask], "document")["input"] == [ask] and local.body([ask], "document")["input_type"] == "passage"
    assert "input_type" not in embedding.HttpEmbeddings("http://x", "m", 4, "openai", "k").body([ask], "query")
    assert embedding.HttpEmbeddings("http://x", "m", 4, "openai", "k").body([ask], "query")["dimensions"] == 4
    other = embedding.HttpEmbeddings("http://x", "m", 2, "dashscope", "k", "Find it")
    assert other.body([ask], "query") == {"model": "m", "input": {"texts": [ask]}, "parameters": {"dimension": 2, "output_type": "dense", "text_type": "query", "instruct": "Find it"}}
    assert other.parse({"output": {"embeddings": [{"text_index": 1, "embedding": [3, 4]}, {"text_index": 0, "embedding": [1, 2]}]}}, 2) == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        local.parse({"data": [{"embedding": [1.0]}]}, 1)
    for bad in (("http://x", "m", 4, "odd"), ("", "m", 4), ("http://x", "m", 0), ("http://x", "m", 4, "openai")):
        with pytest.raises(ValueError):
            embedding.HttpEmbeddings(*bad)


def test_export(spark):
    docs = spark.createDataFrame([("a", "t", "x", "jira"), ("a", "t", "w", "jira"), ("b", None, "y", None), ("c", "t", " ", "jira"), ("d", "t", "z", "jira"), (None, "t", "z", "j")], "doc_id string, title string, text string, source_type string")
    wanted = spark.createDataFrame([("b",), ("gone",)], "doc_id string")
    got = {r["doc_id"]: r for r in readers.export_corpus(docs, wanted, 1).collect()}
    assert sorted(got) == ["a", "b"] and got["a"]["text"] == "w" and got["b"]["source_path"] == "corpus:unknown:b"
    assert [r[0] for r in readers.missing_expected(docs, wanted).collect()] == ["gone"]


def test_export_command(spark, tmp_path):
    lines(tmp_path / "docs" / "1.jsonl", DOCS)
    (tmp_path / "q.json").write_text(json.dumps([{"question": "a?", "expected_doc_ids": ["g1"]}, {"question": "b?", "expected_doc_ids": ["gone", ""]}]))
    out = tmp_path / "out"
    with pytest.raises(SystemExit):
        cli.main(["export", "--docs", str(tmp_path / "docs"), "--questions", str(tmp_path / "q.json"), "--output", str(out), "--filler", "1"], spark)
    note = json.loads((out / "source.json").read_text())
    assert (note["documents"], note["filler"], note["questions"], note["expected"], note["found"], note["missing"]) == (2, 1, 2, 2, 1, 1)
    groups = {r["doc_id"]: r["allowed_group_ids"] for r in spark.read.json(str(out / "acl_docs")).collect()}
    assert groups["g1"] == ["role:admin", "role:employee", "source:github"]
    assert sorted(r["id"] for r in spark.read.json(str(out / "questions")).collect()) == ["q_0001", "q_0002"]


def test_ingest_query_embeds(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.stream_ingest_resume(spark, folder).collect()
    assert got and all(r["vector_hash"] is not None for r in got) and len({r["vector_hash"] for r in got}) > 1


def test_letters_are_letter_counts(spark):
    texts = ["Hello, World", "", "zzz ÄB 12"]
    want = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(embedding.letter_counts(F.col("t"))).collect()]
    assert embedding.Letters().embed(texts, "document") == want
