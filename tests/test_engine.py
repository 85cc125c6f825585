import json

import pytest
from pyspark.sql import functions as F

from lexigrid.errors import EvaluationError, IdentityError, IngestError, ProviderError, RetrievalError
from lexigrid.plans.echo import echo_check, make_cases, score_answers
from lexigrid.plans.engine import Engine
from lexigrid.operators import ingest, lexical
from lexigrid.providers import HashEmbedder, ScriptedChat
from lexigrid.sources.collection import Collection, list_collections
from lexigrid.sources.fetched import load_fetched
from lexigrid.sources.files import Extractor, contained, discover, load_directory, load_files
from lexigrid.sources.judgments import load_judgments
from lexigrid.streaming.ingest import newest, stream_into


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "docs"
    (d / ".hidden").mkdir(parents=True)
    (d / "a.md").write_text("Queues hold work.\r\nWorkers take work from queues.")
    (d / "b.TXT").write_text("Locks guard state. A lock is held by one worker.")
    (d / ".dot.md").write_text("Recovery replays a log.")
    (d / "c.pdf").write_text("no")
    (d / "blank.txt").write_text(" \n")
    (d / ".hidden" / "x.md").write_text("never")
    return d


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_discovery_and_loading(spark, folder):
    assert [p.rsplit("/", 1)[1] for p in discover(str(folder))] == [".dot.md", "a.md", "b.TXT", "blank.txt"]
    docs = {r.source.rsplit("/", 1)[1]: r for r in load_directory(spark, str(folder)).collect()}
    assert set(docs) == {".dot.md", "a.md", "b.TXT"} and "\r" not in docs["a.md"].content and docs["b.TXT"].metadata["file_extension"] == ".txt"
    (folder / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="UTF-8"):
        load_directory(spark, str(folder)).collect()
    with pytest.raises(IngestError):
        contained(f"{folder}/../x", str(folder))


def test_life_of_a_collection(spark, folder, tmp_path):
    engine, place = Engine(spark, str(tmp_path / "root")), str(folder)
    first = engine.ingest_directory("c", place, embedder=HashEmbedder(16))
    assert (first["documents_indexed"], first["generation"]) == (3, 1)
    again = engine.ingest_directory("c", place, embedder=HashEmbedder(16))
    assert (again["documents_indexed"], again["documents_skipped"], again["chunks_written"], again["generation"]) == (0, 3, 0, 1)
    hits = engine.search("c", ask(spark, "worker queues", "log"), k=3).collect()
    top = {r.query_id: r.citation.source.rsplit("/", 1)[1] for r in hits if r["rank"] == 1}
    assert top == {0: "a.md", 1: ".dot.md"}
    assert all(r.content in (folder / r.citation.source.rsplit("/", 1)[1]).read_text().replace("\r\n", "\n") for r in hits)
    dense = engine.search("c", ask(spark, "Recovery replays a log."), "dense", embedder=HashEmbedder(16)).collect()
    assert max(dense, key=lambda r: r.score).citation.source.endswith(".dot.md")
    assert engine.search("c", ask(spark, "locks"), "hybrid", embedder=HashEmbedder(16)).count() > 0
    chunk = next(r for r in hits if r.citation.source.endswith("a.md"))
    assert engine.fetch("c", chunk.chunk_id, load_directory(spark, place))["verdict"] == "verified"

    (folder / "a.md").write_text("Nothing about that.")
    (folder / "b.TXT").unlink()
    assert engine.fetch("c", chunk.chunk_id, load_directory(spark, place))["verdict"] == "drifted"
    with pytest.raises(IdentityError):
        engine.ingest_directory("c", place)
    third = engine.ingest_directory("c", place, embedder=HashEmbedder(16))
    assert (third["documents_indexed"], third["documents_pruned"], third["vectors_deleted"] > 0) == (1, 1, True)
    assert engine.search("c", ask(spark, "queues")).isEmpty()
    status = engine.status("c")
    assert (status["documents"], status["generation"], status["identity"]["dimensions"]) == (2, 2, 16) and engine.collections() == ["c"]
    for bad in (lambda: engine.search("c", ask(spark, " ")), lambda: engine.search("c", ask(spark, "x"), "sparse"), lambda: engine.search("c", ask(spark, "x"), k=0)):
        with pytest.raises(RetrievalError):
            bad()
    with pytest.raises(IngestError):
        engine.collection("../c")


def test_evaluation_and_answers(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"))
    engine.ingest_directory("c", str(folder))
    lines = [
        {"query_id": "q-a", "query": "who takes work", "category": "normal", "gold": [{"doc": "a.md", "quote": "Workers take work from queues."}], "notes": ""},
        {"query_id": "q-b", "query": "zebra", "category": "no_answer", "gold": [], "notes": ""},
    ]
    path = tmp_path / "j.jsonl"
    path.write_text("\n\n".join(map(json.dumps, lines)))
    docs, place = load_directory(spark, str(folder)), str(folder)
    report = engine.evaluate("c", load_judgments(spark, str(path)), docs, place)
    means = report.means.collect()
    assert {(r.stage, r.category, r.n_queries, r.recall_1) for r in means} == {("bm25", None, 1, 1.0), ("bm25", "normal", 1, 1.0)}
    assert report.abstained == {"bm25": 1} and report.attribution() is None and means[0].p50_ms > 0
    report.write(str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "hits")).filter("is_relevant").first().document == "a.md"
    with pytest.raises(Exception, match="already exists"):
        report.write(str(tmp_path / "report"))
    with pytest.raises(EvaluationError, match="no judgment"):
        engine.evaluate("c", load_judgments(spark, str(path)).filter("category = 'no_answer'"), docs, place)
    (folder / "xa.md").write_text("Workers take work from queues. Workers take work from queues.")
    again = load_directory(spark, place)  # xa.md ends as a.md does, and is another document
    assert engine.evaluate("c", load_judgments(spark, str(path)), again, place).means.count() == 2
    for doc, quote, what in (("xa.md", "Workers take work from queues.", "more than once"), ("a.md", "never said", "not there"), ("b.md", "x", "no such document")):
        lines[0]["gold"] = [{"doc": doc, "quote": quote}]
        path.write_text("\n".join(map(json.dumps, lines)))
        with pytest.raises(EvaluationError, match=what):
            engine.evaluate("c", load_judgments(spark, str(path)), again, place)
    path.write_text(json.dumps(lines[0]) + "\n\n{nonsense")
    with pytest.raises(EvaluationError, match="line 3"):
        load_judgments(spark, str(path))
    path.write_text("\n".join(map(json.dumps, reversed(lines))))
    with pytest.raises(EvaluationError, match="line 2: q-a: .*above"):
        load_judgments(spark, str(path))
    judge = ScriptedChat(['{"faithful": true, "unsupported_claims": [], "reasoning": "ok"}'])
    got = engine.answer("c", "who takes work?", ScriptedChat(["worker work", "Workers do [1]."]), rewrite=True, judge=judge)
    assert got["citations"][0]["source"].endswith("a.md") and got["verdict"]["faithful"]
    with pytest.raises(ProviderError):
        engine.answer("c", "work", ScriptedChat(["See [9]."]))


class Longest:
    """A scorer that likes long texts."""

    def score(self, query, texts):
        return [len(t) / 10 for t in texts]


def test_rerank_is_said_and_attributed(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"))
    engine.ingest_directory("c", str(folder), embedder=HashEmbedder(8))
    q = ask(spark, "worker log work")
    plain, again = engine.respond("c", q, k=2), engine.respond("c", q, k=2, reranker=Longest, rerank=True)
    assert plain.metadata == {"stage": "bm25", "top_k": 2, "reranked": False} and again.metadata["rerank_input_depth"] == 50 and again.metadata["rerank_model"] == "Longest"
    lengths = [len(r.content) for r in again.hits.orderBy("rank").collect()]
    assert len(lengths) == 2 and lengths == sorted(lengths, reverse=True) and again.hits.columns == plain.hits.columns
    with pytest.raises(RetrievalError, match="no reranker"):
        engine.respond("c", q, rerank=True)
    judgments = spark.createDataFrame([("q-a", "who takes work", "normal", [("a.md", "Workers take work from queues.")], "")], "query_id string, query string, category string, gold array<struct<doc:string,quote:string>>, notes string")
    report = engine.evaluate("c", judgments, load_directory(spark, str(folder)), str(folder), embedder=HashEmbedder(8), reranker=Longest)
    assert report.config["stages"] == ["bm25", "dense", "fusion", "rerank"] and report.config["rerank_input"] == "fusion"
    own = report.attribution().first()
    assert (own.stage, own.baseline) == ("rerank", "fusion") and report.deltas().count() == 3
    framed = engine.assemble("c", q, k=3).first()
    assert framed.n_blocks >= 1 and framed.context.count("<retrieved_context>") == framed.n_blocks
    tallies = engine.answer_all("c", judgments, ScriptedChat(["Workers do [1]."])).first()
    assert (tallies.n, tallies.answered, tallies.abstained) == (1, 1, 0)


def test_deletes_lookups_and_filters(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"))
    engine.ingest_directory("c", str(folder), embedder=HashEmbedder(8))
    sources = {r.source.rsplit("/", 1)[1]: r.document_id for r in engine.document_sources("c").collect()}
    where = {"file_extension": ".txt"}
    found = engine.search("c", ask(spark, "work"), "dense", 5, embedder=HashEmbedder(8), where=where).collect()
    assert [r.citation.source.rsplit("/", 1)[1] for r in found] == ["b.TXT"]
    assert engine.search("c", ask(spark, "work"), "dense", 5, embedder=HashEmbedder(8), where=where | {"nowhere": "x"}).isEmpty()
    with pytest.raises(RetrievalError, match="dense"):
        engine.search("c", ask(spark, "work"), where=where)
    gone = sources["a.md"]
    assert engine.document_record("c", gone)["source_class"] == "text" and engine.document_hash("c", f"{folder}/a.md") and engine.document_id("c", "nowhere") is None
    out = engine.delete("c", [gone, "unknown"])
    assert (out["documents_deleted"], out["chunks_deleted"], out["vectors_deleted"], out["generation"]) == (1, 1, 1, 2)
    assert engine.delete("c", [gone])["generation"] == 2 and engine.document_record("c", gone) is None
    assert engine.search("c", ask(spark, "queues")).isEmpty() and engine.counters.outdated == 2 and engine.counters.hits > 3
    back = engine.ingest_directory("c", str(folder), embedder=HashEmbedder(8))
    assert back["documents_indexed"] == 1 and engine.search("c", ask(spark, "queues")).count() == 1


def test_siblings_emptied_files_and_refused_writes(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"))
    other = tmp_path / "docs2"
    other.mkdir()
    (other / "z.md").write_text("Zebras graze.")
    engine.ingest_directory("c", str(folder))
    engine.ingest_directory("c", str(other))
    out = engine.ingest_directory("c", str(folder))  # /docs2 only begins as /docs does
    assert out["documents_pruned"] == 0 and engine.search("c", ask(spark, "zebras")).count() == 1
    (folder / "a.md").write_text(" \n")
    out = engine.ingest_directory("c", str(folder), prune=False)
    assert out["documents_emptied"] == 1 and engine.search("c", ask(spark, "queues")).isEmpty()
    twice = spark.createDataFrame([("1", "s", "x"), ("2", "s", "y")], "document_id string, source string, content string")
    with pytest.raises(IngestError, match="more than once"):
        engine.ingest("d", twice)

    class Wrong(HashEmbedder):
        identity = {"provider": "hash", "model_name": "wrong", "dimensions": 9}

    with pytest.raises(Exception, match="expected 9 dimensions"):
        engine.ingest("d", twice.limit(1), embedder=Wrong(8))
    assert engine.collection("d").generation == 0
    chunks = spark.createDataFrame([("x",)], "document_id string")
    with pytest.raises(IngestError, match="not registered"):
        ingest.refuse_orphans(chunks, twice)
    lost = Collection(spark, str(tmp_path / "root"), "lost")
    engine.ingest("whole", twice.limit(1), embedder=HashEmbedder(8))
    lost.commit({"documents": engine.collection("whole").read("documents")}, identity=HashEmbedder(8).identity)
    with pytest.raises(IngestError, match="no vectors"):
        engine.ingest("lost", twice.limit(1), embedder=HashEmbedder(8))


def test_two_writers_and_compaction(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, f"s{i}") for i in ids], "document_id string, source string")
    root = str(tmp_path / "root")
    a, b = Collection(spark, root, "c"), Collection(spark, root, "c")
    a.commit({"documents": rows("1", "2")})
    with pytest.raises(IngestError, match="another writer"):
        b.commit({"documents": rows("8", "9")})
    late = Collection(spark, root, "c")
    assert late.generation == 1 and {r.document_id for r in late.read("documents").collect()} == {"1", "2"}
    b.refresh()
    b.commit({"documents": rows("3")}, removed=rows("1"))
    b.commit({"documents": rows("1")}, removed=rows("2"))
    want = {"1", "3"}
    assert {r.document_id for r in b.read("documents").collect()} == want
    assert {r.document_id for r in late.read("documents").collect()} == {"1", "2"}  # a reader stays with its generation
    assert b.compact(most=1) == 4 and len(b.state["parts"]) == 1 and {r.document_id for r in b.read("documents").collect()} == want
    b.drop_old(1)
    assert len(b.files.names(b.base, True)) == 1 and {r.document_id for r in Collection(spark, root, "c").read("documents").collect()} == want
    assert list_collections(spark, root) == ["c"]


def test_fetched_pages_are_checked_against_their_copies(spark, tmp_path):
    page = ("http://h.org/a", "text/html; charset=utf-8", b"<p>Queues hold work.</p><script>no</script>")
    schema = "url string, content_type string, body binary"
    engine = Engine(spark, str(tmp_path / "root"))
    docs = load_fetched(spark.createDataFrame([page, ("http://h.org/b", "text/plain; charset=latin-1", "Caf\xe9 work".encode("latin-1"))], schema))
    engine.ingest("c", docs)
    hits = engine.search("c", ask(spark, "work"), k=5).collect()
    assert {(r.content, r.citation.source_class) for r in hits} == {("Queues hold work.", "snapshot"), ("Caf\xe9 work", "snapshot")}
    nothing = docs.limit(0)
    assert {engine.fetch("c", r.chunk_id, nothing)["verdict"] for r in hits} == {"verified"}
    out = engine.delete("c", [hits[0].citation.document_id])
    assert out["documents_deleted"] == 1 and engine.collection("c").read("snapshots").count() == 1
    for bad in (("http://u:p@h.org/", "text/html", b"x"), ("http://h.org/?api_key=1", "text/html", b"x"), ("http://h.org/", "image/png", b"x"), ("http://h.org/", "text/plain", b"\xff"), ("http://h.org/", "text/plain; charset=koi8-r", b"x")):
        with pytest.raises(Exception, match="h.org"):
            load_fetched(spark.createDataFrame([bad], schema)).collect()


def test_other_formats_go_through_their_extractor(spark, folder):
    with pytest.raises(IngestError, match="only"):
        load_files(spark, [f"{folder}/c.pdf"], str(folder))
    docs = load_directory(spark, str(folder), {".pdf": Extractor("upper/1", lambda b: b.decode().upper())})
    row = docs.filter("source_class = 'extracted'").first()
    assert (row.content, row.extractor) == ("NO", "upper/1")


def test_a_stream_is_searchable_and_keeps_the_newest(spark, tmp_path):
    folder = tmp_path / "in"
    make = lambda rows, n: spark.createDataFrame(rows, "source string, content string, at int").coalesce(1).write.parquet(f"{folder}/{n}")
    make([("a", "zz old text", 1), ("a", "aa new text", 2), ("b", "other", 1)], "p=1")
    engine = Engine(spark, str(tmp_path / "root"))
    run = lambda n: stream_into(spark.readStream.schema("source string, content string, at int").parquet(str(folder)), engine, "c", str(tmp_path / f"progress{n}"), "at").awaitTermination()
    run(1)
    assert [r.content for r in engine.search("c", ask(spark, "text")).collect()] == ["aa new text"]
    run(2)  # all of it again, as after a failure
    assert engine.collection("c").generation == 1


def test_a_batch_shuffles_no_text(spark, tmp_path):
    """A new batch is stored without a shuffle of texts, chunks or tokens, in postings that equal those of a shuffle."""
    rows = spark.createDataFrame([(f"s{i}", f"text {i} of text " + "word " * 200, 1) for i in range(5)] + [("s0", "newer", 2), (None, "x", 1)], "source string, content string, at int")
    single = rows.filter("source <> 's0'")
    assert "Exchange" not in newest(single, "at")._jdf.queryExecution().executedPlan().toString()
    got = {r.source: r.content for r in newest(rows, "at").collect()}
    assert len(got) == 5 and got["s0"] == "newer"
    engine = Engine(spark, str(tmp_path / "root"))
    docs = newest(rows, "at").selectExpr("source AS document_id", "source", "content")
    engine.ingest("c", docs, prune=False)
    chunks, postings = (engine.collection("c").read(t) for t in ("chunks", "postings"))
    assert sorted(map(tuple, postings.collect())) == sorted(map(tuple, lexical.build_postings(chunks).select(*postings.columns).collect()))
    assert "Exchange" not in lexical.stored_postings(chunks)._jdf.queryExecution().executedPlan().toString()
    assert engine.ingest("c", docs.withColumn("content", F.expr("if(source = 's1', 'changed', content)")), prune=False)["documents_indexed"] == 1
    assert {r.metadata["source"] for r in engine.collection("c").read("chunks").collect()} == {f"s{i}" for i in range(5)}


def test_echo_check(spark):
    answers = ["It is filed there [1].", "See [2].", "Both [1][2].", "I do not know.", "See [7]."]
    scored, totals = echo_check(spark, ScriptedChat(answers))
    assert {r.case: (r.outcome, r.correct) for r in scored.collect()} == {0: ("cited_positive", True), 1: ("cited_decoy", False), 2: ("cited_decoy", False), 3: ("abstained", False), 4: ("rejected", False)}
    assert (totals["n"], totals["correct"], totals["cited_decoy"], totals["leaked"]) == (5, 1, 2, 0)
    cases = make_cases(spark, 1).cache()
    absent = cases.first().absent
    leak = spark.createDataFrame([(0, f"[1] {absent}")], "case int, answer string")
    own = score_answers(leak, cases, cases.select("source", "content")).first()
    assert own.grounded and own.leaked and not own.correct
    changed = cases.selectExpr("source", "'something else' AS content")
    assert not score_answers(leak, cases, changed).first().grounded and "[" not in absent
    cases.unpersist()
