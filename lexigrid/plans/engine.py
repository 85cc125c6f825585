"""The engine: incremental ingest into collections, search in three modes, verification, evaluation, answers."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid import defaults as D
from lexigrid.errors import EvaluationError, IngestError, ProviderError, RetrievalError
from lexigrid.functions import text as T
from lexigrid.operators import chunking, citations, context, dense, evaluation, fusion, ingest, lexical, metadata
from lexigrid.operators.joins import BROADCAST_ROWS, few, hinted
from lexigrid.shared import kept
from lexigrid.providers import Chat, Embedder, PairScorer, guarded, pair_logits
from lexigrid.sources.collection import Collection, list_collections
from lexigrid.sources.files import Extractor, load_directory

#: Collections that are kept open.
OPEN = 8
STORED = "document_id string, source string, fingerprint string, source_class string, extractor string, n_chars int"
ANSWER_PROMPT = "{sources}\n\nAnswer from the sources alone and cite them as [n].\n{question}"
REWRITE_PROMPT = "Rewrite the question as one line for a search.\n{question}"


@dataclass(frozen=True)
class Chunking:
    size: int = D.CHUNK_SIZE
    overlap: int = D.CHUNK_OVERLAP
    separators: tuple[str, ...] = D.SEPARATORS

    @property
    def settings(self) -> str:
        own = {"chunker": "recursive", "chunk_size": self.size, "chunk_overlap": self.overlap}
        if self.separators != D.SEPARATORS:
            own["separators"] = self.separators
        return json.dumps(own, separators=(",", ":"))

    def apply(self, docs: DataFrame, *carried: str) -> DataFrame:
        return chunking.recursive_chunks(docs, self.size, self.overlap, self.separators, carried)


@dataclass
class Counters:
    """How often an open collection was found current, opened, found outdated, and let go."""

    hits: int = 0
    misses: int = 0
    outdated: int = 0
    evicted: int = 0


@dataclass
class Runtime:
    """A collection at one generation, with the tables that were opened."""

    collection: Collection
    generation: int
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def read(self, table: str) -> DataFrame:
        if table not in self.tables:
            self.tables[table] = self.collection.read(table)
        return self.tables[table]


@dataclass(frozen=True)
class Response:
    """Hits and how they came about."""

    hits: DataFrame
    metadata: dict


@dataclass
class Report:
    """One evaluation run: what was run, every hit, the metrics of each query, and means with latencies."""

    config: dict
    hits: DataFrame
    metrics: DataFrame
    means: DataFrame
    abstained: dict

    def deltas(self) -> DataFrame:
        return evaluation.stage_deltas(self.means.filter("category IS NULL").drop("category"), "bm25")

    def attribution(self) -> DataFrame | None:
        """What the reranker adds to the stage whose hits it reordered; None without one."""
        if "rerank" not in self.config["stages"]:
            return None
        return evaluation.stage_deltas(self.means.filter("category IS NULL").drop("category"), self.config["rerank_input"], "rerank")

    def write(self, path: str) -> None:
        """The tables as Parquet, and what was run as one JSON line; a report that is there already is an error."""
        spark = self.hits.sparkSession
        for name in ("hits", "metrics", "means"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        self.deltas().write.parquet(f"{path}/deltas")
        spark.createDataFrame([(json.dumps({"schema_version": 1, **self.config, "abstained": self.abstained}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/run")


def prompt_hash(template: str) -> str:
    return hashlib.sha256(template.encode()).hexdigest()


class Engine:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.open: OrderedDict[str, Runtime] = OrderedDict()
        self.counters = Counters()

    def runtime(self, name: str) -> Runtime:
        """The collection at its newest generation, with the tables opened before if that is still the one; beyond OPEN the least recently used is let go."""
        held = self.open.pop(name, None)
        col = held.collection if held else Collection(self.spark, self.root, name)
        col.refresh()
        if held and held.generation == col.generation:
            self.counters.hits += 1
        else:
            self.counters.misses += held is None
            self.counters.outdated += held is not None
            held = Runtime(col, col.generation)
        self.open[name] = held
        while len(self.open) > OPEN:
            self.open.popitem(last=False)
            self.counters.evicted += 1
        return held

    def collection(self, name: str) -> Collection:
        return self.runtime(name).collection

    def collections(self) -> list[str]:
        return list_collections(self.spark, self.root)

    # ingest

    def _stored(self, col: Collection) -> DataFrame:
        return col.read("documents") if col.has("documents") else self.spark.createDataFrame([], STORED)

    def ingest(self, name: str, docs: DataFrame, root: str = "", prune: bool = True, how: Chunking = Chunking(), embedder: Embedder | None = None) -> dict:
        """Bring a collection up to date with ``docs`` (document_id, source, content[, source_class, extractor, metadata]).

        Unchanged sources are found by fingerprint before anything is chunked or embedded,
        and nothing of theirs is written again. With ``prune``, stored sources below
        ``root`` that ``docs`` lacks go; a source whose text became blank goes in any case.
        Where nothing changed there is no new generation. Chunks of unknown documents,
        vectors of another width, a source twice, and a collection that lost its vectors
        are refused before the pointer moves.
        """
        col = self.collection(name)
        identity = embedder.identity if embedder else None
        col.check_identity(identity)
        stored = self._stored(col)
        if col.identity and not stored.isEmpty() and (not col.has("vectors") or col.read("vectors").isEmpty()):
            raise IngestError(f"collection {name} is bound to {col.identity} but holds no vectors")
        text = lambda c, kind="string": F.col(c) if c in docs.columns else F.lit(None).cast(kind)
        docs = docs.select("document_id", "source", "content", F.coalesce(text("source_class"), F.lit("text")).alias("source_class"), text("extractor").alias("extractor"), text("metadata", "map<string,string>").alias("metadata"))
        status = kept(ingest.diff_sources(docs, stored, how.settings), "status")
        ingest.refuse_repeats(status, "source")
        totals = {r.status: r.n for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        gone = kept(ingest.pruned_sources(docs, stored, root) if prune else stored.select("source").limit(0), "gone")
        pruned = gone.count()
        n_fresh, n_gone = totals.get("new", 0) + totals.get("changed", 0), totals.get("changed", 0) + totals.get("emptied", 0) + pruned
        out = {"files_seen": sum(totals.values()), "documents_indexed": n_fresh, "documents_skipped": totals.get("unchanged", 0), "documents_emptied": totals.get("emptied", 0), "documents_pruned": pruned}
        if not n_fresh and not n_gone:
            return out | {"chunks_written": 0, "vectors_written": 0, "vectors_deleted": 0, "generation": col.generation}
        replaced = status.filter("status IN ('changed', 'emptied')").select("source").union(gone)
        dead = kept(stored.join(hinted(replaced, n_gone <= BROADCAST_ROWS), "source", "left_semi").select("document_id"), "dead")
        fresh = docs.filter(~F.coalesce(T.is_blank(F.col("content")), F.lit(False))).withColumn("fingerprint", ingest.fingerprint(F.col("content"), how.settings))
        if n_same := totals.get("unchanged", 0):  # a join that is no broadcast would shuffle texts, so the shorter side is taken
            same = status.filter("status = 'unchanged'").select("source")
            wanted = status.filter("status IN ('new', 'changed')").select("source")
            fresh = fresh.join(hinted(wanted, True), "source", "left_semi") if n_fresh <= BROADCAST_ROWS else fresh.join(hinted(same, n_same <= BROADCAST_ROWS), "source", "left_anti")
        n_dead_vectors = col.read("vectors").join(hinted(dead, n_gone <= BROADCAST_ROWS), "document_id", "left_semi").count() if col.has("vectors") and n_gone else 0
        n_chunks = self._write(col, fresh, dead if n_gone else None, how, embedder)
        return out | {"chunks_written": n_chunks, "vectors_written": n_chunks if embedder else 0, "vectors_deleted": n_dead_vectors, "generation": col.compact()}

    def _write(self, col: Collection, docs: DataFrame, dead: DataFrame | None, how: Chunking, embedder: Embedder | None) -> int:
        """One generation: each table is made from the one written before it, so that no text is chunked twice, and no text or token is shuffled."""
        draft = col.draft(embedder.identity if embedder else None)
        documents = draft.write("documents", docs.select("document_id", "source", "fingerprint", "source_class", "extractor", F.length("content").alias("n_chars")))
        made = how.apply(docs.select("document_id", "source", "content", metadata.with_source(F.col("metadata"), F.col("source")).alias("metadata")), "metadata")
        chunks = draft.write("chunks", made.select("chunk_id", *lexical.TIES, "start_offset", "end_offset", "content", "content_hash", "metadata"))
        ingest.refuse_orphans(chunks, documents)
        ingest.refuse_repeats(documents, "document_id")
        draft.write("postings", lexical.stored_postings(chunks))
        if embedder:
            vectors = chunks.select(*lexical.TIES, "metadata", embedder.column(F.col("content")).alias("vector"))
            draft.write("vectors", dense.check_width(vectors, embedder.identity["dimensions"]))
        copies = docs.filter("source_class = 'snapshot'").select("document_id", "content")
        if col.has("snapshots") or not copies.isEmpty():
            draft.write("snapshots", copies)
        n_chunks = chunks.count()
        draft.commit(dead)
        return n_chunks

    def ingest_directory(self, name: str, folder: str, extractors: Mapping[str, Extractor] | None = None, **options) -> dict:
        return self.ingest(name, load_directory(self.spark, folder, extractors, keep_blank=True), root=folder, **options)

    def delete(self, name: str, document_ids: list[str]) -> dict:
        """Remove documents with their chunks, postings, vectors and copies. Unknown ids remove nothing."""
        run = self.runtime(name)
        asked = self.spark.createDataFrame([(i,) for i in document_ids], "document_id string")
        dead = run.read("documents").join(F.broadcast(asked), "document_id", "left_semi").select("document_id")  # the caller's list
        count = lambda t: run.read(t).join(F.broadcast(dead), "document_id", "left_semi").count() if run.collection.has(t) else 0
        out = {"documents_deleted": dead.count(), "chunks_deleted": count("chunks"), "vectors_deleted": count("vectors")}
        if out["documents_deleted"]:
            run.collection.draft(run.collection.identity).commit(dead)
        return out | {"generation": run.collection.compact()}

    # lookups

    def document_id(self, name: str, source: str) -> str | None:
        row = self.runtime(name).read("documents").filter(F.col("source") == source).first()
        return row and row.document_id

    def document_hash(self, name: str, source: str) -> str | None:
        row = self.runtime(name).read("documents").filter(F.col("source") == source).first()
        return row and row.fingerprint

    def document_record(self, name: str, document_id: str) -> dict | None:
        row = self.document_records(name).filter(F.col("document_id") == document_id).first()
        return row and row.asDict()

    def document_sources(self, name: str) -> DataFrame:
        return self.runtime(name).read("documents").select("source", "document_id")

    def document_records(self, name: str) -> DataFrame:
        return self.runtime(name).read("documents").select("document_id", "source", "source_class", "extractor")

    def chunk(self, name: str, chunk_id: str) -> dict | None:
        row = self.runtime(name).read("chunks").filter(F.col("chunk_id") == chunk_id).first()
        return row and row.asDict()

    # search

    def search(self, name: str, queries: DataFrame, mode: str = "bm25", k: int = D.TOP_K, threshold: float | None = None, embedder: Embedder | None = None, where: Mapping[str, str] | None = None) -> DataFrame:
        """Cited hits of queries (query_id, query). The threshold does not apply to hybrid ranks.

        ``where`` are metadata entries that a chunk's metadata must hold; dense search
        looks at such chunks only, so the filter comes before the cut.
        """
        if mode not in D.MODES:
            raise RetrievalError(f"mode must be one of {D.MODES}, not {mode!r}")
        if where and mode != "dense":
            raise RetrievalError("a metadata filter needs the dense mode")
        bad = queries.filter(F.col("query").isNull() | T.is_blank(F.col("query")) | (F.length("query") > D.MAX_QUERY_CHARS))
        if not bad.isEmpty():
            raise RetrievalError(f"a query is blank or over {D.MAX_QUERY_CHARS} characters")
        run = self.runtime(name)

        def by_terms() -> DataFrame:
            return lexical.search_lexical(queries, None, k, postings=run.read("postings"))

        def by_vectors() -> DataFrame:
            if embedder is None or not run.collection.has("vectors"):
                raise RetrievalError("dense search needs an embedder and a collection with vectors")
            run.collection.check_identity(embedder.identity)
            asked = dense.check_width(queries.select("query_id", embedder.column(F.col("query")).alias("vector")), embedder.identity["dimensions"])
            return dense.search_dense(asked, run.read("vectors").filter(metadata.matches(F.col("metadata"), where)), k, keys=lexical.TIES)

        if mode == "hybrid":
            hits = fusion.reciprocal_rank_fusion([by_terms(), by_vectors()], list(lexical.KEY), k, ties=lexical.TIES)
        else:
            hits = by_terms() if mode == "bm25" else by_vectors()
            hits = hits if threshold is None else hits.filter(F.col("score") >= threshold)
        return citations.with_citations(hits, run.read("chunks"), run.read("documents"), few(queries))

    def respond(self, name: str, queries: DataFrame, mode: str = "bm25", k: int = D.TOP_K, reranker: Callable[[], PairScorer] | None = None, rerank: bool = False, embedder: Embedder | None = None, depth: int = D.MAX_TOP_K) -> Response:
        """Search as a service does it: with ``rerank``, ``depth`` candidates are fetched, reordered by the reranker and cut to k.

        The metadata say which of both the caller got. To ask for a rerank without a reranker is an error.
        """
        if not 1 <= k <= depth:
            raise RetrievalError(f"top_k must be 1 to {depth}, not {k}")
        if rerank and reranker is None:
            raise RetrievalError("rerank was asked for, but there is no reranker")
        meta = {"stage": mode, "top_k": k, "reranked": rerank} | ({"rrf_k": D.RRF_K} if mode == "hybrid" else {})
        found = self.search(name, queries, mode, depth if rerank else k, embedder=embedder)
        if not rerank:
            return Response(found, meta)
        pairs = pair_logits(found.join(hinted(queries.select("query_id", "query"), few(queries)), "query_id"), reranker)
        ranked = fusion.rerank(pairs.withColumn("source", F.col("citation.source")).withColumn("start_offset", F.col("citation.start_offset")), F.col("logit"), k, ("source", "start_offset", "chunk_id"))
        hits = ranked.withColumn("is_high_confidence", F.col("score") >= D.HIGH_CONFIDENCE).select(*found.columns)
        return Response(hits, meta | {"rerank_input_depth": depth, "rerank_model": getattr(reranker, "model_name", getattr(reranker, "__name__", type(reranker).__name__))})

    def assemble(self, name: str, queries: DataFrame, k: int = D.TOP_K, budget: int = D.CONTEXT_TOKENS) -> DataFrame:
        """(query_id, context, n_blocks): the framed hits of each query that fit into the budget."""
        return context.assemble(self.search(name, queries, k=k), budget)

    def fetch(self, name: str, chunk_id: str, current: DataFrame, extractors: tuple[str, ...] = ()) -> dict:
        """A chunk with its verdict; its content only if the source still holds it."""
        run = self.runtime(name)
        chunk = run.read("chunks").filter(F.col("chunk_id") == chunk_id).drop("metadata")
        cited = chunk.join(run.read("documents"), "document_id").withColumn("expected", F.col("content"))
        copies = run.read("snapshots") if run.collection.has("snapshots") else None
        row = citations.verify(cited, current, extractors, copies).first()
        if row is None:
            raise RetrievalError(f"no chunk {chunk_id}")
        return {"chunk_id": chunk_id, "source": row.source, "verdict": row.verdict, "content": row.content if row.verdict == "verified" else None}

    def status(self, name: str) -> dict:
        run = self.runtime(name)
        counts = {t: run.read(t).count() if run.collection.has(t) else 0 for t in ("documents", "chunks", "vectors")}
        return {"collection": name, "generation": run.generation, "identity": run.collection.identity, **counts, "cache": asdict(self.counters)}

    # evaluation

    def evaluate(self, name: str, judgments: DataFrame, docs: DataFrame, root: str = "", k: int = D.MIN_EVAL_TOP_K, embedder: Embedder | None = None, reranker: Callable[[], PairScorer] | None = None, candidates: int = D.MAX_TOP_K) -> Report:
        """Run every stage the models allow over one index: bm25, then dense and fusion with an embedder, then rerank over the last of them.

        Gold quotes are resolved in ``docs`` (document_id, source, content) by their path
        below ``root``, first of all, and fail loudly. A stage's queries are one batch, so
        the latency of each of them is the batch's.
        """
        if not D.MIN_EVAL_TOP_K <= k <= D.MAX_TOP_K or not k <= candidates <= D.MAX_TOP_K:
            raise EvaluationError(f"top_k must be {D.MIN_EVAL_TOP_K} to {D.MAX_TOP_K}, and candidates from it to {D.MAX_TOP_K}")
        relpath = F.col("source") if not root else F.expr(f"substring(source, {len(root.rstrip('/')) + 2})")
        named = docs.select("document_id", relpath.alias("relpath"), "content")
        quotes = judgments.select("query_id", F.explode("gold").alias("g")).select("query_id", "g.doc", "g.quote")
        if quotes.isEmpty():
            raise EvaluationError("no judgment has gold")
        spans = evaluation.resolved_quotes(quotes, named)
        gold = evaluation.gold_chunks(spans, self.runtime(name).read("chunks"))
        queries = judgments.select("query_id", "query")
        last = "fusion" if embedder else "bm25"
        plan = [("bm25", "bm25", False)] + ([("dense", "dense", False), ("fusion", "hybrid", False)] if embedder else []) + ([("rerank", "hybrid" if embedder else "bm25", True)] if reranker else [])
        staged, took = [], []
        for stage, mode, again in plan:
            began = time.perf_counter()
            hits = self.respond(name, queries, mode, k, reranker if again else None, again, embedder, candidates).hits
            hits = hits.select(F.lit(stage).alias("stage"), "query_id", "rank", "score", "citation.document_id", "chunk_index", "citation.start_offset", "citation.end_offset")
            hits = kept(hits, "hits")  # at most k a query
            took.append((stage, (time.perf_counter() - began) * 1000))
            staged.append(hits)
        found = staged[0]
        for more in staged[1:]:
            found = found.unionByName(more)
        latency = self.spark.createDataFrame(took, "stage string, ms double").select("stage", *[F.col("ms").alias(f"p{q}_ms") for q in (50, 95, 99)])
        metrics = evaluation.query_metrics(found, gold, lexical.KEY, ("stage",)).join(judgments.select("query_id", "category"), "query_id")
        means = evaluation.by_stage_and_category(metrics).join(F.broadcast(latency), "stage")
        marked = found.join(gold.withColumn("is_relevant", F.lit(True)), ["query_id", *lexical.KEY], "left").join(named.select("document_id", "relpath"), "document_id", "left")
        hits = marked.select("stage", "query_id", "rank", F.col("relpath").alias("document"), "start_offset", "end_offset", "score", F.coalesce("is_relevant", F.lit(False)).alias("is_relevant"))
        unanswerable = judgments.filter("category = 'no_answer'").select("query_id")
        answered = {r.stage: r.n for r in found.join(unanswerable, "query_id", "left_semi").groupBy("stage").agg(F.count_distinct("query_id").alias("n")).collect()}
        n = unanswerable.count()
        config = {"collection": name, "generation": self.runtime(name).generation, "top_k": k, "stages": [s for s, _, _ in plan], "embedding": embedder.identity if embedder else None} | ({"rerank_input": last, "rerank_candidates": candidates} if reranker else {})
        return Report(config, hits, metrics, means, {s: n - answered.get(s, 0) for s, _, _ in plan})

    # answers

    def answer(self, name: str, question: str, chat: Chat, rewrite: bool = False, judge: Chat | None = None, k: int = D.TOP_K) -> dict:
        """Search, answer from numbered sources, and have the answer judged. Only this method talks to a model."""
        chat, one = guarded(chat), self.spark.createDataFrame([(0, question)], "query_id long, query string")

        def read(expression, text: str):
            return self.spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x

        if rewrite:
            line = read(T.rewrite_line, chat.complete(REWRITE_PROMPT.format(question=question)))
            if line is None:
                raise ProviderError("the rewrite is not one line")
            one = self.spark.createDataFrame([(0, line)], "query_id long, query string")
        found = context.within_budget(self.search(name, one, k=k), T.token_estimate(F.col("content"))).orderBy("rank").collect()
        sources = found and read(lambda _: T.numbered_sources(F.array(*[F.lit(r.content) for r in found])), "")
        text = chat.complete(ANSWER_PROMPT.format(sources=sources, question=question))
        if not text.strip():
            raise ProviderError("an empty answer")
        if read(lambda t: T.marker_out_of_range(t, F.lit(len(found))), text):
            raise ProviderError("the answer cites a source that is not there")
        cited = [found[n - 1].citation.asDict() for n in read(T.markers, text)]
        out = {"answer": text, "citations": cited, "verdict": None, "prompt_hash": prompt_hash(ANSWER_PROMPT)}
        if judge:
            verdict = read(T.verdict, guarded(judge).complete(f"{sources}\n\n{text}"))
            if verdict is None:
                raise ProviderError("the verdict is malformed")
            out["verdict"] = verdict.asDict()
        return out

    def answer_all(self, name: str, judgments: DataFrame, chat: Chat, judge: Chat | None = None, k: int = D.TOP_K) -> DataFrame:
        """Tallies of the answers to all judgments: answered with citations, abstained without, rejected where the model's answer was refused. A labelled set is small; the model is asked in its order."""
        rows = []
        for r in judgments.select("query_id", "query").orderBy("query_id").toLocalIterator():
            try:
                got = self.answer(name, r.query, chat, judge=judge, k=k)
                rows.append(("answered" if got["citations"] else "abstained", got["verdict"] and got["verdict"]["faithful"]))
            except ProviderError:
                rows.append(("rejected", None))
        return context.answer_tallies(self.spark.createDataFrame(rows, "outcome string, faithful boolean"))
