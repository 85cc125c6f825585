"""Queries over the driver's tables: one for each operator of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid import defaults as D
from lexigrid.functions import text as T
from lexigrid.functions import urls, vectors
from lexigrid.operators import chunking, citations, context, dense, evaluation, fusion, ingest, lexical
from lexigrid.operators.html_text import html_text as to_text
from lexigrid.operators.joins import few, hinted
from lexigrid.operators.layout import spread
from lexigrid.operators.metadata import matches
from lexigrid.operators.redaction import redacted, restored
from lexigrid.streaming.ingest import stream_ingest

K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as the library takes them; the source column is not unique, so the id makes the source."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source"), F.coalesce("text", F.lit("")).alias("content"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


# text primitives and the lexical index


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(F.col("content"))
    return documents(spark, sf_dir).select(F.col("document_id").alias("doc_id"), F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"))


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_counts(documents(spark, sf_dir))


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.length_stats(documents(spark, sf_dir)).withColumn("avg_len", F.round("avg_len", 6))


def _hits(hits: DataFrame, *columns: str) -> DataFrame:
    return hits.select("query_id", "rank", F.col("document_id").alias("doc_id"), *columns, "score")


def bm25_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(lexical.search_lexical(items(spark, sf_dir), chunking.whole_documents(documents(spark, sf_dir)), K))


def bm25_repeated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = items(spark, sf_dir).withColumn("query", F.concat_ws(" ", "query", F.regexp_extract("query", r"^(\S+)", 1), F.regexp_extract("query", r"^(\S+)", 1)))
    return _hits(lexical.search_lexical(twice, chunking.whole_documents(documents(spark, sf_dir)), K))


def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = documents(spark, sf_dir).select("document_id", T.content_hash(F.col("content")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("first_doc")).filter("n > 1")


# chunks and provenance


def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_windows(documents(spark, sf_dir)).select(F.col("document_id").alias("doc_id"), "chunk_index", "start_offset", "end_offset", "content_hash")


def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive_chunks(documents(spark, sf_dir)).select(F.col("document_id").alias("doc_id"), "chunk_index", "start_offset", "end_offset", "content_hash")


def bm25_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(lexical.search_lexical(items(spark, sf_dir), chunking.fixed_windows(documents(spark, sf_dir)), K), "chunk_index")


def _cited(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs, queries = documents(spark, sf_dir), items(spark, sf_dir)
    chunks = chunking.fixed_windows(docs)
    return citations.with_citations(lexical.search_lexical(queries, chunks, k), chunks, docs, few(queries))


def result_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cited(spark, sf_dir, D.TOP_K)
    return out.select("query_id", "rank", "score", "is_high_confidence", "citation.source", "citation.start_offset", "citation.end_offset", "citation.source_class")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("document_id").alias("doc_id"), T.snippet(F.col("content")).alias("snippet"), T.token_estimate(F.col("content")).alias("tokens"))


# dense search


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector", "label"), rows


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = _vectors(spark, sf_dir)
    return dense.search_dense(queries, rows, K).select("query_id", "rank", "vec_id", "score")


def dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = _vectors(spark, sf_dir)
    return dense.search_dense(queries, rows, D.MAX_TOP_K, threshold=0.5).select("query_id", "rank", "vec_id", "score")


def dense_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = _vectors(spark, sf_dir)
    return dense.search_dense(queries, rows, K, by_label=True).select("query_id", "rank", "vec_id", "score")


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits among the vectors whose metadata holds all wanted entries; a key that is absent never matches."""
    queries, rows = _vectors(spark, sf_dir)
    parity = F.when(F.col("vec_id") % 3 != 0, F.map_from_arrays(F.array(F.lit("label"), F.lit("odd")), F.array(F.col("label").cast("string"), (F.col("vec_id") % 2).cast("string"))))
    held = rows.withColumn("metadata", F.coalesce(parity, F.create_map(F.lit("label"), F.col("label").cast("string"))))
    return dense.search_dense(queries, held.filter(matches(F.col("metadata"), {"label": "3", "odd": "1"})), K).select("query_id", "rank", "vec_id", "score")


def hash_embed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("document_id").alias("doc_id"), vectors.hash_embedding(F.col("content")).alias("v"))
    return rows.select("doc_id", F.size("v").alias("dims"), *[F.round(F.get("v", F.lit(k)), 6).alias(f"v{k}") for k in (0, 1, 7, 8, 383)])


# fusion and rerank


def _dense_windows(spark: SparkSession, sf_dir: str, chunks: DataFrame, k: int) -> DataFrame:
    queries = items(spark, sf_dir).select("query_id", vectors.hash_embedding(F.col("query")).alias("vector"))
    return dense.search_dense(queries, chunks, k, keys=lexical.TIES, embed=vectors.hash_vectors)


def rrf_two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over whole documents, fused with a ranking by shared distinct terms."""
    queries = items(spark, sf_dir)
    postings = lexical.build_postings(chunking.whole_documents(documents(spark, sf_dir)), queries)
    first = lexical.top_k(lexical.bm25_scores(queries, postings), K)
    shared = postings.join(hinted(lexical.query_terms(queries), few(queries)), "term").groupBy("query_id", *lexical.TIES).agg(F.count(F.lit(1)).cast("double").alias("score"))
    fused = fusion.reciprocal_rank_fusion([first, lexical.top_k(shared, K)], list(lexical.KEY), K, ties=lexical.TIES)
    return fused.select("query_id", "rank", F.col("document_id").alias("doc_id"), F.round("score", 9).alias("score"))


def hybrid_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.fixed_windows(documents(spark, sf_dir))
    first = lexical.search_lexical(items(spark, sf_dir), chunks, K)
    second = _dense_windows(spark, sf_dir, chunks, K)
    fused = fusion.reciprocal_rank_fusion([first, second], list(lexical.KEY), K, ties=lexical.TIES)
    return fused.select("query_id", "rank", F.col("document_id").alias("doc_id"), "chunk_index", F.round("score", 9).alias("score"))


def _bm25_and_rerank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """BM25's hits, and their order by a stand-in for a model: a logit from the length of the overlap. Both come from one exchange."""
    docs, queries = documents(spark, sf_dir), items(spark, sf_dir)
    small = few(queries)
    hits = lexical.search_lexical(queries, chunking.whole_documents(docs), K)
    text = docs.select("document_id", "content", "source")
    pairs = text.join(hinted(hits.select("query_id", "document_id"), small), "document_id").join(hinted(queries, small), "query_id")
    logit = evaluation.token_overlap(F.col("query"), F.col("content")) * 12 - 6
    return hits, fusion.rerank(pairs.withColumn("start_offset", F.lit(0)), logit, K, ("source", "start_offset"))


def sigmoid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25_and_rerank(spark, sf_dir)[1].select("query_id", "rank", F.col("document_id").alias("doc_id"), "score")


# evaluation


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.quote_places(items(spark, sf_dir).withColumnRenamed("query", "quote"), documents(spark, sf_dir))


def gold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).withColumnRenamed("document_id", "doc_id")


def gold_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gold_chunks(_spans(spark, sf_dir), chunking.fixed_windows(documents(spark, sf_dir))).select("query_id", F.col("document_id").alias("doc_id"), "chunk_index")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.fixed_windows(documents(spark, sf_dir))
    gold = evaluation.gold_chunks(_spans(spark, sf_dir), chunks)
    hits = lexical.search_lexical(items(spark, sf_dir), chunks, K)
    return evaluation.query_metrics(hits, gold, lexical.KEY)


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("query_id", "n_gold", *[F.col(f"recall_{k}") for k in D.RECALL_CUTOFFS])


def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("query_id", F.round("rr", 6).alias("rr"))


def ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def _stage_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _bm25_and_rerank(spark, sf_dir)
    return first.select(F.lit("bm25").alias("stage"), "query_id", "rank", "document_id").union(second.select(F.lit("rerank").alias("stage"), "query_id", "rank", "document_id"))


def _stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages over whole documents: BM25 as the baseline, and BM25 reordered by token overlap."""
    spans = _spans(spark, sf_dir).select("query_id", "document_id").distinct()
    sizes = spans.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    category = sizes.select("query_id", F.when(F.col("n") > 1, "ambiguous").otherwise("normal").alias("category"))
    return evaluation.query_metrics(_stage_hits(spark, sf_dir), spans, ("document_id",), ("stage",)).join(category, "query_id")


def _stage_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_stage_and_category(_stage_metrics(spark, sf_dir))


def stage_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage_means(spark, sf_dir)


def stage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stage_deltas(_stage_means(spark, sf_dir).filter("category IS NULL"), "bm25")


def rerank_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rerank stage adds to the stage whose hits it reorders, here the ranking by shared terms."""
    queries, docs = items(spark, sf_dir), documents(spark, sf_dir)
    small = few(queries)
    postings = lexical.build_postings(chunking.whole_documents(docs), queries)
    shared = postings.join(hinted(lexical.query_terms(queries), small), "term").groupBy("query_id", *lexical.TIES).agg(F.count(F.lit(1)).cast("double").alias("score"))
    first = lexical.top_k(lexical.bm25_scores(queries, postings), K)
    second = lexical.top_k(shared, K)
    pairs = docs.select("document_id", "source", F.length("content").alias("n")).join(hinted(second.select("query_id", "document_id"), small), "document_id")
    third = fusion.rerank(pairs.withColumn("start_offset", F.lit(0)), 1000.0 / (F.col("n") + 1) - 1, K, ("source", "start_offset"))
    hits = [h.select(F.lit(n).alias("stage"), "query_id", "rank", "document_id") for n, h in (("bm25", first), ("overlap", second), ("rerank", third))]
    spans = _spans(spark, sf_dir).select("query_id", "document_id").distinct()
    metrics = evaluation.query_metrics(hits[0].union(hits[1]).union(hits[2]), spans, ("document_id",), ("stage",))
    return evaluation.stage_deltas(evaluation.by_stage(metrics), "overlap", "rerank")


def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*[evaluation.nearest_rank("value", q / 100).alias(f"p{q}") for q in (50, 95, 99)])


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = documents(spark, sf_dir).join(F.broadcast(_spans(spark, sf_dir)), "document_id").join(F.broadcast(items(spark, sf_dir)), "query_id")
    return pairs.select("query_id", F.col("document_id").alias("doc_id"), F.round(evaluation.token_overlap(F.col("content"), F.col("query")), 6).alias("overlap"))


def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as queries over whole documents: how many get no hit of a score of 4 or more from BM25."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "role", F.coalesce("text", F.lit("")).alias("query"))
    return evaluation.abstentions(turns, lexical.answered(turns, chunking.whole_documents(documents(spark, sf_dir)), 4.0), "role")


# incremental ingest: labelled documents and all pages are stored, all documents are current


def _stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier version: labelled documents, those of low quality with another text, and pages."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "quality")
    earlier = documents(spark, sf_dir).join(labels, "document_id").select("document_id", "source", F.when(F.col("quality") == 0, F.concat(F.lit("v1 "), F.col("content"))).otherwise(F.col("content")).alias("content"))
    pages = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("document_id"), F.concat(F.lit("page://"), F.col("page_id").cast("string")).alias("source"), F.coalesce("html", F.lit("")).alias("content"))
    return earlier.unionByName(pages)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_texts(spark, sf_dir).select("source", ingest.fingerprint(F.col("content")).alias("fingerprint"))


def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.diff_sources(documents(spark, sf_dir), _stored(spark, sf_dir)).select("source", "status")


def pruned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.pruned_sources(documents(spark, sf_dir), _stored(spark, sf_dir), "page://")


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = documents(spark, sf_dir).select("source", ingest.fingerprint(F.col("content")).alias("fingerprint"))
    return ingest.upsert(_stored(spark, sf_dir), now)


def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    return ingest.orphans(chunking.fixed_windows(documents(spark, sf_dir)), registered).groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_chunks"))


def deleted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that go with documents labelled toxic."""
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    chunks = chunking.fixed_windows(documents(spark, sf_dir)).select("document_id")
    return chunks.join(gone, "document_id", "left_semi").groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_chunks"))


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = documents(spark, sf_dir), _stored(spark, sf_dir)
    status = ingest.diff_sources(docs, stored)
    chunks = chunking.fixed_windows(docs).select("source").join(status.filter("status IN ('new', 'changed')").select("source"), "source", "left_semi")
    return ingest.report(status, ingest.pruned_sources(docs, stored, ""), chunks)


# citations, extraction, URL rules


def citation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = chunking.fixed_windows(_stored_texts(spark, sf_dir))
    cited = stored.select("source", "chunk_index", "start_offset", "end_offset", F.col("content").alias("expected"), F.lit("text").alias("source_class"), F.lit(None).cast("string").alias("extractor"))
    return citations.verify(cited, documents(spark, sf_dir)).select("source", "chunk_index", "verdict")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id").select("page_id", to_text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text"))


def url_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(urls.refusal(F.col("url")), F.lit("none")).alias("refusal"), urls.host(F.col("url")).alias("host"))


def credential_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL with a token put behind its query, as an ingest source would carry it."""
    url = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("Api-Key=s&page=3&sig=x"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls.credential_params(url), ",").alias("names"), urls.sanitized(url).alias("sanitized"))


# boundary operators


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = context.within_budget(_cited(spark, sf_dir, K), T.token_estimate(F.col("content")), 1000)
    return kept.select("query_id", "rank", "tokens", "running")


def framed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = T.framed(F.col("content"), F.col("citation.document_id"), F.concat_ws(":", F.col("citation.document_id").cast("string"), F.col("chunk_index").cast("string")), F.col("citation.source"))
    return _cited(spark, sf_dir, K).select("query_id", "rank", T.content_hash(block).alias("block_hash"), F.length(block).alias("n_chars"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("EMAIL", "PHONE_E164", "IPV4", "SECRET_TOKEN")
    return documents(spark, sf_dir).select(F.col("document_id").alias("doc_id"), *[T.pattern_count(F.col("content"), n).alias(f"n_{n.lower()}") for n in names])


def redacted_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = documents(spark, sf_dir).select("document_id", "content", redacted(F.col("content")).alias("r"))
    return done.select(F.col("document_id").alias("doc_id"), "r.text", F.size("r.mapping").alias("n_tokens"), (restored(F.col("r.text"), F.col("r.mapping")) == F.col("content")).alias("round_trip"))


def marker_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers over two sources: a marker is put behind each sentence."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\.", ". [2][1]")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.markers(text).cast("array<string>"), ",").alias("markers"), T.marker_out_of_range(text, F.lit(2)).alias("refused"))


def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a judge's answers: fenced JSON, which is incoherent where a faithful one lists a claim."""
    flag = lambda c: F.when(F.col(c) == 1, "true").otherwise("false")
    claims = F.when(F.col("toxic") == 1, '["a claim"]').otherwise("[]")
    answer = F.concat(F.lit('```json\n{"faithful": '), flag("quality"), F.lit(', "unsupported_claims": '), claims, F.lit(', "reasoning": "doc '), F.col("doc_id").cast("string"), F.lit('"}\n```'))
    v = table(spark, sf_dir, "labels").select("doc_id", T.verdict(answer).alias("v"))
    return v.select("doc_id", F.col("v").isNotNull().alias("valid"), "v.faithful", F.size("v.unsupported_claims").alias("n_claims"), "v.reasoning")


def answer_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "answered").otherwise("abstained")
    return context.answer_tallies(table(spark, sf_dir, "labels").select(outcome.alias("outcome"), F.when(F.col("quality") == 1, F.col("toxic") == 0).alias("faithful")))


def echo_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers that must echo one frequent word and not another."""
    text = F.lower(F.coalesce("text", F.lit("")))
    outcome = context.echo_outcome(text, F.lit(" the "), F.lit(" of "), F.col("turn") % 2 == 1)
    return context.echo_tallies(table(spark, sf_dir, "conversations").select(outcome.alias("outcome")))


def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of the benchmark in the order of its ids: a labelled corpus is small enough to be hashed in one place."""
    rows = table(spark, sf_dir, "benchmark").select(F.struct(F.lpad(F.col("item_id").cast("string"), 12, "0").alias("path"), F.coalesce("text", F.lit("")).alias("text")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat(r["path"], F.lit("\x00"), r["text"], F.lit("\x00"))), "")
    return rows.agg(F.sha2(joined.cast("binary"), 256).alias("corpus_hash"), F.count(F.lit(1)).alias("n"))


NAMES = (
    tokenize_counts, term_df, length_stats, bm25_docs, bm25_repeated_terms, content_hash_dups, fixed_windows, recursive_chunks, bm25_windows,
    result_citations, snippets, dense_topk, dense_threshold, dense_label_filter, metadata_filter, hash_embed_docs, rrf_two_lists, hybrid_windows, sigmoid_rerank,
    gold_spans, gold_chunks, recall_at_k, mrr, ndcg_at_10, stage_by_category, stage_delta, rerank_attribution, percentile_nearest_rank, token_overlap, abstention,
    changed_sources, pruned_sources, upsert_merge, orphan_chunks, deleted_chunks, ingest_report, citation_verdicts, html_text, url_refusals, credential_params,
    context_budget, framed_context, pii_counts, redacted_docs, marker_parse, verdict_parse, answer_tallies, echo_tallies, corpus_hash, stream_ingest,
)

QUERIES = {f.__name__: f for f in NAMES}
