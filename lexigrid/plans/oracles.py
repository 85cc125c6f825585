"""DuckDB SQL that checks the queries, written from their definitions."""

from __future__ import annotations

from lexigrid.functions.urls import CREDENTIAL_PARAMS

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_BLANK = r"regexp_full_match({}, '[\p{{Z}}\x09-\x0d\x1c-\x1f\x{{85}}]*')"
_SETTINGS = '{"chunker":"recursive","chunk_size":512,"chunk_overlap":64}'
_TIES = "content_hash, document_id, chunk_index"


def _tok(x: str) -> str:
    return _TOK.format(x)


_DOCS = "docs AS (SELECT doc_id AS document_id, 'doc://' || doc_id AS source, coalesce(text, '') AS content FROM documents)"
_ITEMS = "items AS (SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark)"
_WHOLE = "chunks AS (SELECT document_id, source, content, 0 AS chunk_index, 0 AS start_offset, length(content) AS end_offset, sha256(content) AS content_hash FROM docs)"


def _windows(of: str = "docs", name: str = "chunks") -> str:
    return f"""
{name}_spans AS (
  SELECT document_id, source, content AS whole, unnest(range(0, 1 + CAST(ceil(greatest(length(content) - 512, 0) / 448.0) AS BIGINT))) * 448 AS start_offset
  FROM {of} WHERE length(content) > 0),
{name}_texts AS (
  SELECT document_id, source, start_offset, least(start_offset + 512, length(whole)) AS end_offset, substring(whole, start_offset + 1, 512) AS content FROM {name}_spans),
{name} AS (
  SELECT document_id, source, content, CAST(row_number() OVER (PARTITION BY source ORDER BY start_offset) - 1 AS INT) AS chunk_index, CAST(start_offset AS INT) AS start_offset, CAST(end_offset AS INT) AS end_offset, sha256(content) AS content_hash
  FROM {name}_texts WHERE NOT {_BLANK.format("content")})"""


def _bm25(k: int, queries: str = "items", name: str = "hits", limit: str = "") -> str:
    return f"""
{name}_words AS (SELECT document_id, chunk_index, content_hash, {_tok("content")} AS w FROM chunks),
{name}_stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}_words),
{name}_tf AS (SELECT document_id, chunk_index, content_hash, dl, term, count(*) AS tf FROM (SELECT document_id, chunk_index, content_hash, len(w) AS dl, unnest(w) AS term FROM {name}_words) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_q AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest({_tok("query")}) AS term FROM {queries}) GROUP BY ALL),
{name}_all AS (
  SELECT query_id, document_id, chunk_index, content_hash,
    round(sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_q JOIN {name}_tf USING (term) JOIN {name}_df USING (term), {name}_stats GROUP BY ALL),
{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_TIES}) AS INT) AS rank FROM {name}_all WHERE score > 0 QUALIFY rank <= {k})"""


_SPANS = """
gold AS (
  SELECT query_id, document_id, instr(content, query) - 1 AS start_offset, instr(content, query) - 1 + length(query) AS end_offset
  FROM items JOIN docs ON contains(content, query)
  WHERE query <> '' AND NOT contains(substring(content, instr(content, query) + 1), query))"""
_GOLD_CHUNKS = "gold_chunks AS (SELECT DISTINCT query_id, c.document_id, c.chunk_index FROM gold g JOIN chunks c ON c.document_id = g.document_id AND c.start_offset < g.end_offset AND g.start_offset < c.end_offset)"


def _metrics(hits: str, gold: str, key: str, stage: str = "") -> str:
    """metrics([stage,] query_id, n_gold, recall_1, recall_5, recall_10, rr, ndcg)."""
    s = f"{stage}, " if stage else ""
    stages = f"(SELECT DISTINCT {stage} FROM {hits}), " if stage else ""
    on = " AND ".join([f"r.{x} = z.{x}" for x in ([stage] if stage else []) + ["query_id"]])
    return f"""
sizes AS (SELECT query_id, count(*) AS n_gold FROM (SELECT DISTINCT query_id, {key} FROM {gold}) GROUP BY query_id),
wanted AS (SELECT * FROM {stages} sizes),
relevant AS (SELECT h.* FROM {hits} h WHERE EXISTS (SELECT 1 FROM {gold} g WHERE g.query_id = h.query_id AND {" AND ".join(f"g.{k.strip()} = h.{k.strip()}" for k in key.split(","))})),
per_query AS (
  SELECT {s}query_id, max(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS r1, max(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS r5, max(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS r10,
    1.0 / min(rank) AS rr, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM relevant GROUP BY ALL),
metrics AS (
  SELECT z.*, CAST(coalesce(r1, 0) AS DOUBLE) AS recall_1, CAST(coalesce(r5, 0) AS DOUBLE) AS recall_5, CAST(coalesce(r10, 0) AS DOUBLE) AS recall_10, CAST(coalesce(rr, 0) AS DOUBLE) AS rr,
    least(1.0, coalesce(dcg, 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, 1 + least(n_gold, 10))])) AS ndcg
  FROM wanted z LEFT JOIN per_query r ON {on})"""


_HITS = "SELECT query_id, rank, document_id AS doc_id, score FROM hits"
_UNIT = "list_cosine_similarity(a.v, b.v)"


def _dense(k: int, where: str = "true", after: str = "true") -> str:
    return f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0 ELSE greatest(0, {_UNIT}) END, 6) AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= {k})
SELECT query_id, rank, vec_id, score FROM r WHERE {after}"""


def _lanes(text: str, dims: int) -> str:
    """Lanes of the test embedder, not normalised."""
    one = f"sha256(encode({text}) || unhex(lpad(hex(i), 8, '0')))"
    return f"flatten([[CAST(('0x' || substring({one}, k * 8 + 1, 8)) AS UBIGINT) / 4294967296.0 * 2.0 - 1.0 FOR k IN range(0, 8)] FOR i IN range(0, {-(-dims // 8)})])"


_RERANK = f"""
overlap AS (
  SELECT h.query_id, h.document_id, d.source,
    (SELECT count(*) FROM (SELECT DISTINCT unnest({_tok("i.query")}) AS t) WHERE t IN (SELECT unnest({_tok("d.content")}))) / greatest(1, len(list_distinct({_tok("i.query")}))) AS ratio
  FROM hits h JOIN docs d USING (document_id) JOIN items i USING (query_id)),
reranked AS (SELECT query_id, document_id, source, round(CASE WHEN ratio * 12 - 6 >= 0 THEN 1 / (1 + exp(-(ratio * 12 - 6))) ELSE exp(ratio * 12 - 6) / (1 + exp(ratio * 12 - 6)) END, 6) AS score FROM overlap),
rerank AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) AS INT) AS rank FROM reranked)"""

_MEANS = f"""
staged AS (SELECT 'bm25' AS stage, query_id, rank, document_id FROM hits UNION ALL SELECT 'rerank', query_id, rank, document_id FROM rerank),
{_metrics("staged", "gold", "document_id", "stage")},
categories AS (SELECT query_id, CASE WHEN count(DISTINCT document_id) > 1 THEN 'ambiguous' ELSE 'normal' END AS category FROM gold GROUP BY query_id),
means AS (
  SELECT stage, category, count(*) AS n_queries, round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg
  FROM metrics JOIN categories USING (query_id) GROUP BY GROUPING SETS ((stage), (stage, category)))"""



def _fp(x: str) -> str:
    return f"sha256(encode({x}) || unhex('00') || encode('{_SETTINGS}') || unhex('00'))"


_EARLIER = """
earlier AS (
  SELECT d.document_id, d.source, CASE WHEN l.quality = 0 THEN 'v1 ' || d.content ELSE d.content END AS content FROM docs d JOIN labels l ON l.doc_id = d.document_id
  UNION ALL SELECT -1 - page_id, 'page://' || page_id, coalesce(html, '') FROM pages)"""
_STORED = f"stored AS (SELECT source, {_fp('content')} AS fingerprint FROM earlier)"
_STATUS = f"""
status AS (
  SELECT d.source, CASE WHEN {_BLANK.format("d.content")} THEN CASE WHEN s.source IS NULL THEN 'blank' ELSE 'emptied' END
    WHEN s.source IS NULL THEN 'new' WHEN s.fingerprint = {_fp("d.content")} THEN 'unchanged' ELSE 'changed' END AS status
  FROM docs d LEFT JOIN stored s USING (source))"""

_QUOTED = r"array_to_string([CASE WHEN x = '' THEN '|' ELSE '| ' || x END FOR x IN string_split({}, chr(10))], chr(10))"
_SAFE = (
    r"replace(replace(regexp_replace(replace(replace({}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g'), "
    r"'<retrieved_context>', '[blocked-retrieved-context-start]'), '</retrieved_context>', '[blocked-retrieved-context-end]')"
)
_URL = "regexp_extract({}, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$', {})"
_NAMES = "[regexp_replace(x, '=.*$', '') FOR x IN string_split({}, '&') IF x <> '']"
_CREDENTIALS = ", ".join(f"'{x}'" for x in CREDENTIAL_PARAMS)

ORACLES: dict[str, str] = {
    "tokenize_counts": f"WITH {_DOCS} SELECT document_id AS doc_id, CAST(len({_tok('content')}) AS INT) AS n_tokens, CAST(len(list_distinct({_tok('content')})) AS INT) AS n_distinct FROM docs",
    "term_df": f"WITH {_DOCS}, t AS (SELECT document_id, unnest({_tok('content')}) AS term FROM docs) SELECT term, count(DISTINCT document_id) AS df, count(*) AS cf FROM t GROUP BY term",
    "length_stats": f"WITH {_DOCS} SELECT count(*) AS n_chunks, CAST(sum(len({_tok('content')})) AS BIGINT) AS total_tokens, round(avg(len({_tok('content')})), 6) AS avg_len FROM docs",
    "bm25_docs": f"WITH {_DOCS}, {_ITEMS}, {_WHOLE}, {_bm25(10)} {_HITS}",
    "bm25_repeated_terms": f"WITH {_DOCS}, {_ITEMS}, twice AS (SELECT query_id, query || ' ' || regexp_extract(query, '^(\\S+)', 1) || ' ' || regexp_extract(query, '^(\\S+)', 1) AS query FROM items), {_WHOLE}, {_bm25(10, 'twice')} {_HITS}",
    "content_hash_dups": f"WITH {_DOCS} SELECT sha256(content) AS content_hash, count(*) AS n, min(document_id) AS first_doc FROM docs GROUP BY 1 HAVING count(*) > 1",
    "fixed_windows": f"WITH {_DOCS}, {_windows()} SELECT document_id AS doc_id, chunk_index, start_offset, end_offset, content_hash FROM chunks",
    "bm25_windows": f"WITH {_DOCS}, {_ITEMS}, {_windows()}, {_bm25(10)} SELECT query_id, rank, document_id AS doc_id, chunk_index, score FROM hits",
    "result_citations": f"WITH {_DOCS}, {_ITEMS}, {_windows()}, {_bm25(5)} SELECT query_id, rank, score, score >= 0.7 AS is_high_confidence, source, start_offset, end_offset, 'text' AS source_class FROM hits JOIN chunks USING (document_id, chunk_index)",
    "snippets": rf"WITH {_DOCS} SELECT document_id AS doc_id, substring(trim(regexp_replace(content, '[\p{{Z}}\x09-\x0d\x1c-\x1f\x{{85}}]+', ' ', 'g')), 1, 160) AS snippet, CAST(length(content) // 4 AS INT) AS tokens FROM docs",
    "dense_topk": _dense(10),
    "dense_threshold": _dense(50, after="score >= 0.5"),
    "dense_label_filter": _dense(10, where="a.label = b.label"),
    "metadata_filter": _dense(10, where="b.label = 3 AND b.vec_id % 2 = 1 AND b.vec_id % 3 <> 0"),
    "hash_embed_docs": f"WITH {_DOCS}, l AS (SELECT document_id, {_lanes('content', 384)} AS v FROM docs), n AS (SELECT document_id, v, sqrt(list_sum([x * x FOR x IN v])) AS norm FROM l) SELECT document_id AS doc_id, CAST(len(v) AS INT) AS dims, "
    + ", ".join(f"round(v[{k + 1}] / norm, 6) AS v{k}" for k in (0, 1, 7, 8, 383)) + " FROM n",
    "rrf_two_lists": f"""WITH {_DOCS}, {_ITEMS}, {_WHOLE}, {_bm25(10)},
      shared AS (SELECT query_id, document_id, chunk_index, content_hash, count(*) AS score FROM hits_q JOIN hits_tf USING (term) GROUP BY ALL),
      second AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_TIES}) AS rank FROM shared QUALIFY rank <= 10),
      fused AS (SELECT query_id, document_id, content_hash, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, document_id, content_hash, rank FROM hits UNION ALL SELECT query_id, document_id, content_hash, rank FROM second) GROUP BY ALL),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content_hash, document_id) AS INT) AS rank FROM fused QUALIFY rank <= 10)
      SELECT query_id, rank, document_id AS doc_id, round(score, 9) AS score FROM r""",
    "hybrid_windows": f"""WITH {_DOCS}, {_ITEMS}, {_windows()}, {_bm25(10)},
      cv AS (SELECT {_TIES}, {_lanes('content', 384)} AS v FROM chunks), qv AS (SELECT query_id, {_lanes('query', 384)} AS v FROM items),
      ds AS (SELECT query_id, {_TIES}, round(greatest(0, list_cosine_similarity(qv.v, cv.v)), 6) AS score FROM qv, cv),
      second AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_TIES}) AS rank FROM ds QUALIFY rank <= 10),
      fused AS (SELECT query_id, {_TIES}, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, {_TIES}, rank FROM hits UNION ALL SELECT query_id, {_TIES}, rank FROM second) GROUP BY ALL),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_TIES}) AS INT) AS rank FROM fused QUALIFY rank <= 10)
      SELECT query_id, rank, document_id AS doc_id, chunk_index, round(score, 9) AS score FROM r""",
    "sigmoid_rerank": f"WITH {_DOCS}, {_ITEMS}, {_WHOLE}, {_bm25(10)}, {_RERANK} SELECT query_id, rank, document_id AS doc_id, score FROM rerank",
    "gold_spans": f"WITH {_DOCS}, {_ITEMS}, {_SPANS} SELECT query_id, document_id AS doc_id, CAST(start_offset AS INT) AS start_offset, CAST(end_offset AS INT) AS end_offset FROM gold",
    "gold_chunks": f"WITH {_DOCS}, {_ITEMS}, {_SPANS}, {_windows()}, {_GOLD_CHUNKS} SELECT query_id, document_id AS doc_id, chunk_index FROM gold_chunks",
    "recall_at_k": f"WITH {_DOCS}, {_ITEMS}, {_SPANS}, {_windows()}, {_GOLD_CHUNKS}, {_bm25(10)}, {_metrics('hits', 'gold_chunks', 'document_id, chunk_index')} SELECT query_id, n_gold, recall_1, recall_5, recall_10 FROM metrics",
    "mrr": f"WITH {_DOCS}, {_ITEMS}, {_SPANS}, {_windows()}, {_GOLD_CHUNKS}, {_bm25(10)}, {_metrics('hits', 'gold_chunks', 'document_id, chunk_index')} SELECT query_id, round(rr, 6) AS rr FROM metrics",
    "ndcg_at_10": f"WITH {_DOCS}, {_ITEMS}, {_SPANS}, {_windows()}, {_GOLD_CHUNKS}, {_bm25(10)}, {_metrics('hits', 'gold_chunks', 'document_id, chunk_index')} SELECT query_id, round(ndcg, 6) AS ndcg FROM metrics",
    "stage_by_category": f"WITH {_DOCS}, {_ITEMS}, {_SPANS}, {_WHOLE}, {_bm25(10)}, {_RERANK}, {_MEANS} SELECT * FROM means",
    "stage_delta": f"""WITH {_DOCS}, {_ITEMS}, {_SPANS}, {_WHOLE}, {_bm25(10)}, {_RERANK}, {_MEANS},
      d AS (SELECT s.stage, round(s.recall_1 - b.recall_1, 6) AS d_recall_1, round(s.recall_5 - b.recall_5, 6) AS d_recall_5, round(s.recall_10 - b.recall_10, 6) AS d_recall_10, round(s.rr - b.rr, 6) AS d_rr, round(s.ndcg - b.ndcg, 6) AS d_ndcg
        FROM means s, means b WHERE s.category IS NULL AND b.category IS NULL AND b.stage = 'bm25' AND s.stage <> 'bm25')
      SELECT *, 'bm25' AS baseline, round(d_recall_1 + d_recall_5 + d_recall_10 + d_rr + d_ndcg, 6) AS net, least(d_recall_1, d_recall_5, d_recall_10, d_rr, d_ndcg) < 0 AS regressed, greatest(d_recall_1, d_recall_5, d_recall_10, d_rr, d_ndcg) > 0 AS improved FROM d""",
    "percentile_nearest_rank": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type",
    "token_overlap": f"WITH {_DOCS}, {_ITEMS}, {_SPANS} SELECT g.query_id, g.document_id AS doc_id, round(len(list_intersect(list_distinct({_tok('d.content')}), list_distinct({_tok('i.query')}))) / len(list_distinct({_tok('d.content')})), 6) AS overlap FROM gold g JOIN docs d USING (document_id) JOIN items i USING (query_id)",
    "abstention": f"""WITH {_DOCS}, {_WHOLE}, items AS (SELECT conv_id || ':' || turn AS query_id, role, coalesce(text, '') AS query FROM conversations), {_bm25(1)}
      SELECT role, count(*) AS n_queries, count(*) FILTER (query_id NOT IN (SELECT query_id FROM hits WHERE score >= 4)) AS n_abstained FROM items GROUP BY role""",
    "rerank_attribution": f"""WITH {_DOCS}, {_ITEMS}, {_SPANS}, {_WHOLE}, {_bm25(10)},
      shared AS (SELECT query_id, document_id, chunk_index, content_hash, count(*) AS score FROM hits_q JOIN hits_tf USING (term) GROUP BY ALL),
      overlap AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_TIES}) AS rank FROM shared QUALIFY rank <= 10),
      logits AS (SELECT query_id, document_id, source, 1000.0 / (length(content) + 1) - 1 AS x FROM overlap JOIN docs USING (document_id)),
      sig AS (SELECT query_id, document_id, source, round(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END, 6) AS score FROM logits),
      rerank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) AS rank FROM sig),
      staged AS (SELECT 'overlap' AS stage, query_id, rank, document_id FROM overlap UNION ALL SELECT 'rerank', query_id, rank, document_id FROM rerank),
      {_metrics("staged", "gold", "document_id", "stage")},
      means AS (SELECT stage, round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg FROM metrics GROUP BY stage),
      d AS (SELECT 'rerank' AS stage, 'overlap' AS baseline, round(s.recall_1 - b.recall_1, 6) AS d_recall_1, round(s.recall_5 - b.recall_5, 6) AS d_recall_5, round(s.recall_10 - b.recall_10, 6) AS d_recall_10, round(s.rr - b.rr, 6) AS d_rr, round(s.ndcg - b.ndcg, 6) AS d_ndcg
        FROM means s, means b WHERE s.stage = 'rerank' AND b.stage = 'overlap')
      SELECT *, round(d_recall_1 + d_recall_5 + d_recall_10 + d_rr + d_ndcg, 6) AS net, least(d_recall_1, d_recall_5, d_recall_10, d_rr, d_ndcg) < 0 AS regressed, greatest(d_recall_1, d_recall_5, d_recall_10, d_rr, d_ndcg) > 0 AS improved FROM d""",
    "changed_sources": f"WITH {_DOCS}, {_EARLIER}, {_STORED}, {_STATUS} SELECT source, status FROM status",
    "pruned_sources": f"WITH {_DOCS}, {_EARLIER}, {_STORED} SELECT source FROM stored WHERE starts_with(source, 'page://') AND source NOT IN (SELECT source FROM docs)",
    "upsert_merge": f"WITH {_DOCS}, {_EARLIER}, {_STORED} SELECT * FROM stored WHERE source NOT IN (SELECT source FROM docs) UNION ALL SELECT source, {_fp('content')} FROM docs",
    "orphan_chunks": f"WITH {_DOCS}, {_windows()} SELECT document_id AS doc_id, count(*) AS n_chunks FROM chunks WHERE document_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "deleted_chunks": f"WITH {_DOCS}, {_windows()} SELECT document_id AS doc_id, count(*) AS n_chunks FROM chunks WHERE document_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1",
    "ingest_report": f"""WITH {_DOCS}, {_EARLIER}, {_STORED}, {_STATUS}, {_windows()}
      SELECT count(*) AS files_seen, count(*) FILTER (status IN ('new', 'changed')) AS documents_indexed, count(*) FILTER (status = 'unchanged') AS documents_skipped, count(*) FILTER (status = 'emptied') AS documents_emptied,
        (SELECT count(*) FROM stored WHERE source NOT IN (SELECT source FROM docs)) AS documents_pruned,
        (SELECT count(*) FROM chunks WHERE source IN (SELECT source FROM status WHERE status IN ('new', 'changed'))) AS chunks_written FROM status""",
    "citation_verdicts": f"""WITH {_DOCS}, {_EARLIER}, {_windows('earlier')}
      SELECT c.source, c.chunk_index, CASE WHEN d.source IS NULL THEN 'unresolvable' WHEN c.end_offset <= length(d.content) AND substring(d.content, c.start_offset + 1, c.end_offset - c.start_offset) = c.content THEN 'verified' ELSE 'drifted' END AS verdict
      FROM chunks c LEFT JOIN docs d USING (source)""",
    "url_refusals": f"""WITH u AS (SELECT page_id, lower({_URL.format('url', 1)}) AS scheme, {_URL.format('url', 2)} AS authority, {_URL.format('url', 4)} AS q FROM pages),
      h AS (SELECT *, lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':.*$', '')) AS host FROM u)
      SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'host' WHEN contains(authority, '@') THEN 'userinfo'
        WHEN len([n FOR n IN {_NAMES.format('q')} IF regexp_replace(lower(n), '[-_]', '', 'g') IN ({_CREDENTIALS})]) > 0 THEN 'credential' ELSE 'none' END AS refusal, host FROM h""",
    "credential_params": f"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'Api-Key=s&page=3&sig=x' AS url FROM pages),
      p AS (SELECT page_id, url, {_NAMES.format(_URL.format('url', 4))} AS names FROM u)
      SELECT page_id, array_to_string([n FOR n IN names IF regexp_replace(lower(n), '[-_]', '', 'g') IN ({_CREDENTIALS})], ',') AS names,
        lower({_URL.format('url', 1)}) || '://' || lower({_URL.format('url', 2)}) || {_URL.format('url', 3)} || '?' || array_to_string([n || '=%2A%2A%2A' FOR n IN names], '&') AS sanitized FROM p""",
    "context_budget": f"""WITH {_DOCS}, {_ITEMS}, {_windows()}, {_bm25(10)},
      t AS (SELECT query_id, rank, CAST(length(content) // 4 AS INT) AS tokens, score FROM hits JOIN chunks USING (document_id, chunk_index)),
      r AS (SELECT query_id, rank, tokens, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM t)
      SELECT * FROM r WHERE running <= 1000""",
    "framed_context": f"""WITH {_DOCS}, {_ITEMS}, {_windows()}, {_bm25(10)},
      b AS (SELECT query_id, rank, array_to_string(['<retrieved_context>', '[retrieval_provenance]', 'trust_level: untrusted_retrieved_data', 'document_id: ' || document_id, 'chunk_id: ' || document_id || ':' || chunk_index, 'source: ' || source,
        '[/retrieval_provenance]', '[retrieved_data]', {_QUOTED.format(_SAFE.format('content'))}, '[/retrieved_data]', '</retrieved_context>'], chr(10)) AS block FROM hits JOIN chunks USING (document_id, chunk_index))
      SELECT query_id, rank, sha256(block) AS block_hash, CAST(length(block) AS INT) AS n_chars FROM b""",
    "pii_counts": f"""WITH {_DOCS} SELECT document_id AS doc_id, CAST(len(regexp_extract_all(content, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]{{2,}}')) AS INT) AS n_email,
      CAST(len(regexp_extract_all(content, '\\+[1-9]\\p{{Nd}}{{7,14}}')) AS INT) AS n_phone_e164,
      CAST(len(regexp_extract_all(content, '(?:(?:25[0-5]|2[0-4]\\p{{Nd}}|1?\\p{{Nd}}?\\p{{Nd}})\\.){{3}}(?:25[0-5]|2[0-4]\\p{{Nd}}|1?\\p{{Nd}}?\\p{{Nd}})')) AS INT) AS n_ipv4,
      CAST(len(regexp_extract_all(content, '[A-Za-z0-9+/]{{32,}}={{0,2}}')) AS INT) AS n_secret_token FROM docs""",
    "marker_parse": """WITH t AS (SELECT conv_id, turn, replace(coalesce(text, ''), '.', '. [2][1]') AS x FROM conversations),
      m AS (SELECT conv_id, turn, [CAST(n AS BIGINT) FOR n IN regexp_extract_all(x, '\\[(\\p{Nd}+)\\]', 1)] AS ns FROM t)
      SELECT conv_id, turn, array_to_string([n FOR n, i IN ns IF list_position(ns, n) = i], ',') AS markers, len([n FOR n IN ns IF n < 1 OR n > 2]) > 0 AS refused FROM m""",
    "verdict_parse": """SELECT doc_id, NOT (quality = 1 AND toxic = 1) AS valid, CASE WHEN NOT (quality = 1 AND toxic = 1) THEN quality = 1 END AS faithful,
      CASE WHEN NOT (quality = 1 AND toxic = 1) THEN CAST(toxic AS INT) END AS n_claims, CASE WHEN NOT (quality = 1 AND toxic = 1) THEN 'doc ' || doc_id END AS reasoning FROM labels""",
    "answer_tallies": """SELECT count(*) AS n, count(*) FILTER (toxic <> 1 AND quality = 1) AS answered, count(*) FILTER (toxic <> 1 AND quality <> 1) AS abstained, count(*) FILTER (toxic = 1) AS rejected,
      count(*) FILTER (quality = 1) AS judged, count(*) FILTER (quality = 1 AND toxic = 0) AS faithful FROM labels""",
    "echo_tallies": """WITH t AS (SELECT lower(coalesce(text, '')) AS x, turn FROM conversations), o AS (SELECT CASE WHEN trim(x) = '' THEN 'abstained' WHEN contains(x, ' of ') THEN 'cited_decoy' WHEN contains(x, ' the ') AND turn % 2 = 1 THEN 'cited_positive' ELSE 'rejected' END AS o FROM t)
      SELECT count(*) AS n, count(*) FILTER (o = 'cited_positive') AS cited_positive, count(*) FILTER (o = 'cited_decoy') AS cited_decoy, count(*) FILTER (o = 'abstained') AS abstained, count(*) FILTER (o = 'rejected') AS rejected FROM o""",
    "corpus_hash": "SELECT sha256(string_agg(lpad(CAST(item_id AS VARCHAR), 12, '0') || chr(0) || coalesce(text, '') || chr(0), '' ORDER BY item_id)) AS corpus_hash, count(*) AS n FROM benchmark",
    "stream_ingest": f"WITH {_DOCS} SELECT source, {_fp('content')} AS fingerprint, CAST(length(content) AS INT) AS n_chars FROM docs WHERE NOT {_BLANK.format('content')}",
}
