import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrid.errors import RetrievalError
from lexigrid.operators import chunking, dense, evaluation, fusion, lexical
from lexigrid.operators.context import within_budget

TEXTS = ["the cat sat", "the dog sat on the cat", "a bird", "", "the the the", "cat cat dog bird", "the cat sat"]


@pytest.fixture(scope="module")
def chunks(spark):
    docs = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(TEXTS)], "document_id long, source string, content string")
    return chunking.whole_documents(docs)


def bm25(query):
    docs = [t.split() for t in TEXTS]
    avg = sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    out = {}
    for i, d in enumerate(docs):
        score = 0.0
        for w in query.split():
            tf = d.count(w)
            if tf:
                score += math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        if score > 0:
            out[i] = round(score, 6)
    return out


@pytest.mark.parametrize("query", ["cat", "cat cat the", "bird unknown", "the dog"])
def test_bm25_equals_a_full_scan(spark, chunks, query):
    hits = lexical.search_lexical(spark.createDataFrame([(1, query)], "query_id long, query string"), chunks, 50).collect()
    assert {r.document_id: r.score for r in hits} == bm25(query)
    assert [r.document_id for r in sorted(hits, key=lambda r: r["rank"])] == [r.document_id for r in sorted(hits, key=lambda r: (-r.score, r.content_key, r.document_id))]


def test_bm25_edges(spark, chunks):
    q = spark.createDataFrame([(1, "?!"), (2, "nowhere"), (3, "cat")], "query_id long, query string")
    assert {r.query_id for r in lexical.search_lexical(q, chunks, 5).collect()} == {3}
    assert lexical.search_lexical(q, chunks, 5, threshold=99.0).isEmpty()
    with pytest.raises(RetrievalError):
        lexical.search_lexical(q, chunks, 51)


def test_answered_equals_the_search(spark, chunks, monkeypatch):
    """Hits by bounds are those of a search, which is never run over all queries and chunks; repeated chunks are searched."""
    asked = ["cat", "cat cat the", "bird unknown", "the dog", "?!", "nowhere", "", "the", "cat the dog bird"]
    q = spark.createDataFrame(list(enumerate(asked)) + [(0, "the dog")], "query_id long, query string")
    wanted = lambda df: {r.query_id: r.score for r in lexical.search_lexical(q, df, 1).collect()}
    every, twice = wanted(chunks), chunks.union(chunks.limit(1))
    least = every[3]
    again = {i for i, s in wanted(twice).items() if s >= least}
    assert {r.query_id for r in lexical.answered(q, twice, least).collect()} == again
    monkeypatch.setattr(lexical, "search_lexical", None)
    for x in (0.0, least, least + 1e-6):
        assert sorted(r.query_id for r in lexical.answered(q, chunks, x).collect()) == sorted(i for i, s in every.items() if s >= x)
    assert lexical.answered(q, chunks.limit(0), 1.0).isEmpty()


def test_terms_are_counted_within_a_row(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, []), (3, ["z"])], "i int, words array<string>")
    df = lexical.counted(rows, "i")
    assert sorted(map(tuple, df.collect())) == [(1, 5, "", 1), (1, 5, "a", 1), (1, 5, "b", 3), (1, 5, "c", 1), (2, 0, "", 1), (3, 1, "", 1), (3, 1, "z", 1)]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_dense_blocks_equal_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(5)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[7] = 0
    v[9] = v[8]
    rows = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, vector array<float>, label int")
    queries = rows.filter("vec_id < 12").withColumnRenamed("vec_id", "query_id")
    n = np.linalg.norm(v.astype(float), axis=1)
    n[n == 0] = 1
    s = np.round(np.maximum(0, (v.astype(float) / n[:, None]) @ (v.astype(float) / n[:, None]).T), 6)
    for by_label in (False, True):
        got = dense.search_dense(queries, rows, 7, by_label=by_label).collect()
        for q in range(12):
            want = sorted((-s[q, i], i) for i in range(300) if not by_label or i % 3 == q % 3)[:7]
            assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_reciprocal_rank_fusion_worked_case(spark):
    schema = "query_id long, chunk_id string, rank int"
    a = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2), (1, "c3", 3)], schema)
    b = spark.createDataFrame([(1, "c3", 1), (1, "c1", 2), (1, "c4", 3)], schema)
    got = fusion.reciprocal_rank_fusion([a, b], ["chunk_id"], 10).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c1", "c3", "c2", "c4"]
    assert [r.score for r in got] == pytest.approx([1 / 61 + 1 / 62, 1 / 63 + 1 / 61, 1 / 62, 1 / 63], abs=1e-11)
    with pytest.raises(Exception, match="twice"):
        fusion.reciprocal_rank_fusion([a.union(a)], ["chunk_id"], 10).collect()


def test_rerank(spark):
    pairs = spark.createDataFrame([(1, "c1", "s", 0, -8.5), (1, "c2", "s", 1, -2.1), (1, "c3", "s", 2, -11.0)], "query_id long, chunk_id string, source string, start_offset int, logit double")
    got = fusion.rerank(pairs, F.col("logit"), 3, ("source", "start_offset")).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c2", "c1", "c3"] and all(r.score > 0 for r in got)
    with pytest.raises(Exception, match="finite"):
        fusion.rerank(pairs.withColumn("logit", F.lit(float("nan"))), F.col("logit"), 3, ("source",)).collect()


def test_metrics_worked_case(spark):
    hits = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate("abcde")], "query_id long, chunk_id string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "d"), (2, "z")], "query_id long, chunk_id string")
    got = {r.query_id: r for r in evaluation.query_metrics(hits, gold).collect()}
    assert got[1].ndcg == pytest.approx(0.6509209298071326) and got[1].rr == 0.5 and (got[1].recall_1, got[1].recall_5) == (0.0, 1.0)
    assert got[2].ndcg == got[2].rr == got[2].recall_10 == 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 44])
def test_percentile_is_nearest_rank(spark, n):
    values = [float(i * i % 17) + i / 100 for i in range(n)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(*[evaluation.nearest_rank("v", q).alias(f"p{q}".replace(".", "_")) for q in (0.5, 0.95, 0.99)]).first()
    assert tuple(got) == tuple(sorted(values)[max(1, math.ceil(q * n)) - 1] for q in (0.5, 0.95, 0.99))


def test_quotes_must_occur_once(spark):
    docs = spark.createDataFrame([(1, "s", "xx one two three four five yy"), (2, "t", "one two three four five one two three four five"), (3, "u", "aaa")], "document_id long, source string, content string")
    quotes = spark.createDataFrame([(1, "one two three four five"), (2, "e two thr"), (3, "aa"), (4, "")], "query_id long, quote string")
    got = {(r.query_id, r.document_id): (r.start_offset, r.end_offset) for r in evaluation.quote_places(quotes, docs).collect()}
    assert got == {(1, 1): (3, 26), (2, 1): (5, 14)}  # 'aa' in 'aaa' overlaps itself, so it occurs twice


def test_budget_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 5), (1, 2, 0.8, 9), (1, 3, 0.7, 1), (2, 1, 0.1, 99)], "query_id long, rank int, score double, t int")
    assert [(r.query_id, r["rank"]) for r in within_budget(hits, F.col("t"), 10).collect()] == [(1, 1)]
