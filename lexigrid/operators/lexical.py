"""The lexical index and Okapi BM25 for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid import defaults as D
from lexigrid.errors import RetrievalError
from lexigrid.functions.text import tokens
from lexigrid.operators.joins import BROADCAST_ROWS, few, hinted
from lexigrid.shared import kept

#: What identifies a chunk, and the order of hits with equal scores: content first, then position, so that no random id decides.
KEY = ("document_id", "chunk_index")
TIES = ("content_key", *KEY)
#: The term of a posting that every chunk has, with the chunk's length; no token is empty.
ALL = ""
#: Scores are compared as they are published, so that the order of a sum never shows.
DECIMALS = 6


def _words(chunks: DataFrame) -> DataFrame:
    return chunks.select(*TIES, tokens(F.col("content")).alias("words"))


def term_counts(chunks: DataFrame) -> DataFrame:
    """(term, df, cf): distinct terms and all tokens of a row go through one aggregation, combined before its only shuffle."""
    each = chunks.select(tokens(F.col("content")).alias("words")).select(F.explode(F.array(F.struct(F.array_distinct("words").alias("w"), F.lit(1).alias("d")), F.struct(F.col("words").alias("w"), F.lit(0).alias("d")))).alias("x"))
    return each.select("x.d", F.explode("x.w").alias("term")).groupBy("term").agg(F.sum("d").alias("df"), F.sum(1 - F.col("d")).alias("cf"))


def length_stats(chunks: DataFrame) -> DataFrame:
    """Chunks without tokens count in both figures."""
    return chunks.select(F.size(tokens(F.col("content"))).alias("dl")).agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"), F.avg("dl").alias("avg_len"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight): a term that a query repeats counts as often."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))


def _wanted(queries: DataFrame) -> DataFrame:
    """Terms of the queries, and ALL."""
    return queries.select(F.explode(F.concat(F.array(F.lit(ALL)), tokens(F.col("query")))).alias("term")).distinct()


def build_postings(chunks: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Postings (term, chunk, dl, tf) of all chunks; ``dl`` is the chunk's number of tokens. Each text is tokenised once.

    With ``queries`` only their terms are kept, and no other token is shuffled. Rows
    are dealt by chunk, so that whatever is summed for a chunk later needs no shuffle.
    """
    each = _words(chunks).select(*TIES, F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit(ALL)), "words")).alias("term"))
    if queries is not None:
        each = each.join(hinted(_wanted(queries), few(queries)), "term", "left_semi")
    return each.repartition(*KEY).groupBy(*TIES, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def stored_postings(chunks: DataFrame) -> DataFrame:
    """Postings as a collection keeps them, of chunks that occur once: those of a chunk lie together, so its key takes hardly any room. Nothing is shuffled or sorted."""
    return counted(_words(chunks), *TIES).select(*TIES, "dl", "term", "tf")


def of_queries(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """The stored postings that a batch of queries needs, dealt by chunk."""
    return postings.join(hinted(_wanted(queries), few(queries)), "term", "left_semi").repartition(*KEY)


def counted(chunks: DataFrame, *columns: str) -> DataFrame:
    """(columns, dl, term, tf): distinct terms of each row of ``words``, and ALL. They are counted within the row, so no token is shuffled."""
    # the empty term comes first, so the sequence is never empty; a run of equal words begins where a word differs from the one before
    begins = F.filter(F.sequence(F.lit(0), F.col("dl")), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    runs = F.transform("begins", lambda i, k: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("begins", k + 1), F.col("dl") + 1) - i).cast("long").alias("tf")))
    each = chunks.select(*columns, F.size("words").alias("dl"), F.concat(F.array(F.lit(ALL)), F.sort_array("words")).alias("w")).withColumn("begins", begins)
    return each.select(*columns, "dl", F.explode(runs).alias("x")).select(*columns, "dl", "x.*")


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + D.IDF_SHIFT)


def term_weights(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, term, w, avg_len): idf times the term's number in the query. The window holds one row a term of the queries."""
    whole = Window.partitionBy()
    per_term = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("length"))
    known = per_term.withColumn("n", F.max(F.when(F.col("term") == ALL, F.col("df"))).over(whole)).withColumn("total", F.max(F.when(F.col("term") == ALL, F.col("length"))).over(whole))
    weighted = query_terms(queries).join(hinted(known, few(queries)), "term")
    return weighted.select("query_id", "term", (F.col("weight") * idf(F.col("n"), F.col("df"))).alias("w"), (F.col("total") / F.col("n")).alias("avg_len"))


def bm25_scores(queries: DataFrame, postings: DataFrame, k1: float = D.BM25_K1, b: float = D.BM25_B) -> DataFrame:
    """(query_id, chunk, score) of all chunks that share a term with a query and score above 0.

    ``postings`` (those of the queries' terms) feed both the document frequencies
    and the sums from one exchange, and the sums stay in its partitions.
    """
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("w") * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / F.col("avg_len")))
    joined = postings.join(hinted(term_weights(queries, postings), few(queries)), "term")
    return joined.groupBy("query_id", *TIES).agg(F.round(F.sum(part), DECIMALS).alias("score")).filter("score > 0")


def top_k(scored: DataFrame, k: int, ties: tuple[str, ...] = TIES) -> DataFrame:
    """The k best of each query with their rank; Spark keeps k rows a query and partition before the shuffle."""
    if not 1 <= k <= D.MAX_TOP_K:
        raise RetrievalError(f"top_k must be 1 to {D.MAX_TOP_K}, not {k}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_lexical(queries: DataFrame, chunks: DataFrame | None, k: int = D.TOP_K, threshold: float | None = None, postings: DataFrame | None = None) -> DataFrame:
    """BM25 hits of a batch of queries (query_id, query) over chunks, or over stored postings of them."""
    held = build_postings(chunks, queries) if postings is None else of_queries(postings, queries)
    hits = top_k(bm25_scores(queries, held), k)
    return hits if threshold is None else hits.filter(F.col("score") >= threshold)


def answered(queries: DataFrame, chunks: DataFrame, threshold: float) -> DataFrame:
    """(query_id) of the queries that have a hit of ``threshold`` or more over ``chunks``, as ``search_lexical`` scores it.

    For a large batch of queries: whether there is a hit shows mostly without scoring a
    chunk. All parts of a score are positive, so the best part that one term has in any
    chunk is a score that some chunk reaches, and the sum of the best parts of all terms
    is one that no chunk exceeds. Queries with the threshold between both are scored on
    the best chunk of each of their terms, and those that are still open on all chunks.
    The statistics are one narrow row a term and frequency.
    """
    if not chunks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # counts within a row would not be those of a chunk
        return search_lexical(queries, chunks, 1, threshold=threshold).select("query_id")
    least = max(threshold, 10.0**-DECIMALS)  # scores that are published as 0 are no hits
    words = chunks.select(*KEY, tokens(F.col("content")).alias("words"))
    stats = kept(counted(words).groupBy("term", "tf").agg(F.count(F.lit(1)).alias("n"), F.min("dl").alias("dl"), F.sum("dl").alias("length")), "terms")
    whole = stats.filter(F.col("term") == ALL).first()  # one row, as ALL stands once in every chunk
    if whole is None or not whole.length:
        return queries.select("query_id").limit(0)
    tf = F.col("tf")
    part = (tf * (D.BM25_K1 + 1) / (tf + D.BM25_K1 * (1 - D.BM25_B + D.BM25_B * F.col("dl") / (whole.length / whole.n)))).alias("part")
    best = stats.filter(F.col("term") != ALL).groupBy("term").agg(idf(F.lit(whole.n), F.sum("n")).alias("idf"), F.max(part).alias("best"))
    asked = counted(queries.select("query_id", tokens(F.col("query")).alias("words")), "query_id").join(best, "term").select("query_id", "term", (tf * F.col("idf")).alias("w"), "best")
    bounds = asked.groupBy("query_id").agg(F.max(F.col("w") * F.col("best")).alias("reached"), F.sum(F.col("w") * F.col("best")).alias("most"))
    bounds = kept(bounds.filter(F.col("most") >= least - 10.0**-DECIMALS), "bounds")
    sure, open_ = bounds.filter(F.col("reached") >= least).select("query_id"), bounds.filter(F.col("reached") < least).select("query_id")
    n = open_.count()
    if not n:
        return sure
    small = n <= BROADCAST_ROWS // 20  # with their terms
    weights = kept(asked.join(hinted(open_, small), "query_id", "left_semi").select("query_id", "term", "w"), "weights")
    postings = kept(counted(words, *KEY).join(hinted(weights.select("term").distinct(), small), "term", "left_semi").select(*KEY, "term", part), "postings")

    def reaching(weights: DataFrame, postings: DataFrame) -> DataFrame:
        scores = postings.join(hinted(weights, small), "term").groupBy("query_id", *KEY).agg(F.round(F.sum(F.col("w") * F.col("part")), DECIMALS).alias("score"))
        return scores.filter(F.col("score") >= least).select("query_id").distinct()

    first = postings.groupBy("term").agg(F.max_by(F.struct(*KEY), "part").alias("at")).select("at.*").distinct()
    found = kept(reaching(weights, postings.join(hinted(first, small), list(KEY), "left_semi")), "found")
    return sure.union(found).union(reaching(weights.join(hinted(found, small), "query_id", "left_anti"), postings))
