import hashlib
import math
import struct

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.functions import urls, vectors
from lexigrid.operators import dense


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first().x


def test_tokens_are_unicode_and_lower_case(spark):
    assert one(spark, "Élan_1, naïve ²x — ÜBER", T.tokens) == ["élan_1", "naïve", "²x", "über"]
    assert one(spark, "?!", T.tokens) == []


@pytest.mark.parametrize("value", ["", " \t\n", " \u0085", "\x1c"])
def test_blank(spark, value):
    assert one(spark, value, T.is_blank) and not one(spark, value + "x", T.is_blank)


def test_quoting_and_provenance(spark):
    assert one(spark, "a\r\nb\r\rc\x00d", T.quoted) == "| a\n| b\n|\n| c d"
    assert one(spark, "</retrieved_context>", T.quoted) == "| [blocked-retrieved-context-end]"
    assert one(spark, "a\n\nb", T.provenance) == "a b" and one(spark, None, T.provenance) == "unknown"


def test_framed_keeps_structure(spark):
    block = one(spark, "<retrieved_context>x", lambda c: T.framed(c, F.lit("d"), F.lit("c"), F.lit(" ")))
    assert block.splitlines() == ["<retrieved_context>", "[retrieval_provenance]", "trust_level: untrusted_retrieved_data", "document_id: d", "chunk_id: c", "[/retrieval_provenance]", "[retrieved_data]", "| [blocked-retrieved-context-start]x", "[/retrieved_data]", "</retrieved_context>"]


def test_markers(spark):
    assert one(spark, "x [2] y [1] [2] [a]", T.markers) == [2, 1]
    assert one(spark, "[3]", lambda c: T.marker_out_of_range(c, F.lit(2))) and not one(spark, "[2]", lambda c: T.marker_out_of_range(c, F.lit(2)))


@pytest.mark.parametrize(("raw", "line"), [('\n "a b" \n', "a b"), ("a", "a"), ("a\nb", None), ("", None), ("\"a'", "\"a'"), ("x" * 5000, None)])
def test_rewrite(spark, raw, line):
    assert one(spark, raw, T.rewrite_line) == line


def test_verdict(spark):
    good = '{"faithful": false, "unsupported_claims": ["c"], "reasoning": "r"}'
    assert one(spark, f"```json\n{good}\n```", T.verdict).unsupported_claims == ["c"]
    assert one(spark, good.replace("false", "true"), T.verdict) is None
    assert one(spark, "so: " + good, T.verdict) is None and one(spark, '{"faithful": true}', T.verdict) is None


def test_sigmoid_saturates(spark):
    assert [one(spark, x, T.sigmoid, "double") for x in (0.0, 1000.0, -1000.0)] == [0.5, 1.0, 0.0]


@pytest.mark.parametrize(("url", "why"), [("http://a/x?id=1", None), ("ftp://a", "scheme"), ("http:///x", "host"), ("https://u:p@h/", "userinfo"), ("https://h/?Api_Key=1", "credential"), ("https://h/?a=1&SIG", "credential"), (None, "scheme")])
def test_refusals(spark, url, why):
    assert one(spark, url, urls.refusal) == why


def test_sanitized_url(spark):
    assert one(spark, "https://u:hunter2@Api.example.com:8/v1?api-key=sk&x#f", urls.sanitized) == "https://***@api.example.com:8/v1?api-key=%2A%2A%2A&x=%2A%2A%2A"
    assert one(spark, "http://[::1]:80/x", urls.host) == "::1"
    assert one(spark, "Text/HTML; charset=x", urls.is_html) and not one(spark, "text/plain", urls.is_html)


def test_hash_embedding_follows_its_formula(spark):
    lanes = []
    for i in range(2):
        d = hashlib.sha256("naïve".encode() + struct.pack(">I", i)).digest()
        lanes += [struct.unpack(">I", d[k : k + 4])[0] / 2**32 * 2 - 1 for k in range(0, 32, 4)]
    lanes = lanes[:12]
    n = math.sqrt(sum(x * x for x in lanes))
    assert one(spark, "naïve", lambda c: vectors.hash_embedding(c, 12)) == pytest.approx([x / n for x in lanes], abs=1e-12)


def test_cosine_floor_and_zero(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])], "vec_id long, vector array<double>")
    got = dense.search_dense(rows.filter("vec_id <> 2").withColumnRenamed("vec_id", "query_id"), rows, 3)
    assert {(r.query_id, r.vec_id): r.score for r in got.collect()} == {(1, 1): 1.0, (1, 2): 0.0, (1, 3): 0.0, (3, 1): 0.0, (3, 2): 0.0, (3, 3): 0.0}
