import pytest
from pyspark.sql import functions as F

from lexigrid.errors import ConfigError, RedactionError
from lexigrid.operators.citations import verify
from lexigrid.operators.html_text import text_of
from lexigrid.operators.redaction import Redactor, redacted, restored
from lexigrid.providers import RedactingChat, ScriptedChat, guarded


def test_leftmost_longest():
    assert Redactor({"SHORT": "aaa", "LONG": "aaaaa"}).redact("aaaaaa")[0] == "[LONG_1]a"
    assert Redactor({"A": "ab", "B": "ab"}).redact("abab")[0] == "[A_1][A_1]"
    assert Redactor({"A": "bcd", "B": "ab"}).redact("abcd bcd")[0] == "[B_1]cd [A_1]"


def test_one_value_one_token():
    r = Redactor()
    first, _ = r.redact("a@b.com x c@d.org a@b.com")
    second, _ = r.redact("c@d.org")
    assert first == "[EMAIL_1] x [EMAIL_2] [EMAIL_1]" and second == "[EMAIL_2]"
    assert r.restore("[EMAIL_2] [OTHER_9]") == "c@d.org [OTHER_9]"
    with pytest.raises(RedactionError):
        r.restore("[EMAIL_7]")


def test_redaction_round_trip_in_spark(spark):
    df = spark.createDataFrame([("mail a@b.com or (555) 123-4567, 10.0.0.1",), (None,), ("",)], "t string")
    got = df.select(redacted(F.col("t")).alias("r"), "t").select("t", "r.text", restored(F.col("r.text"), F.col("r.mapping")).alias("back")).collect()
    assert [r.text for r in got] == ["mail [EMAIL_1] or [PHONE_US_1], [IPV4_1]", None, ""] and all(r.back == r.t for r in got)


def test_chats_in_the_cloud_need_redaction():
    inner = ScriptedChat(["hello [EMAIL_1]"], cloud=True)
    with pytest.raises(ConfigError):
        guarded(inner)
    assert guarded(RedactingChat(inner)).complete("from a@b.com") == "hello a@b.com" and inner.asked == ["from [EMAIL_1]"]


def test_html():
    assert text_of("<!doctype html><title>T</title><script>x<b></script><p>a &amp; b<!-- no --><i> c </i></p>") == "T a & b c"
    assert text_of(None) == ""


def test_verdicts(spark):
    cited = spark.createDataFrame(
        [("a", "text", None, 0, 3, "abc"), ("a", "text", None, 1, 3, "xx"), ("a", "text", None, 0, 9, "abc"), ("gone", "text", None, 0, 1, "x"), ("a", "extracted", "old/1", 0, 3, "abc"), ("a", "extracted", "now/1", 0, 3, "abc")],
        "source string, source_class string, extractor string, start_offset int, end_offset int, expected string",
    )
    got = verify(cited, spark.createDataFrame([("a", "abcd")], "source string, content string"), ("now/1",)).collect()
    key = {(r.source, r.extractor, r.start_offset, r.end_offset): r.verdict for r in got}
    assert key == {("a", None, 0, 3): "verified", ("a", None, 1, 3): "drifted", ("a", None, 0, 9): "drifted", ("gone", None, 0, 1): "unresolvable", ("a", "old/1", 0, 3): "unresolvable", ("a", "now/1", 0, 3): "verified"}
