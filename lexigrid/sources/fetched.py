"""Documents from web responses that were fetched before: this library opens no connection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid import defaults as D
from lexigrid.functions import urls
from lexigrid.functions.text import is_blank, newlines
from lexigrid.operators.html_text import html_text

#: Charsets that are decoded; others are refused, not guessed.
CHARSETS = ("utf-8", "utf8", "us-ascii", "ascii", "iso-8859-1", "latin-1", "utf-16")


def load_fetched(responses: DataFrame) -> DataFrame:
    """Documents of ``files.SCHEMA`` from (url, content_type, body). Their class is ``snapshot``: citations are checked against the text stored here.

    A URL with userinfo or a credential, a body over MAX_URL_BYTES, a content type that is
    neither HTML nor text, an unknown charset or bytes that are not valid in it stop the
    job, with the URL in its safe form. A blank text gives no document.
    """
    said = lambda what: F.raise_error(F.concat(urls.sanitized(F.col("url")), F.lit(": "), what)).cast("string")
    kind = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))))
    named = F.lower(F.regexp_extract(F.coalesce("content_type", F.lit("")), r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9._-]+)", 1))
    charset = F.when(named == "", "utf-8").otherwise(named)
    is_text = urls.is_html(F.col("content_type")) | kind.startswith("text/")
    utf8 = charset.isin("utf-8", "utf8", "us-ascii", "ascii")
    decoded = (
        F.when(urls.refusal(F.col("url")).isNotNull(), said(urls.refusal(F.col("url"))))
        .when(F.octet_length("body") > D.MAX_URL_BYTES, said(F.lit(f"over {D.MAX_URL_BYTES} bytes")))
        .when(~is_text, said(F.lit("neither HTML nor text")))
        .when(~charset.isin(*CHARSETS), said(F.concat(F.lit("charset "), charset)))
        .when(utf8 & ~F.is_valid_utf8(F.col("body").cast("string")), said(F.lit("not UTF-8")))
        .when(utf8, F.col("body").cast("string"))
        .when(charset == "utf-16", F.decode("body", "UTF-16"))
        .otherwise(F.decode("body", "ISO-8859-1"))
    )
    read = responses.select("url", "content_type", decoded.alias("raw"))
    text = F.when(urls.is_html(F.col("content_type")), html_text(F.col("raw"))).otherwise(F.col("raw"))
    meta = F.create_map(F.lit("content_type"), F.coalesce("content_type", F.lit("")))
    docs = read.select(F.sha2(F.col("url").cast("binary"), 256).alias("document_id"), F.col("url").alias("source"), newlines(text).alias("content"), F.lit("snapshot").alias("source_class"), F.lit(None).cast("string").alias("extractor"), meta.alias("metadata"))
    return docs.filter(~is_blank(F.col("content")))
