"""Text expressions: all of them JVM-side, none needs Python on an executor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid import defaults as D

#: Unicode letters, digits and the underscore (Java's \w is ASCII only).
TOKEN = r"[\p{L}\p{N}_]+"
#: What Python's str.strip() takes for white space.
WHITE = r"[\p{Z}\x09-\x0d\x1c-\x1f\x85]"
BLANK = rf"^{WHITE}*$"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: The envelope around retrieved text, its lines, and what its tags become inside it.
OPEN, CLOSE = "<retrieved_context>", "</retrieved_context>"
BLOCKED = {OPEN: "[blocked-retrieved-context-start]", CLOSE: "[blocked-retrieved-context-end]"}
PROVENANCE, PROVENANCE_END = "[retrieval_provenance]", "[/retrieval_provenance]"
DATA, DATA_END = "[retrieved_data]", "[/retrieved_data]"
TRUST = "trust_level: untrusted_retrieved_data"
DOCUMENT_LINE, CHUNK_LINE, SCORE_LINE, SOURCE_LINE = "document_id: ", "chunk_id: ", "retrieval_score: ", "source: "


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def is_blank(text: Column) -> Column:
    return text.rlike(BLANK)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def newlines(text: Column) -> Column:
    """CRLF and CR as LF, as files are read."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def snippet(text: Column, chars: int = D.SNIPPET_CHARS) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, f"{WHITE}+", " ")), 1, chars)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / D.CHARS_PER_TOKEN).cast("int")


def _safe(text: Column) -> Column:
    out = F.regexp_replace(newlines(text), CONTROL, " ")
    for tag, instead in BLOCKED.items():
        out = F.replace(out, F.lit(tag), F.lit(instead))
    return out


def quoted(text: Column) -> Column:
    """Each line behind a bar, wrapper tags and control characters neutralised."""
    lines = F.split(_safe(text), "\n", -1)
    return F.array_join(F.transform(lines, lambda x: F.when(x == "", F.lit("|")).otherwise(F.concat(F.lit("| "), x))), "\n")


def provenance(value: Column) -> Column:
    """One safe line; ``unknown`` for nothing."""
    parts = F.filter(F.split(_safe(F.coalesce(value.cast("string"), F.lit(""))), "\n", -1), lambda x: x != "")
    line = strip(F.array_join(parts, " "))
    return F.when(line == "", F.lit("unknown")).otherwise(line)


def framed(content: Column, document_id: Column, chunk_id: Column, source: Column | None = None, score: Column | None = None) -> Column:
    """The envelope of untrusted text. ``score`` is text already: decimals are the caller's business."""
    lines = [F.lit(TRUST), F.concat(F.lit(DOCUMENT_LINE), provenance(document_id)), F.concat(F.lit(CHUNK_LINE), provenance(chunk_id))]
    if score is not None:
        lines.append(F.concat(F.lit(SCORE_LINE), score))
    if source is not None:
        lines.append(F.when(source.isNotNull() & ~is_blank(source), F.concat(F.lit(SOURCE_LINE), provenance(source))))
    return F.concat_ws("\n", F.lit(OPEN), F.lit(PROVENANCE), *lines, F.lit(PROVENANCE_END), F.lit(DATA), quoted(content), F.lit(DATA_END), F.lit(CLOSE))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def markers(text: Column) -> Column:
    """Numbers of all ``[n]`` in a text, each once, in the order of their first appearance."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\p{Nd}+)\]"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.array_distinct(found)


def marker_out_of_range(text: Column, sources: Column) -> Column:
    """Whether a marker names none of the numbered sources."""
    return F.exists(markers(text), lambda n: (n < 1) | (n > sources))


def numbered_sources(contents: Column) -> Column:
    """``[i] text`` for an array of texts, with a blank line between."""
    return F.array_join(F.transform(contents, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), quoted(x))), "\n\n")


def rewrite_line(completion: Column) -> Column:
    """The one line of a query rewrite without a layer of quotes; null if there is not exactly one, or it is too long."""
    lines = F.filter(F.transform(F.split(newlines(completion), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    line = F.get(lines, F.lit(0))
    same = (F.length(line) >= 2) & (F.substring(line, 1, 1) == F.substring(line, -1, 1)) & F.substring(line, 1, 1).isin('"', "'")
    bare = F.when(same, F.trim(F.substring(line, F.lit(2), F.length(line) - 2))).otherwise(line)
    return F.when((F.size(lines) == 1) & (F.length(bare) <= D.MAX_QUERY_CHARS) & (bare != ""), bare)


VERDICT = "faithful boolean, unsupported_claims array<string>, reasoning string"


def verdict(completion: Column) -> Column:
    """The judge's verdict; null if it is malformed, or faithful in spite of unsupported claims.

    One code fence around the whole answer is taken off; nothing else is.
    """
    bare = F.trim(completion)
    body = F.regexp_extract(bare, r"(?s)^```[A-Za-z0-9_-]*\s*\n(.*?)\n?```$", 1)
    read = F.from_json(F.when(body != "", F.trim(body)).otherwise(bare), VERDICT)
    whole = read["faithful"].isNotNull() & read["unsupported_claims"].isNotNull() & read["reasoning"].isNotNull()
    return F.when(whole & ~(read["faithful"] & (F.size(read["unsupported_claims"]) > 0)), read)


#: Default redaction patterns, in order of precedence.
REDACTION_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}",
    "PHONE_E164": r"\+[1-9]\p{Nd}{7,14}",
    "PHONE_US": r"(?<!\p{Nd})(?:\(\p{Nd}{3}\)[ .-]?|\p{Nd}{3}[ .-])\p{Nd}{3}[ .-]\p{Nd}{4}(?!\p{Nd})",
    "IPV4": r"(?:(?:25[0-5]|2[0-4]\p{Nd}|1?\p{Nd}?\p{Nd})\.){3}(?:25[0-5]|2[0-4]\p{Nd}|1?\p{Nd}?\p{Nd})",
    "SECRET_TOKEN": r"[A-Za-z0-9+/]{32,}={0,2}",
}


def pattern_count(text: Column, category: str) -> Column:
    return F.regexp_count(text, F.lit(REDACTION_PATTERNS[category]))
