"""Reversible redaction of texts: sequential within a text, so a pandas function for each batch."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.errors import RedactionError
from lexigrid.functions.text import REDACTION_PATTERNS

#: The same patterns for Python, where \d is every decimal digit.
PYTHON_PATTERNS = {k: p.replace(r"\p{Nd}", r"\d") for k, p in REDACTION_PATTERNS.items()}
_TOKEN = re.compile(r"\[([A-Z][A-Z0-9_]*)_(\d+)\]")


class Redactor:
    """Replaces matches by ``[CATEGORY_n]``; one value has one token as long as the instance lives."""

    def __init__(self, patterns: Mapping[str, str] | None = None) -> None:
        self.patterns = {k: re.compile(p) for k, p in (patterns or PYTHON_PATTERNS).items()}
        self.tokens: dict[tuple[str, str], str] = {}
        self.values: dict[str, str] = {}

    def _token(self, category: str, value: str) -> str:
        token = self.tokens.get((category, value))
        if token is None:
            n = 1 + sum(1 for c, _ in self.tokens if c == category)
            token = self.tokens[category, value] = f"[{category}_{n}]"
            self.values[token] = value
        return token

    def redact(self, text: str) -> tuple[str, dict[str, str]]:
        """The text and the tokens in it. The leftmost match wins, then the longest, then the earlier pattern.

        Each pattern keeps its next match at hand; matches that begin inside what was
        already replaced are passed over.
        """
        streams = {c: p.finditer(text) for c, p in self.patterns.items()}
        ahead = {c: m for c, s in streams.items() if (m := next(s, None))}
        out, used, at = [], {}, 0
        while ahead:
            category, match = min(ahead.items(), key=lambda x: (x[1].start(), -x[1].end()))
            if match.start() >= at and match.end() > match.start():
                token = self._token(category, match[0])
                used[token] = match[0]
                out += [text[at : match.start()], token]
                at = match.end()
            if (m := next(streams[category], None)) is None:
                del ahead[category]
            else:
                ahead[category] = m
        return "".join([*out, text[at:]]), used

    def restore(self, text: str) -> str:
        """Put originals back; a token of a known category that was never issued is an error, others stay."""

        def original(m: re.Match[str]) -> str:
            if m[1] not in self.patterns:
                return m[0]
            if m[0] not in self.values:
                raise RedactionError(f"token {m[0]} was never issued")
            return self.values[m[0]]

        return _TOKEN.sub(original, text)


def redacted(text: Column, patterns: Mapping[str, str] | None = None) -> Column:
    """struct<text, mapping>: each row has its own tokens, so the result does not depend on the order of rows."""

    @F.pandas_udf("text string, mapping map<string,string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [(None, {}) if t is None else Redactor(patterns).redact(t) for t in texts]
        return pd.DataFrame({"text": [d[0] for d in done], "mapping": [d[1] for d in done]})

    return run(text)


def restored(text: Column, mapping: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series, mappings: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(texts, mappings, strict=True):
            r = Redactor()
            r.values = dict(m or {})
            out.append(None if t is None else r.restore(t))
        return pd.Series(out)

    return run(text, mapping)
