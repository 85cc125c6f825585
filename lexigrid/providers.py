"""Interfaces of models, and deterministic stand-ins. Nothing here opens a connection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexigrid import defaults as D
from lexigrid.errors import ConfigError, ProviderError
from lexigrid.functions.vectors import hash_embedding
from lexigrid.operators.redaction import Redactor


class Embedder(Protocol):
    identity: dict

    def column(self, text: Column) -> Column: ...


class Chat(Protocol):
    cloud: bool

    def complete(self, prompt: str) -> str: ...


class PairScorer(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """The test embedder, without meaning."""

    dims: int = D.HASH_EMBED_DIMS

    @property
    def identity(self) -> dict:
        return {"provider": "hash", "model_name": "sha256-lanes", "dimensions": self.dims}

    def column(self, text: Column) -> Column:
        return hash_embedding(text, self.dims).cast("array<float>")


@dataclass(frozen=True)
class FunctionEmbedder:
    """A Python model: loaded once a task, called a batch at a time, in order; a wrong width is an error."""

    load: Callable[[], Callable[[list[str]], list[list[float]]]]
    identity: dict
    batch: int = D.EMBED_BATCH

    def column(self, text: Column) -> Column:
        load, dims, size = self.load, self.identity["dimensions"], self.batch

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                rows = []
                for at in range(0, len(texts), size):
                    asked = texts.iloc[at : at + size].tolist()
                    got = model(asked)
                    if len(got) != len(asked) or any(len(r) != dims for r in got):
                        raise ProviderError(f"the model's answer is not {len(asked)} vectors of width {dims}")
                    rows += got
                yield pd.Series(rows, index=texts.index)

        return run(text)


def pair_logits(pairs: DataFrame, load: Callable[[], PairScorer], query: str = "query", content: str = "content") -> DataFrame:
    """Add ``logit`` to pairs: the scorer is loaded once a task and gets the texts of one query together."""
    schema = StructType([*pairs.schema.fields, StructField("logit", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for rows in batches:
            out = []
            for q, own in rows.groupby(query, sort=False):
                scores = scorer.score(q, own[content].tolist())
                if len(scores) != len(own):
                    raise ProviderError("a score is missing")
                out.append(own.assign(logit=scores))
            if out:
                yield pd.concat(out)

    return pairs.mapInPandas(run, schema)


@dataclass
class ScriptedChat:
    """Answers in order; what it was asked is kept."""

    answers: list[str]
    cloud: bool = False
    asked: list[str] = field(default_factory=list)

    def complete(self, prompt: str) -> str:
        self.asked.append(prompt)
        if not self.answers:
            raise ProviderError("no answer is left")
        return self.answers.pop(0)


@dataclass
class RedactingChat:
    """Redacts what goes out and restores what comes back; every call has tokens of its own."""

    inner: Chat
    cloud: bool = False

    def complete(self, prompt: str) -> str:
        redactor = Redactor()
        return redactor.restore(self.inner.complete(redactor.redact(prompt)[0]))


def guarded(chat: Chat) -> Chat:
    """A chat in the cloud must be behind redaction."""
    if chat.cloud and not isinstance(chat, RedactingChat):
        raise ConfigError("a chat in the cloud needs a RedactingChat around it")
    return chat
