"""Typed errors. Every refusal is one of these; nothing is silently coerced."""


class LexigridError(Exception):
    """Base of all errors of this library."""


class ConfigError(LexigridError):
    """A setting is out of its range or unknown."""


class IngestError(LexigridError):
    """A source cannot be loaded, or a write would leave a collection inconsistent."""


class IdentityError(IngestError):
    """Vectors of another embedding model than the collection's."""


class RetrievalError(LexigridError):
    """A query is invalid, or a hit has no provenance."""


class EvaluationError(LexigridError):
    """Judgments or runs break a rule of the evaluation."""


class ProviderError(LexigridError):
    """A model's answer is malformed."""


class RedactionError(LexigridError):
    """A token of a known category was never issued."""
