"""Errors of the engine, each with the details of where it arose."""

from __future__ import annotations

from contextlib import contextmanager


class EngineError(Exception):
    """Base of all: a message and named details."""

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, details

    def __str__(self) -> str:
        told = ", ".join(f"{k}={v!r}" for k, v in sorted(self.details.items()))
        return f"{self.message} ({told})" if told else self.message


class ConfigError(EngineError):
    """Settings that cannot be used."""


class DataError(EngineError):
    """Input that breaks a rule: a missing record, a wrong version, an audit that fails."""


class ModelError(EngineError):
    """A model call that gave no answer."""


class ParseError(EngineError):
    """An answer that cannot be read."""


class EvaluationError(EngineError):
    """A result that cannot be computed."""


@contextmanager
def error_context(kind: type[EngineError], message: str, **details):
    """Any error inside comes out as ``kind`` with these details; errors of the engine keep theirs and gain these."""
    try:
        yield
    except EngineError as e:
        e.details = {**details, **e.details}
        raise
    except Exception as e:
        raise kind(f"{message}: {e}", **details) from e
