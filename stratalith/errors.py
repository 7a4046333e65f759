"""Errors of the engine; each carries a stable code (P25)."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all; ``code`` is stable, the message is not."""

    def __init__(self, message: str, code: str = "ENGINE") -> None:
        super().__init__(message)
        self.code = code


class SchemaError(EngineError):
    """An artifact, policy or description that can't be read."""


class StatementError(EngineError):
    """A statement that isn't one read-only query."""


class GenerationError(EngineError):
    """The model gave nothing usable."""


class ParameterError(EngineError):
    """A parameter or its place in the statement is wrong."""


class ScopeError(EngineError):
    """The tenant scope is missing or wrong."""


class GuardError(EngineError):
    """A statement reads a governed table in a way the policy forbids."""

    def __init__(self, message: str, code: str, findings: list[dict] | None = None) -> None:
        super().__init__(message, code)
        self.findings = findings or []


class ConnectorError(EngineError):
    """A catalog source that can't be used."""


class ConfigError(EngineError):
    """A setting that is missing or wrong."""
