"""Typed errors with the exit codes of the command line."""

from __future__ import annotations


class EngineError(Exception):
    """code: a stable name; exit_code: of a command that ends with it."""

    exit_code = 1

    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details

    def as_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "details": self.details}


class ConfigError(EngineError):
    exit_code = 2


class DataError(EngineError):
    exit_code = 3


class IntegrityError(EngineError):
    exit_code = 4


class InsufficientEvidence(EngineError):
    exit_code = 5
