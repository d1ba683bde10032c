"""Structured errors: a code, the operation, the path and a message."""

from __future__ import annotations

from enum import IntEnum


class ErrorCode(IntEnum):
    OK = 0
    NOT_FOUND = 1
    ALREADY_EXISTS = 2
    INVALID_ARGUMENT = 3
    PERMISSION_DENIED = 4
    FAILED_PRECONDITION = 5
    RESOURCE_EXHAUSTED = 6
    UNAVAILABLE = 7
    INTERNAL_ERROR = 8
    NOT_SUPPORTED = 9
    UNKNOWN = 10


class EngineError(Exception):
    code = ErrorCode.UNKNOWN

    def __init__(self, message: str, op: str = "", path: str = "") -> None:
        super().__init__(": ".join(p for p in (op, path, self.code.name, message) if p))
        self.op, self.path, self.message = op, path, message


class NotFound(EngineError):
    code = ErrorCode.NOT_FOUND


class AlreadyExists(EngineError):
    code = ErrorCode.ALREADY_EXISTS


class InvalidArgument(EngineError, ValueError):
    code = ErrorCode.INVALID_ARGUMENT


class PermissionDenied(EngineError):
    code = ErrorCode.PERMISSION_DENIED


class FailedPrecondition(EngineError):
    code = ErrorCode.FAILED_PRECONDITION


class ResourceExhausted(EngineError):
    code = ErrorCode.RESOURCE_EXHAUSTED


class Unavailable(EngineError):
    code = ErrorCode.UNAVAILABLE


class InternalError(EngineError):
    code = ErrorCode.INTERNAL_ERROR


class NotSupported(EngineError):
    code = ErrorCode.NOT_SUPPORTED


class PositionedError(InvalidArgument):
    """An error at a place of a text: byte offset from 0, line and column from 1."""

    def __init__(self, message: str, text: str, at: int, op: str = "parse") -> None:
        before = text[:at]
        self.offset, self.line = len(before.encode()), before.count("\n") + 1
        self.column = at - (before.rfind("\n") + 1) + 1
        super().__init__(f"{message} (line {self.line}, column {self.column})", op)


class ParseError(PositionedError):
    pass


class AnalysisError(PositionedError):
    pass
