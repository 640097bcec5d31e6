"""Errors with the status codes of the engine's API."""


class EngineError(Exception):
    code = "Internal"


class NotFound(EngineError):
    code = "NotFound"


class AlreadyExists(EngineError):
    code = "AlreadyExists"


class InvalidArgument(EngineError):
    code = "InvalidArgument"


class FailedPrecondition(EngineError):
    code = "FailedPrecondition"


class OutOfRange(EngineError):
    code = "OutOfRange"


class ParseError(EngineError):
    code = "ParseError"

    def __init__(self, message, line=1, column=1):
        super().__init__(f"{message} at line {line}, column {column}")
        self.line, self.column = line, column
