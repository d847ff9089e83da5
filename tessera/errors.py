"""Typed errors, told apart by SQLSTATE, and which of them are worth another try."""

from __future__ import annotations

import re
from collections.abc import Callable


class QueryFailure(Exception):
    """What every failure of a statement derives from; ``sql`` describes the statement, ``state`` is its SQLSTATE if there is one."""

    def __init__(self, message: str, sql: str | None = None, state: str | None = None, cause: BaseException | None = None):
        super().__init__(message)
        self.sql, self.state, self.cause = sql, state, cause


class ConstraintViolation(QueryFailure):
    pass


class SyntaxFailure(QueryFailure):
    pass


class DataFailure(QueryFailure):
    pass


class ExecutionFailure(QueryFailure):
    pass


class StatementTimeout(QueryFailure):
    pass


class Retryable(QueryFailure):
    pass


class ConnectionFailure(QueryFailure):
    pass


class DecodingFailure(QueryFailure):
    pass


class EncodingFailure(QueryFailure):
    pass


class ReturnedNothing(QueryFailure):
    pass


class Unsupported(QueryFailure):
    pass


class MissingKey(QueryFailure):
    pass


class InvalidStatement(QueryFailure):
    """The statement has issues that were found while it was put together; nothing ran."""

    def __init__(self, issues: list[str], sql: str | None = None):
        super().__init__("; ".join(issues), sql)
        self.issues = issues


class SchemaMismatch(QueryFailure):
    """All differences between a declaration and a table, at once."""

    def __init__(self, table: str, issues: list):
        super().__init__(f"{table}: " + "; ".join(map(str, issues)))
        self.issues = issues


#: SQLSTATE classes and states of each kind.
RETRY_STATES = ("08", "40001", "40P01")
CLASSES = {"23": ConstraintViolation, "42": SyntaxFailure, "22": DataFailure, "57": StatementTimeout}


def sql_state(error: BaseException) -> str | None:
    """The state an error carries, or the one its message names."""
    found = getattr(error, "getSqlState", lambda: None)() or getattr(error, "state", None)
    if not found and (m := re.search(r"SQLSTATE: (\w{5})", str(error))):
        found = m[1]
    return found


def is_retryable(error: BaseException) -> bool:
    return (sql_state(error) or "").startswith(RETRY_STATES)


def classify(error: BaseException, sql: str | None = None, retryable: Callable[[BaseException], bool] = is_retryable) -> QueryFailure:
    """The typed failure for any error; being retryable comes before all other kinds."""
    state = sql_state(error)
    if retryable(error):
        return Retryable(str(error), sql, state, error)
    if isinstance(error, QueryFailure):
        return error
    kind = CLASSES.get((state or "")[:2])
    if kind is None:
        kind = DataFailure if "MALFORMED_RECORD" in str(error) else ExecutionFailure
    return kind(str(error), sql, state, error)
