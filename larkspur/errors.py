"""Errors with a stable code, an HTTP status and a JSON form."""

from __future__ import annotations

import re

STATUS = {
    "bad_request": 400,
    "unauthorized": 401,
    "forbidden": 403,
    "not_found": 404,
    "method_not_allowed": 405,
    "not_acceptable": 406,
    "conflict": 409,
    "range": 416,
    "internal": 500,
}


class ApiError(Exception):
    """kind is a key of STATUS; code names the case."""

    def __init__(self, kind: str, code: str, message: str, details: str | None = None, hint: str | None = None):
        super().__init__(message)
        self.kind, self.code, self.message, self.details, self.hint = kind, code, message, details, hint

    @property
    def status(self) -> int:
        return STATUS[self.kind]

    def to_dict(self, debug: bool = True) -> dict:
        """Internal errors keep their details to themselves unless debugging."""
        if self.kind == "internal" and not debug:
            return {"code": self.code, "message": "An internal error occurred", "details": None, "hint": None}
        return {"code": self.code, "message": self.message, "details": self.details, "hint": self.hint}


def bad_request(message: str, **kw) -> ApiError:
    return ApiError("bad_request", "invalid_request", message, **kw)


def unknown_table(name: str) -> ApiError:
    return ApiError("not_found", "table_not_found", f"No table {name} is exposed")


def unknown_column(table: str, name: str) -> ApiError:
    return ApiError("not_found", "column_not_found", f"Table {table} has no column {name}")


def unknown_relationship(table: str, name: str) -> ApiError:
    return ApiError("bad_request", "relationship_not_found", f"No relationship leads from {table} to {name}")


_SQLSTATE = (("22", "bad_request", "invalid_value"), ("23", "conflict", "constraint"), ("42501", "forbidden", "insufficient_privilege"), ("42", "bad_request", "invalid_request"))


def from_spark(error: Exception) -> ApiError:
    """A Spark error by the class of its SQLSTATE: 22 bad values, 23 constraints, 42 bad requests."""
    state = ""
    try:
        state = error.getSqlState() or ""  # type: ignore[attr-defined]
    except Exception:
        if m := re.search(r"SQLSTATE: (\w{5})", str(error)):
            state = m[1]
    for start, kind, code in _SQLSTATE:
        if state.startswith(start):
            return ApiError(kind, code, str(error).splitlines()[0], details=state)
    return ApiError("internal", "internal", str(error).splitlines()[0] if str(error) else type(error).__name__)
