"""What a query parser can object to."""

from __future__ import annotations

from enum import Enum


class Fault(Enum):
    EMPTY = "the query is empty"
    UNBALANCED = "parentheses don't match"
    MISSING_OPERAND = "an operator lacks an operand"
    UNEXPECTED = "a symbol stands where none can"
    QUOTE = "a quoted phrase isn't closed"
    PATH = "a path isn't well formed"
    ABOUT = "about() isn't well formed"
    TOO_DEEP = "parentheses are nested too deeply"
    TOO_LONG = "the query has too many terms"


class QueryError(ValueError):
    def __init__(self, fault: Fault, at: int | None = None):
        super().__init__(fault.value + ("" if at is None else f" (at {at})"))
        self.fault = fault
