"""What parsers share."""

from __future__ import annotations

from typing import NamedTuple


class Block(NamedTuple):
    ordinal: int | None
    heading: str | None
    content: str | None
    location_kind: str | None
    location_value: str | None


class ParseError(Exception):
    """A file that can't be parsed, with a code that stays the same over releases."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code
