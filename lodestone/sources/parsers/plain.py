"""Text files, Markdown and CSV."""

from __future__ import annotations

import re

from lodestone.functions.text import SPACE_CHARS, trim
from lodestone.sources.parsers.decode import decode_text, decode_xml
from lodestone.sources.parsers.base import Block, ParseError

_LINES = re.compile(r"\r\n|\n|\r")
_HEADING = re.compile(rf"#{{1,6}}[{SPACE_CHARS}]+(.+)")


def lines(text: str) -> list[Block]:
    """A block for each line that isn't blank; ordinals count all lines."""
    return [Block(k, None, line, "line", f"第 {k + 1} 行") for k, line in enumerate(_LINES.split(text)) if trim(line)]


def parse_text(data: bytes) -> list[Block]:
    return lines(decode_text(data))


def parse_xml(data: bytes) -> list[Block]:
    return lines(decode_xml(data))


def parse_markdown(data: bytes) -> list[Block]:
    """A block for each section that isn't blank, its heading line included. Any line of one to six # in the first column, white space and a text begins one, inside fences
    too, and keeps its closing #s."""
    sections: list[tuple[int, str | None, list[str]]] = [(0, None, [])]
    for k, line in enumerate(_LINES.split(decode_text(data))):
        found = _HEADING.fullmatch(line)
        if found:
            sections.append((k, trim(found[1]), []))
        sections[-1][2].append(line)
    kept = [(at, heading, trim("\n".join(body))) for at, heading, body in sections]
    return [Block(n, heading, text, "section", f"第 {at + 1} 行") for n, (at, heading, text) in enumerate(x for x in kept if x[2])]


def column_name(index: int) -> str:
    """Spreadsheet name of a column counted from 0."""
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


_FIELD = re.compile(r'"((?:[^"]|"")*)"|([^",\r\n]*)')


def csv_rows(text: str) -> list[list[str]]:
    """Strict: a quote may only open a field, and only a separator or a line end may follow the one that closes it."""
    out: list[list[str]] = []
    at, row = 0, []
    while at < len(text) or row:
        found = _FIELD.match(text, at)
        row.append(found[1].replace('""', '"') if found[1] is not None else found[2])
        at = found.end()
        after = text[at : at + 1]
        if after == ",":
            at += 1
            continue
        if after not in ("", "\r", "\n"):
            raise ParseError("CSV_FORMAT_ERROR", f"a misplaced quote or text after one, in row {len(out) + 1}")
        out.append(row)
        row = []
        at += 2 if text[at : at + 2] == "\r\n" else 1
    return out


def parse_csv(data: bytes) -> list[Block]:
    """A block for each row that isn't blank, cells joined by " | "; located by its first and last filled columns."""
    blocks = []
    for k, row in enumerate(csv_rows(decode_text(data).removeprefix("\ufeff"))):
        filled = [c for c, cell in enumerate(row) if trim(cell)]
        if filled:
            blocks.append(Block(k, None, " | ".join(row), "line", f"第 {k + 1} 列（{column_name(filled[0])}–{column_name(filled[-1])}）"))
    return blocks
