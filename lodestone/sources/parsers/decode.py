"""Bytes of text files to text."""

from __future__ import annotations

import codecs
import re

from lodestone.sources.parsers.base import ParseError

_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_DECLARED = re.compile(rb"""\s*<\?xml\s[^>]*?\bencoding\s*=\s*["']\s*([^"']+?)\s*["']""", re.I)
_META = re.compile(rb"""<meta\b[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9._:-]+)""", re.I)
_CHINESE = ("cp950", "big5hkscs")
#: Other names of encodings.
ALIASES = {"cp950": "big5", "windows-950": "big5", "csbig5": "big5", "big5-hkscs": "big5", "cn-big5": "big5", "x-x-big5": "big5", "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "utf16": "utf-16le", "utf-16": "utf-16le"}


def encoding_name(label: str) -> str:
    """The usual name of a declared encoding."""
    name = label.strip().lower().replace("_", "-")
    return ALIASES.get(name, name)


def _strict(data: bytes, encoding: str, kind: str) -> str:
    """kind: TEXT or XML, which the error codes begin with."""
    for codec in _CHINESE if encoding == "big5" else (encoding,):
        try:
            return data.decode(codec)
        except LookupError:
            raise ParseError("XML_ENCODING_UNSUPPORTED" if kind == "XML" else "TEXT_DECODE_ERROR", f"unknown encoding {encoding}") from None
        except UnicodeDecodeError:
            continue
    raise ParseError(f"{kind}_DECODE_ERROR", f"not {encoding}")


def _marked(data: bytes, kind: str) -> str | None:
    for mark, encoding in _MARKS:
        if data.startswith(mark):
            return _strict(data[len(mark) :], encoding, kind)
    return None


def _guess(data: bytes, kind: str) -> str:
    """UTF-8, or else Big5, both strictly."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return _strict(data, "big5", kind)


def decode_text(data: bytes) -> str:
    return text if (text := _marked(data, "TEXT")) is not None else _guess(data, "TEXT")


def decode_xml(data: bytes) -> str:
    """A mark comes first, then the shape of the first characters, then the declaration, which is then binding."""
    if (text := _marked(data, "XML")) is not None:
        return text
    if data.startswith(b"<\x00?\x00"):
        return _strict(data, "utf-16-le", "XML")
    if data.startswith(b"\x00<\x00?"):
        return _strict(data, "utf-16-be", "XML")
    declared = _DECLARED.match(data[:1024])
    return _strict(data, encoding_name(declared[1].decode("latin-1")), "XML") if declared else _guess(data, "XML")


def decode_html(data: bytes) -> str:
    """As browsers do it: a mark, then a charset in the first 8 KiB, then UTF-8; bytes that don't fit are replaced."""
    for mark, encoding in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(encoding, "replace")
    found = _META.search(data[:8192])
    try:
        return data.decode(encoding_name(found[1].decode("ascii")) if found else "utf-8", "replace")
    except LookupError:
        raise ParseError("ENCODING_UNSUPPORTED", f"unknown encoding {found[1]!r}") from None
