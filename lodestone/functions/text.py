"""Normalisation, query terms, white space and display of text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space.
SPACE_CHARS = "\t\n\x0b\x0c\r                  　﻿"
SPACES = re.compile(f"[{SPACE_CHARS}]+")


def normalize(text: str) -> str:
    """The form in which texts are compared: compatibility composition, then lower case, whatever the locale."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def norm(text: Column) -> Column:
    """Column form of normalize().

    ASCII stays in the JVM. Other rows go through Arrow; the function is fed nulls for ASCII rows, as Spark evaluates it for every row of a ``when``.
    """

    @F.pandas_udf("string")
    def unicode_norm(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).lower(), na_action="ignore")

    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.coalesce(F.when(ascii_only, F.lower(text)), unicode_norm(F.when(~ascii_only, text)))


def trim(text: str) -> str:
    return text.strip(SPACE_CHARS)


def query_terms(raw: str, all_terms: bool = False) -> tuple[str, list[str]]:
    """(normalised query, terms). Raises ValueError if nothing but white space is asked for."""
    raw = trim(raw)
    if not raw:
        raise ValueError("the query is blank")
    query = normalize(raw)
    if not all_terms:
        return query, [query]
    return query, list(dict.fromkeys(t for t in (normalize(x) for x in SPACES.split(raw)) if t))


def parse_types(raw: str) -> list[str]:
    """Extensions of a comma-separated list, each once, in lower case with a leading dot."""
    out = []
    for item in raw.split(","):
        item = trim(item).lower()
        if not item or item == "." or "/" in item or "\\" in item:
            raise ValueError(f"not a file type: {item!r}")
        out.append(item if item.startswith(".") else f".{item}")
    return list(dict.fromkeys(out))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE_CHARS}]")


def utf8_prefix(text: str, limit: int) -> str:
    """The longest prefix of at most ``limit`` UTF-8 bytes."""
    return text.encode()[: max(limit, 0)].decode("utf-8", "ignore")


#: Characters that could move or hide text on a terminal, namely controls and direction marks.
_UNSAFE = re.compile("[\u0000-\u001f\u007f-\u009f\u202a-\u202e\u2066-\u2069]")


def terminal_text(text: str) -> str:
    return _UNSAFE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def display_width(text: str) -> int:
    """Terminal cells: wide and full-width characters take two, marks and joiners none."""
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def clip_width(text: str, cells: int) -> str:
    """``text`` cut to the given cells, with a closing … if anything was cut."""
    if display_width(text) <= cells:
        return text
    out, used = [], 0
    for c in text:
        used += display_width(c)
        if used > cells - 1:
            break
        out.append(c)
    return "".join(out) + "…" if cells > 0 else ""


def format_mib(size: int) -> str:
    return f"{size / 1048576:.2f} MiB"


def format_percent(done: int, total: int) -> str:
    """Two decimals; 100 only when all is done."""
    share = 100.0 if total <= 0 else 100 * done / total
    return f"{share if done >= total else min(share, 99.99):.2f}%"


def format_elapsed(ms: float) -> str:
    seconds = int(ms // 1000)
    hours, rest = divmod(seconds, 3600)
    minutes, seconds = divmod(rest, 60)
    return f"{hours}:{minutes:02d}:{seconds:02d}" if hours else f"{minutes}:{seconds:02d}"


def iso_time(ms: Column) -> Column:
    """Milliseconds since the epoch as ISO 8601 in UTC (the session's time zone has to be UTC)."""
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def document_reference(ident: Column, path: Column) -> Column:
    """A reference that names a document's id and pins its path."""
    return F.concat(ident.cast("string"), F.lit("-"), F.substring(F.sha2(path, 256), 1, 16))


_REFERENCE = re.compile(r"(\d+)-([0-9a-f]{16})")


def parse_reference(reference: str) -> tuple[int, str]:
    found = _REFERENCE.fullmatch(reference)
    if not found:
        raise ValueError("not a document reference")
    return int(found[1]), found[2]
