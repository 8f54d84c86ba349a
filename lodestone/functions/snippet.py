"""Snippets: the source text around a normalised hit."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import SPACES, normalize, trim

#: The longest snippet, its share for the hit if both ends are cut, and the context on the left, in code points.
LONGEST, INNER, LEFT = 160, 158, 45


def clusters(text: str) -> list[tuple[int, int]]:
    """Ranges of source text that normalise together: a character with the marks that follow it, and runs whose composition crosses characters."""
    out: list[tuple[int, int]] = []
    for k, c in enumerate(text):
        joins = unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Mc", "Me") or c == "‍"
        if out and not joins and not c.isascii():
            a, b = out[-1]
            before = text[a:b]
            joins = normalize(before + c) != normalize(before) + normalize(c)  # e.g. Hangul letters, half-width kana
        if out and joins:
            out[-1] = (out[-1][0], k + 1)
        else:
            out.append((k, k + 1))
    return out


def locate(text: str, needle: str) -> tuple[int, int] | None:
    """Source range of the first hit of a normalised needle, widened to whole clusters."""
    whole = normalize(text)
    at = whole.find(needle)
    if at < 0:
        return None
    if text.isascii():
        return at, at + len(needle)
    start = end = None
    done = 0
    for a, b in clusters(text):
        size = len(normalize(text[a:b]))
        if start is None and done + size > at:
            start = a
        done += size
        if done >= at + len(needle):
            end = b
            break
    return (start if start is not None else 0), (end if end is not None else len(text))


def first_term(text: str, terms: list[str]) -> str | None:
    """The term that occurs first in the normalised text; of several at one place, the first given."""
    whole = normalize(text)
    found = [(whole.find(t), k) for k, t in enumerate(terms) if t in whole]
    return terms[min(found)[1]] if found else None


def _flat(text: str) -> str:
    return SPACES.sub(" ", text)


def make_snippet(text: str, terms: list[str]) -> tuple[str, bool]:
    """(snippet, whether the hit itself was cut). At most LONGEST code points, white space collapsed, … where text is left out. Without a hit: the beginning."""
    term = first_term(text, terms)
    place = locate(text, term) if term else (0, 0)
    start, end = place or (0, 0)
    hit = _flat(text[start:end])
    cut = len(hit) > LONGEST
    before, after = _flat(text[:start]), _flat(text[end:])
    if not cut and len(hit) >= LONGEST - 1:
        return hit + ("…" if len(hit) == LONGEST - 1 and trim(after) else ""), False
    left = 0 if cut else min(LEFT, len(before), max(0, INNER - len(hit)))
    right = max(0, INNER - left - len(hit))
    head, tail = before[len(before) - left :], after[:right]
    out = ("…" if left < len(before) else "") + head + hit[:INNER] + tail + ("…" if right < len(after) or len(hit) > INNER else "")
    return trim(out), cut


def snippets(text: Column, terms: list[str]) -> Column:
    """struct(text, truncated) of a column; meant for the rows of a page, after they are chosen."""

    @F.pandas_udf("text string, truncated boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [make_snippet(x or "", terms) for x in batch]
            yield pd.DataFrame({"text": [f[0] for f in found], "truncated": [f[1] for f in found]})

    return run(text)
