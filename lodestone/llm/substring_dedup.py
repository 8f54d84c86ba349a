"""Removal of repeated word windows by recompression.

Each document's word sequence is rewritten in rounds, as in recompression of strings: a maximal run of one symbol becomes one symbol, then every
pair "left symbol, right symbol" becomes one, where a hash of its name makes a symbol left or right. Whether there is a
cut between two symbols depends on these two alone, so equal word sequences get equal symbols except near their ends. New symbols are
named by a 64-bit hash of what they stand for, so names are the same on every worker without any exchange.

For every symbol the words that it depends on (its support) are tracked. A window of words contains a symbol for certain if it
contains its support. Each window is represented by one such symbol of a low round, its anchor, picked by the least hash of the support's words: equal windows
have equal anchors. Windows without any (in long periodic stretches) are always candidates, so nothing depends on luck.

Symbols of a high round cut the documents into chunks. A chunk, with the words that its last window reaches into, fixes all windows that
begin in it, so of equal chunks only one takes part in the search for equal windows, and windows of a chunk that
occurs twice are repeated by that alone. Windows of other chunks are candidates if their anchor occurs elsewhere; they are settled by
128-bit hashes of their words' 64-bit hashes, half of it modulo a prime.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lean, materialize, settle
from lodestone.llm.shingles import PrimeRangeHash, RangeHash, hashed_rows, mix, signed

WINDOW = 35
#: Rounds after which anchors and chunks are taken: symbols of about 2 and 30 words.
LOW_ROUNDS, HIGH_ROUNDS = 3, 12
#: Words that are parsed together, and rows in an output batch.
GROUP_WORDS = 150_000

_RUN, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_BASES = (np.uint64(0x9E3779B97F4A7C15),)

class Parse:
    """Symbols of several documents, laid end to end with one position between, before and after them."""

    def __init__(self, documents: list[np.ndarray]):
        lengths = np.array([len(d) for d in documents])
        self.first = np.cumsum(lengths + 1) - lengths  # position of each document's first word
        self.lengths = lengths
        total = int((lengths + 1).sum()) + 1
        gap = np.ones(total, bool)
        for at, d in zip(self.first, documents):
            gap[at : at + len(d)] = False
        self.words = np.empty(total, np.uint64)
        self.words[gap] = mix(np.arange(int(gap.sum()), dtype=np.uint64) + np.uint64(1))
        if total > gap.sum():
            self.words[~gap] = np.concatenate(documents)
        self.name, self.gap = self.words, gap
        self.start = np.arange(total)
        self.end = self.start + 1
        self.lo, self.hi = self.start, self.end

    def round(self, number: int, track: bool) -> None:
        """Names runs, then pairs. track: keep supports, which only the low rounds need."""
        name, gap = self.name, self.gap
        cut = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | gap[1:] | gap[:-1]]))
        if len(cut) < len(name):
            size = np.diff(np.append(cut, len(name)))
            last = cut + size - 1
            run = size > 1
            first = name[cut]
            first[run] = mix(first[run] * _RUN + size[run].astype(np.uint64))
            self.start, self.end, self.gap = self.start[cut], self.end[last], gap[cut]
        else:
            last, first = cut, name.copy()
        if track:  # a run ends where its neighbours differ, so they belong to the support
            self.lo, self.hi = self.lo[np.maximum(cut - 1, 0)], self.hi[np.minimum(last + 1, len(name) - 1)]
        name, gap = first, self.gap
        left = (mix(name + np.uint64(number + 1)) & np.uint64(1)).astype(bool) & ~gap
        pair = np.flatnonzero(left[:-1] & ~left[1:] & ~gap[1:])
        keep = np.ones(len(name), bool)
        keep[pair + 1] = False
        name = name.copy()
        name[pair] = mix(name[pair] * _PAIR + mix(name[pair + 1]))
        end = self.end.copy()
        end[pair] = end[pair + 1]
        if track:
            index = np.arange(len(name))
            lo = np.where(left, self.lo, self.lo[np.maximum(index - 1, 0)])
            hi = np.where(left, self.hi[np.minimum(index + 1, len(name) - 1)], self.hi)
            lo[pair], hi[pair] = self.lo[pair], self.hi[pair + 1]
            self.lo, self.hi = lo[keep], hi[keep]
        self.name, self.start, self.end, self.gap = name[keep], self.start[keep], end[keep], gap[keep]

    def run(self, window: int = WINDOW) -> None:
        """Sets, for every window: starts, anchor (key and position; -1 if it has none) and chunk; for every chunk: start, end, document."""
        one = RangeHash(self.words, _BASES[0])
        for k in range(LOW_ROUNDS):
            self.round(k, True)
        key = one.of(self.lo, self.hi)
        total = len(self.words)
        count = np.maximum(self.lengths - window + 1, 0)
        self.starts = np.repeat(self.first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        below = np.concatenate([[0], np.cumsum(np.bincount(self.lo, minlength=total + 1))])  # symbols whose support begins before i
        done = np.cumsum(np.bincount(self.hi, minlength=total + 1))  # symbols whose support ends by i
        a, b = below[self.starts], done[self.starts + window]
        size = np.maximum(b - a, 0)
        best = np.full(len(a), -1)
        table, level = np.arange(len(key)), 0
        while True:
            here = np.flatnonzero((size >> level) == 1)
            if len(here):
                x, y = table[a[here]], table[b[here] - (1 << level)]
                best[here] = np.where(key[x] <= key[y], x, y)
            if not len(size) or size.max(initial=0) < (2 << level):
                break
            x, y = table[: -(1 << level)], table[1 << level :]
            table = np.where(key[x] <= key[y], x, y)
            level += 1
        self.anchor, self.anchor_key, self.anchor_at = best, key, self.lo
        for k in range(LOW_ROUNDS, HIGH_ROUNDS):
            self.round(k, False)
        real = ~self.gap
        self.chunk_start, chunk_end = self.start[real], self.end[real]
        document = np.searchsorted(self.first, self.chunk_start, "right") - 1
        last = (self.first + self.lengths)[document]
        reach = np.minimum(chunk_end + window - 1, last)
        self.chunk_windows = np.maximum(reach - self.chunk_start - window + 1, 0)
        self.chunk_document = document
        self.x1 = one.of(self.chunk_start, reach)
        self.x2 = PrimeRangeHash(mix(self.words)).of(self.chunk_start, reach)
        self.chunk = np.searchsorted(self.chunk_start, self.starts, "right") - 1  # of each window

    def anchor_rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, signature, chunk) for each anchor and chunk with a window that it stands for. Windows without one have the key 0.

        The signature tells an anchor's occurrences apart, unless all chunks that it serves are equal and it lies at the same place of the first.
        """
        if not len(self.starts):
            return (np.zeros(0, np.uint64),) * 3
        new = np.concatenate([[True], (self.anchor[1:] != self.anchor[:-1]) | (self.chunk[1:] != self.chunk[:-1])])
        anchor, chunk = self.anchor[new], self.chunk[new]
        none = anchor < 0
        order = np.lexsort((chunk, anchor))
        anchor, chunk, none = anchor[order], chunk[order], none[order]
        fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (chunk[1:] != chunk[:-1])])
        anchor, chunk, none = anchor[fresh], chunk[fresh], none[fresh]
        group = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(group, len(anchor)))
        x = self.x1[chunk]
        turn = (np.arange(len(anchor)) - np.repeat(group, size)).astype(np.uint64)
        together = np.add.reduceat(mix(x + turn), group)
        offset = (self.anchor_at[anchor[group]] - self.chunk_start[chunk[group]]).astype(np.int64).view(np.uint64)
        signature = np.repeat(mix(together + mix(offset)), size)
        key = np.where(none, np.uint64(0), self.anchor_key[anchor])
        return key, np.where(none, mix(x), signature), x


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Groups of (word hashes, row without its text) of (k1, k2, text, ...). A text that this task has had is skipped, as are texts without a window."""
    seen: set[int] = set()
    group, size = [], 0
    for batch in batches:
        fresh = []
        for i, k1 in enumerate(batch.column(0).to_pylist()):
            if k1 not in seen:
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(k1)
                fresh.append(i)
        if not fresh:
            continue
        if len(fresh) < batch.num_rows:
            batch = batch.take(pa.array(fresh, pa.int64()))
        others = [batch.column(k) for k in range(batch.num_columns) if k != 2]
        for i, found in hashed_rows(batch.column(2)):
            if len(found) < WINDOW:
                continue
            group.append((found, [c[i].as_py() for c in others]))
            size += len(found)
            if size >= GROUP_WORDS:
                yield group
                group, size = [], 0
    if group:
        yield group


def _chunks_and_anchors(texts: DataFrame) -> DataFrame:
    """kind 0: chunks (a, b: hash; k1, k2: text; start; windows); kind 1: anchors (a: key, b: signature, k1: chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _documents(batches):
            parse = Parse([d for d, _ in group])
            parse.run()
            key, signature, x = parse.anchor_rows()
            some = parse.chunk_windows > 0
            document = parse.chunk_document[some]
            k1, k2 = (np.array([row[k] for _, row in group], np.int64)[document] for k in (0, 1))
            n, m = int(some.sum()), len(key)
            none = pa.nulls(m, pa.int64())
            start = (parse.chunk_start[some] - parse.first[document]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([0, 1], np.int32), [n, m])),
                    pa.array(np.concatenate([signed(parse.x1[some]), signed(key)])),
                    pa.array(np.concatenate([signed(parse.x2[some]), signed(signature)])),
                    pa.array(np.concatenate([k1, signed(x)])),
                    pa.concat_arrays([pa.array(k2), none]),
                    pa.concat_arrays([pa.array(start), none]),
                    pa.concat_arrays([pa.array(parse.chunk_windows[some].astype(np.int64)), none]),
                ],
                names=["kind", "a", "b", "k1", "k2", "start", "windows"],
            )

    return texts.mapInArrow(lean(run), "kind int, a long, b long, k1 long, k2 long, start long, windows long")


def _candidate_windows(texts: DataFrame) -> DataFrame:
    """(w1, w2, x1, x2, off) of the windows named by ``wanted`` (start of chunk, anchor's key) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _documents(batches):
            parse = Parse([d for d, _ in group])
            parse.run()
            key = np.where(parse.anchor < 0, np.uint64(0), parse.anchor_key[parse.anchor]) if len(parse.starts) else np.zeros(0, np.uint64)
            named = mix(key + mix(parse.chunk_start[parse.chunk].astype(np.uint64)))
            asked = [mix(np.array([w["key"] for w in row[2]], np.int64).view(np.uint64) + mix(np.array([w["start"] for w in row[2]], np.int64).view(np.uint64) + np.uint64(at))) for (_, row), at in zip(group, parse.first)]
            hit = np.flatnonzero(np.isin(named, np.concatenate(asked)))
            if not len(hit):
                continue
            start, chunk = parse.starts[hit], parse.chunk[hit]
            w1 = RangeHash(parse.words, _BASES[0]).of(start, start + WINDOW)
            w2 = PrimeRangeHash(mix(parse.words)).of(start, start + WINDOW)
            yield pa.RecordBatch.from_arrays([pa.array(signed(c)) for c in (w1, w2, parse.x1[chunk], parse.x2[chunk])] + [pa.array((start - parse.chunk_start[chunk]).astype(np.int64))], names=["w1", "w2", "x1", "x2", "off"])

    return texts.mapInArrow(lean(run), "w1 long, w2 long, x1 long, x2 long, off long")


def removed(starts: list[tuple[int, int]], words: int, window: int = WINDOW) -> np.ndarray:
    """Words covered by windows; starts: (first window, number of windows)."""
    change = np.zeros(words + 1, np.int64)
    for at, count in starts:
        change[at] += 1
        change[min(at + count - 1 + window, words)] -= 1
    return np.cumsum(change[:-1]) > 0


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(k1, k2, starts: array of (start, count)) for every text (k1, k2, text) with repeated windows, by its 128-bit hash.

    Texts that occur twice are not looked at for that; the caller knows them by their count.
    """
    spark = texts.sparkSession
    parsed = materialize(_chunks_and_anchors(texts), "symbols")
    chunks = materialize(parsed.where("kind = 0").selectExpr("a as x1", "b as x2", "k1", "k2", "start", "windows"), "chunks")
    place = F.struct("k1", "k2", "start")
    seen = chunks.groupBy("x1", "x2").agg(F.min(place).alias("at"), F.max(place).alias("other"))
    seen = seen.select("x1", "x2", "at", (F.col("at") != F.col("other")).alias("again"))
    seen = materialize(seen.select("x1", "x2", "again", "at.k1", "at.k2", "at.start"), "places")
    settle(spark)
    anchors = parsed.where("kind = 1").selectExpr("a as key", "b as signature", "k1 as x1")
    # windows without an anchor (key 0) are all candidates: no exchange by their key
    named = anchors.where("key <> 0")
    shared = named.groupBy("key").agg(F.min("signature").alias("lo"), F.max("signature").alias("hi")).where("lo <> hi").select("key")
    wanted = named.join(shared, "key", "left_semi").union(anchors.where("key = 0").select("key", "signature", "x1")).select("key", "x1").distinct()
    wanted = wanted.join(seen.select("x1", "k1", "k2", "start"), "x1").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "key")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    settle(spark, parsed)
    windows = materialize(_candidate_windows(texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted")), "windows")
    settle(spark, wanted)
    occurrence = F.xxhash64("x1", "x2", "off")
    twice = windows.groupBy("w1", "w2").agg(F.min(occurrence).alias("lo"), F.max(occurrence).alias("hi")).where("lo <> hi").select("w1", "w2")
    twice = materialize(twice, "twice")  # a table of its own, so that the join below can split a window that very many texts share
    found = windows.join(twice, ["w1", "w2"], "left_semi").select("x1", "x2", "off").distinct()
    # a chunk that occurs once has its windows where it is; all windows of one that occurs again are repeated
    once = found.join(seen.where("not again").select("x1", "x2", "k1", "k2", "start"), ["x1", "x2"]).selectExpr("k1", "k2", "start + off as start", "1L as count")
    whole = chunks.join(seen.where("again").select("x1", "x2"), ["x1", "x2"], "left_semi").selectExpr("k1", "k2", "start", "windows as count").distinct()
    out = once.union(whole).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "count")).alias("starts"))
    out = materialize(out, "repeats")
    settle(spark, windows, chunks, seen, twice)
    return out


def text_keys(text: Column) -> dict[str, Column]:
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}


def remove_repeats(docs: DataFrame, *, keep_text: bool = False) -> DataFrame:
    """Removes every word covered by a window of WINDOW words whose word sequence also starts anywhere else.

    Returns doc_id, n_words, n_removed, kept_sha256 (and kept_text, the kept words joined by one space, if asked for) per row of docs
    (doc_id, text; other columns are dropped). Null texts have no words. Repeated rows are repeats of each other, whatever
    their doc_id, which is only carried along. An empty table gives an empty result.

    All tables in between are keyed by a 128-bit hash of the text, so a text that a third of all rows share is parsed about once per task.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(text_keys(F.col("text")))
    texts = rows.where(F.length("text") >= 2 * WINDOW - 1).select("k1", "k2", "text")
    repeats = repeated_windows(texts)
    copies = rows.groupBy("k1", "k2").agg((F.count("*") > 1).alias("copied"))
    known = materialize(copies.join(repeats, ["k1", "k2"], "left").where("copied or starts is not null"), "known")
    joined = rows.join(known, ["k1", "k2"], "left").select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "starts")
    schema = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, kept = [], [], [], []
            for text, copied, starts in zip(*(batch.column(k) for k in (1, 2, 3))):
                words = text.as_py().encode().split()
                n = len(words)
                spans = [(0, n - WINDOW + 1)] if copied.as_py() and n >= WINDOW else [(s["start"], s["count"]) for s in starts.as_py() or ()]
                gone = 0
                if spans:
                    out = removed(spans, n)
                    gone = int(out.sum())
                    words = [w for w, x in zip(words, out.tolist()) if not x]
                left = b" ".join(words)
                n_words.append(n), n_removed.append(gone), digest.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    kept.append(left.decode())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.string())] if keep_text else []), names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text)

    return joined.mapInArrow(lean(run), f"doc_id {schema}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)
