"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Pieces are classed by the reciprocal of the capacity that they fill: class k takes pieces of at most capacity / k and more than
capacity / (k + 1) tokens, and each of its bins holds exactly k of them. Every worker fills the bins of its own partition, so there is no shuffle and no
shared state. A document gives full sequences first; what is left of it is one piece. Only what a bin of k pieces still lacks is cut: it is topped up with the first
tokens of the documents that come next, and what these have left is classed again. What bins are still open at the end of a partition is laid end to end and cut at
powers of two, where no padding is needed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm.common import lean

CAPACITY = 4096
WHOLE_BELOW = 32
END_OF_DOCUMENT = 2
#: Words whose ids a worker remembers in each of two generations.
CACHE_WORDS = 500_000

#: Words that the tokenizer gets together.
TOGETHER = 2000
_CLOSING = re.compile(rb"[.,](?<=[a-z].)(?=[ \t\n\x0b\x0c\r]|$)")

_ENCODERS: dict[tuple[str, int], WordIds] = {}

PIECE_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids (as bytes of unsigned 32-bit) by word, for tokenizers that drop white space and never join over it.

    Words are lower-cased (A-Z) byte strings without ASCII white space. A closing full stop or comma after a Latin letter is a token of its own, so it is parted from its
    word. The words of a text that aren't known yet go through the tokenizer together, and each gets the ids whose places lie in it. A special token's string is looked for in the
    text as it is written, so texts that hold one in any case go through the tokenizer whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.most = cache_words
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        """Makes all these words known."""
        if len(self.known) + len(words) > self.most:  # words in use come back from the older generation
            self.older, self.known = self.known, {}
        fresh = []
        for word in words:
            ids = self.older.get(word)
            if ids is None:
                fresh.append(word)
            else:
                self.known[word] = ids
        for k in range(0, len(fresh), TOGETHER):
            some = fresh[k : k + TOGETHER]
            texts = [w.decode("utf-8") for w in some]
            encoding = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ends = np.cumsum([len(t) + 1 for t in texts])  # each with the space after it
            at = np.array([place[0] for place in encoding.offsets], np.int64)
            ids = np.array(encoding.ids, np.uint32).tobytes()
            cuts = (4 * np.searchsorted(at, ends)).tolist()
            begin = 0
            for word, end in zip(some, cuts):
                self.known[word] = ids[begin:end]
                begin = end

    def ids(self, text: bytes) -> bytes:
        lowered = text.lower()
        if any(s in lowered for s in self.special):
            return np.array(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids, np.uint32).tobytes()
        words = _CLOSING.sub(rb" \g<0>", lowered).split()
        found = list(map(self.known.get, words))
        if None in found:
            self.learn(list(dict.fromkeys(w for w, f in zip(words, found) if f is None)))
            ids = self.known
            found = [ids[w] if f is None else f for w, f in zip(words, found)]
        return b"".join(found)


def cut(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's full sequences and of what is left."""
    return [capacity] * (tokens // capacity) + [tokens % capacity] * (tokens % capacity > 0)


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """Pieces to a bin: the largest k with length <= capacity / k."""
    return capacity // length


def power_cuts(total: int, capacity: int = CAPACITY) -> list[int]:
    """Sequence lengths for tokens laid end to end: full ones, then falling powers of two."""
    sizes, rest = [capacity] * (total // capacity), total % capacity
    while rest:
        sizes.append(1 << (rest.bit_length() - 1))
        rest -= sizes[-1]
    return sizes


class Packer:
    """Fills the bins of one partition. Rows are (key, start, ids, doc_tokens); emits (key, start, length, crc, doc_tokens, sequence, offset).

    It holds a bin at most for each class, so no more than about 2 * sqrt(capacity) sequences.
    """

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, whole_below: int = WHOLE_BELOW):
        self.next, self.capacity, self.whole_below = first_sequence, capacity, whole_below
        self.open: dict[int, list[tuple]] = {}
        self.short: list[tuple[list[tuple], int]] = []  # bins with all their pieces, and the tokens that they lack

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        """ids: unsigned 32-bit little-endian."""
        n = len(ids) // 4
        start = 0
        for length in cut(n, self.capacity):
            piece = (key, start, length, ids[4 * start : 4 * (start + length)], n)
            start += length
            if length == self.capacity:
                yield from self.lay([piece])
            else:
                yield from self.place(piece)

    def place(self, piece: tuple) -> Iterator[tuple]:
        """Tops up bins that lack tokens and classes what is left. Pieces of less than ``whole_below`` tokens top up only where they fit as a whole."""
        key, start, length, ids, n = piece
        while self.short and length and (length >= self.whole_below or length <= self.short[-1][1]):
            bin_, room = self.short.pop()
            take = min(length, room)
            bin_.append((key, start, take, ids[: 4 * take], n))
            start, length, ids = start + take, length - take, ids[4 * take :]
            if take == room:
                yield from self.lay(bin_)
            else:
                self.short.append((bin_, room - take))
        if not length:
            return
        k = class_of(length, self.capacity)
        bin_ = self.open.setdefault(k, [])
        bin_.append((key, start, length, ids, n))
        if len(bin_) == k:
            del self.open[k]
            room = self.capacity - sum(p[2] for p in bin_)
            if room:
                self.short.append((bin_, room))
            else:
                yield from self.lay(bin_)

    def lay(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, length, ids, n in pieces:
            yield key, start, length, zlib.crc32(ids), n, self.next, offset
            offset += length
        self.next += 1

    def close(self) -> Iterator[tuple]:
        """Open bins of all classes, largest pieces first, cut where the sequences end."""
        left = [p for bin_, _ in self.short for p in bin_] + [p for k in sorted(self.open) for p in self.open[k]]
        sizes = power_cuts(sum(p[2] for p in left), self.capacity)
        row: list[tuple] = []
        room = sizes.pop(0) if sizes else 0
        for key, start, length, ids, n in left:
            while length:
                take = min(length, room)
                row.append((key, start, take, ids[: 4 * take], n))
                start, length, ids, room = start + take, length - take, ids[4 * take :], room - take
                if not room:
                    yield from self.lay(row)
                    row, room = [], sizes.pop(0) if sizes else 0
        self.open, self.short = {}, []


def pack(docs: DataFrame, encoder: Callable[[], Callable[[bytes], bytes]], *, capacity: int = CAPACITY, whole_below: int = WHOLE_BELOW) -> DataFrame:
    """Packs the documents (doc_id, text) and returns one row per piece: doc_id and PIECE_SCHEMA.

    ``encoder()`` makes, on the worker, a function from UTF-8 text to token ids (unsigned 32-bit, without the closing id). Null texts are empty: their
    only token is the closing id; texts of any length are cut into full sequences. Null and repeated doc_ids and repeated rows are packed like any others. Other columns
    are dropped. An empty table gives an empty result. The sequence number is the partition's number and a count within it, so a
    partition that is run again on the same rows gives the same sequences.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_OF_DOCUMENT], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, whole_below)
        schema = None

        def table(rows: list[tuple], kind) -> pa.RecordBatch:
            nonlocal schema
            schema = schema or pa.schema([("doc_id", kind), *((x.split()[0], pa.int64()) for x in PIECE_SCHEMA.split(", "))])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        rows: list[tuple] = []
        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                raw = text.as_py()
                rows.extend(packer.add(doc_id.as_py(), (encode(raw.encode()) if raw else b"") + end))
                if len(rows) >= 20_000:
                    yield table(rows, kind)
                    rows = []
        rows.extend(packer.close())
        if rows:
            yield table(rows, kind)

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {key}, {PIECE_SCHEMA}")


def word_encoder(path: str, cache_words: int = CACHE_WORDS) -> Callable[[], Callable[[bytes], bytes]]:
    """An encoder for a tokenizer file whose normaliser lower-cases and whose pre-tokenizer drops white space.

    A worker process keeps its word ids from one task to the next.
    """

    def make() -> Callable[[bytes], bytes]:
        from lodestone.llm.packing import _ENCODERS as known  # the worker's own, not a copy sent along

        if (path, cache_words) not in known:
            known[path, cache_words] = WordIds(path, cache_words)
        return known[path, cache_words].ids

    return make
