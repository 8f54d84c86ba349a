"""Token ids in a compact file format: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

A page is a row of a Parquet table (so Spark's commit protocol and any of its file systems serve it) and holds whole documents: their ids and
lengths in ids, and blocks of at most BLOCK ids. A block begins at a byte and has a checkpoint, the bit at which it stands, every STEP ids; a reader
decodes a block from all its checkpoints at once, each step by one look into a table of 2 ** LIMIT entries. The lengths of all codes, from which the codes follow, lie beside the pages.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import lean, materialize, remove, scratch, settle

END_OF_DOCUMENT = 2
#: Longest code in bits; 2 ** LIMIT has to be at least the size of the vocabulary.
LIMIT = 18
#: Ids of a block and of a checkpoint's run; ids after which a page ends with its document.
BLOCK, STEP, PAGE = 1 << 17, 128, 1 << 19
#: Bytes of text that are taken apart together.
TOGETHER = 16 << 20
#: Words that a worker remembers in each of two generations.
CACHE_WORDS = 500_000

# What the tokenizer's pattern takes for letters, numbers and white space among the first 256 characters.
_L, _N, _W = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_PARTS = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_SPACE = re.compile(f"[{_W}]")
Encode = Callable[[list[str | None]], list[bytes]]
_ENCODERS: dict[tuple[str, int], ByteIds] = {}


class ByteIds:
    """Token ids (unsigned 16-bit) of texts for a byte-level BPE file.

    A space before a word opens a new part of the tokenizer's pattern, so texts are taken apart at single spaces, at line feeds and before closing marks, and what isn't letters alone by the
    pattern. The library's model turns parts that aren't known yet to ids. Texts in which this doesn't hold (two blanks together, a mark after a mark) go through the pattern whole; those with
    characters beyond the first 256, or a special token's string, go to the library whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.most = self.tokenizer.model, cache_words
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        self.alphabet = str.maketrans({b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)})
        self.space = chr(32).translate(self.alphabet)
        self.words: dict[str, bytes] = {}  # of a space and the word, in two generations
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}  # all other parts

    def fresh(self, part: str) -> bytes:
        plain = part.replace(" ", self.space) if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.alphabet)
        return array("H", [t.id for t in self.model.tokenize(plain)]).tobytes()

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.older.get(word) or self.fresh(" " + word)
            if len(self.words) >= self.most:
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found

    def part(self, part: str) -> bytes:
        if part[0] == " " and part[1:].isalpha():
            return self.word(part[1:])
        found = self.parts.get(part)
        if found is None:
            found = self.fresh(part)
            if len(self.parts) >= self.most // 4:
                self.parts = {}
            self.parts[part] = found
        return found

    def latin(self, text: str) -> bool:
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def piece(self, piece: str) -> tuple[int, bytes]:
        """How a piece of batch() ends (0: letter or number, 1: otherwise, 2: its text has to be taken whole, 3: a mark that needs a 0 before it), and its ids."""
        if piece.isalpha() and self.latin(piece):
            return 0, self.word(piece)
        if piece[:1] == "\1":
            return 1 if piece == "\1\n" else 3, self.part(piece[1:])
        inner = piece[1:] if piece[:1] == "\0" else piece
        if not inner or _SPACE.search(inner) or not self.latin(inner) or any(s in inner for s in self.special):
            return 2, b""
        parts = _PARTS.findall(inner if inner is not piece else " " + piece)
        return int(not inner[-1].isalnum()), b"".join(map(self.part, parts))

    def ids(self, text: str) -> bytes:
        """Of any text, by the pattern or the library."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            whole = True
        else:
            whole = any(s in text for s in self.special)
        if whole:
            return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.part, _PARTS.findall(text)))

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of several texts; null has none. Each distinct piece is looked up once: \\0 marks those without a space before them, \\1 marks and line feeds that were parted from a word."""
        out: list = [b"" if not t else self.ids(t) if "\0" in t or "\1" in t else None for t in texts]
        at = [k for k, found in enumerate(out) if found is None]
        if not at:
            return out
        spaced = ["\0" + texts[k].replace("\n", " \1\n \0").replace(". ", " \1. ").replace(", ", " \1, ") for k in at]
        lists = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = list(map(self.words.get, distinct))
        kinds = np.zeros(len(known), np.int8)
        for k, found in enumerate(known):
            if found is None:
                kinds[k], known[k] = self.piece(distinct[k])
        index = coded.indices.to_numpy()
        kind = kinds[index]
        odd = kind == 2
        odd[1:] |= (kind[1:] == 3) & (kind[:-1] != 0)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 2
        first = np.cumsum(size) - size
        n = size[index]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(known), np.uint16)[np.repeat((first[index] - ends + n).astype(np.int32), n) + np.arange(int(ends[-1]), dtype=np.int32)]
        pieces = lists.offsets.to_numpy()
        bounds, odds = np.concatenate([[0], ends])[pieces].tolist(), np.concatenate([[0], np.cumsum(odd)])[pieces]
        for k, begin, end, strange in zip(at, bounds, bounds[1:], np.diff(odds).tolist()):
            out[k] = self.ids(texts[k]) if strange else ids[begin:end].tobytes()
        return out


def byte_encoder(path: str, cache_words: int = CACHE_WORDS) -> Callable[[], Encode]:
    """Makes, on the worker, a function from texts to their ids (unsigned 16-bit, little-endian). A worker process keeps its words from one task to the next."""

    def make() -> Encode:
        from lodestone.llm.huffman import _ENCODERS as known  # the worker's own, not a copy sent along

        if (path, cache_words) not in known:
            known[path, cache_words] = ByteIds(path, cache_words)
        return known[path, cache_words].batch

    return make


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with none longer than ``limit`` (package-merge); 0 where the count is 0. A single symbol gets one bit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(object) if counts.sum() > 1 << 55 else counts[order].astype(np.int64)
    levels, merged = [], weights
    for _ in range(limit - 1):  # from the longest codes up: pairs of the level below join the symbols
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        merged = both[at]
    take = 2 * n - 2
    found = np.zeros(n, np.int64)
    for single in reversed(levels):  # of what is taken on a level, each symbol gets a bit and each pair takes two below
        symbols = int(single[:take].sum())
        found[:symbols] += 1
        take = 2 * (take - symbols)
    found[:take] += 1
    lengths[order] = found
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by symbol: ascending by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    for symbol in used[np.argsort(lengths[used], kind="stable")].tolist():
        code <<= int(lengths[symbol]) - last
        last = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """symbol << 8 | length for each value of the next ``limit`` bits."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    span = 1 << (limit - lengths[used].astype(np.int64))
    table = np.zeros(1 << limit, np.uint32)
    filled = np.repeat(used.astype(np.uint32) << 8 | lengths[used], span)
    table[: len(filled)] = filled
    return table


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """The bits of a block, most significant first, and the bit at which every step-th id begins."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1]) if len(ids) else 0
    words = np.zeros(total // 32 + 2, np.uint64)
    word, shift = at >> 5, (64 - (at & 31) - size).astype(np.uint64)
    value = codes[ids].astype(np.uint64) << shift  # each lies in two words of 32 bits at most
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(ids) else np.zeros(0, np.int64)
    if len(ids):
        words[word[first]] = np.bitwise_or.reduceat(value >> np.uint64(32), first)
        low = value & np.uint64(0xFFFFFFFF)
        over = np.flatnonzero(low)
        words[word[over] + 1] |= low[over]
    return words.astype(">u4").tobytes()[: (total + 7) // 8], at[::step].astype(np.uint32)


def decode_block(bits: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, limit: int = LIMIT, step: int = STEP) -> np.ndarray:
    """The n ids of a block. All checkpoints advance together."""
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8)
    at = checkpoints.astype(np.int64)
    lanes = len(at)
    out = np.zeros((step, lanes), np.uint16)
    # 32 bits from every byte on, so that each step takes one look
    wide = raw[:-3].astype(np.uint32) << 24 | raw[1:-2].astype(np.uint32) << 16 | raw[2:-1].astype(np.uint32) << 8 | raw[3:]
    down, most = 32 - limit, np.uint32((1 << limit) - 1)
    for k in range(step):
        if k == n - (lanes - 1) * step and lanes:  # the last run is shorter
            at = at[:-1]
        if not len(at):
            break
        entry = table[(wide[at >> 3] >> (down - (at & 7)).astype(np.uint32)) & most]
        out[k, : len(at)] = entry >> 8
        at = at + (entry & 255)
    return out.T.reshape(-1)[:n]


def tokenized(docs: DataFrame, encoder: Callable[[], Encode]) -> DataFrame:
    """Ids of the documents in ascending doc_id: range, at (ids before it in its range), doc_id, ids (unsigned 16-bit, closing id included). Sorted in ranges; repeated doc_ids by their text's hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_OF_DOCUMENT], np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, before, part = encoder(), 0, TaskContext.get().partitionId()

        def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal before
            found = [ids + end for ids in encode([t for batch in held for t in batch.column(1).to_pylist()])]
            sizes = np.array([len(f) // 2 for f in found], np.int64)
            at = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            names = pa.chunked_array([batch.column(0) for batch in held]).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int64()), pa.array(at), names, pa.array(found, pa.binary())], names=["range", "at", "doc_id", "ids"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= TOGETHER:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(lean(run), f"range long, at long, doc_id {kind}, ids binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs: at most 65,536 sums, which the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            data = batch.column(0)
            raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
            offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
            total += np.bincount(raw[offsets[0] : offsets[-1]].view(np.uint16), minlength=1 << 16) if len(data) else 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for row in tokens.select("ids").mapInArrow(lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["id"]] = row["n"]
    return counts


def write_pages(tokens: DataFrame, lengths: np.ndarray, path: str) -> None:
    """Writes the ids of tokenized() as pages below path/pages and the lengths of the codes to path/codes."""
    spark = tokens.sparkSession
    kind = tokens.schema["doc_id"].dataType.simpleString()
    packed = lengths.tobytes()
    schema = f"range long, first long, doc_ids array<{kind}>, sizes array<long>, blocks array<struct<n: long, checkpoints: binary, bits: binary>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.frombuffer(packed, np.uint8)
        codes = canonical(size)
        part, first, held, docs, sizes = None, 0, [], None, []

        def page() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), np.uint16)
            blocks = []
            for k in range(0, len(ids), BLOCK):
                some = ids[k : k + BLOCK]
                bits, checkpoints = encode_block(some, codes, size)
                blocks.append({"n": len(some), "checkpoints": checkpoints.tobytes(), "bits": bits})
            kinds = pa.list_(pa.struct([("n", pa.int64()), ("checkpoints", pa.binary()), ("bits", pa.binary())]))
            names = pa.array([docs], pa.list_(key))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([first]), names, pa.array([sizes], pa.list_(pa.int64())), pa.array([blocks], kinds)], names=["range", "first", "doc_ids", "sizes", "blocks"])

        for batch in batches:
            key = batch.schema.field("doc_id").type
            for rng, at, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if held and (rng != part or at != first + sum(sizes) or at - first >= PAGE):
                    yield page()
                    held = []
                if not held:
                    part, first, docs, sizes = rng, at, [], []
                held.append(ids), docs.append(doc_id), sizes.append(len(ids) // 2)
        if held:
            yield page()

    tokens.mapInArrow(lean(run), schema).write.option("compression", "uncompressed").parquet(f"{path}/pages")
    spark.createDataFrame([(packed,)], "lengths binary").write.parquet(f"{path}/codes")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Of each document in the pages: range, at (ids before it in its range), doc_id, n_tokens, ids_crc32."""
    packed = bytes(spark.read.parquet(f"{path}/codes").first()[0])
    pages = spark.read.parquet(f"{path}/pages")
    kind = pages.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(np.frombuffer(packed, np.uint8))
        for batch in batches:
            key = batch.schema.field("doc_ids").type.value_type
            for k in range(batch.num_rows):
                sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
                ends = np.cumsum(sizes)
                crc, doc, done = [0] * len(sizes), 0, 0
                for block in batch.column("blocks")[k]:
                    n = block["n"].as_py()
                    ids = decode_block(block["bits"].as_py(), np.frombuffer(block["checkpoints"].as_py(), np.uint32), n, table).astype("<u4")
                    at = 0
                    while at < n:  # documents may go on in the next block
                        take = min(n - at, int(ends[doc]) - done)
                        crc[doc] = zlib.crc32(ids[at : at + take], crc[doc])
                        at, done = at + take, done + take
                        doc += done == ends[doc]
                first = batch.column("first")[k].as_py()
                named = pa.array(batch.column("doc_ids")[k].as_py(), key)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("range")[k].as_py()] * len(sizes), pa.int64()), pa.array(first + ends - sizes), named, pa.array(sizes), pa.array(crc, pa.int64())], names=["range", "at", "doc_id", "n_tokens", "ids_crc32"])

    return pages.mapInArrow(lean(run), f"range long, at long, doc_id {kind}, n_tokens long, ids_crc32 long")


def archive_ids(docs: DataFrame, encoder: Callable[[], Encode], path: str) -> None:
    """Encodes the documents (doc_id, text) into pages below ``path``, in ascending doc_id.

    Null texts are empty: their only id is the closing one. Null doc_ids come first; repeated doc_ids and rows are kept, in the order of their text's hash.
    A document of any length lies in one page, in as many blocks as it needs. Other columns are dropped. An empty table gives no page.
    """
    tokens = materialize(tokenized(docs, encoder), "tokens", "zstd")
    settle(docs.sparkSession)
    write_pages(tokens, code_lengths(count_ids(tokens)), path)
    settle(docs.sparkSession, tokens)


def described(spark: SparkSession, path: str) -> DataFrame:
    """Of each document in the pages below ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    pages = spark.read.parquet(f"{path}/pages")
    totals = pages.groupBy("range").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that was written
    starts = totals.select("range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = read_pages(spark, path).join(F.broadcast(starts), "range")
    return found.select("doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, encoder: Callable[[], Encode]) -> DataFrame:
    """Writes the documents' ids to the shared folder and returns what the files say of each document; the files are deleted then."""
    spark = docs.sparkSession
    path = scratch(spark, "ids")
    archive_ids(docs, encoder, path)
    found = materialize(described(spark, path), "described")
    remove(spark, path)
    return found
