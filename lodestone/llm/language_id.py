"""Language identification by prediction by partial matching.

For each language a context tree of bytes, of order 0 to 3, is counted on a bounded sample and then frozen. The probability of a byte is
that of the longest context that has seen it; each context that has not seen it costs an escape (method C: a context
with n symbols, d of them distinct, escapes with d / (n + d)). A text belongs to the language that codes it in the fewest bits.

All costs of seen contexts are worked out once at training, so scoring a byte is a table look-up for all languages at once;
only bytes that no language has seen after the three before them go down the orders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lean

#: Labelled documents for each language that are counted, about. More are not needed: the trees are of order 3.
SAMPLE_PER_LANGUAGE = 800
#: The language of texts without one.
UNKNOWN = "und"
#: Rows that are passed on together.
ROWS = 1000
#: Confidence is that of this many bytes at most, so long texts don't all score 1.
EVIDENCE_BYTES = 40
LETTER = re.compile(r"[^\W\d_]")
_PAD = b"\n\n\n"
_SLOTS = 20


@dataclass
class PPM:
    """Frozen statistics. Rows of the cost tables are contexts with the byte that follows, columns are languages."""

    languages: list[str]
    cost1: np.ndarray = field(default=None)  # [65536, L] two bytes: bits of the second after the first
    escape2: np.ndarray = field(default=None)  # [65536, L] bits of an escape after two bytes
    keys3: np.ndarray = field(default=None)  # sorted three-byte strings seen in any language
    cost2: np.ndarray = field(default=None)  # bits of the third after the two before
    escape3: np.ndarray = field(default=None)  # bits of an escape after these three
    keys4: np.ndarray = field(default=None)
    cost3: np.ndarray = field(default=None)
    slots: tuple[np.ndarray, np.ndarray] = field(default=None)

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]]) -> PPM:
        self = cls(sorted(samples))
        joined = [np.frombuffer(_PAD + _PAD.join(samples[x]), np.uint8).astype(np.uint32) for x in self.languages]

        def grams(b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            code = np.zeros(max(0, len(b) - 3), np.uint32)
            for k in range(n):
                code = (code << np.uint32(8)) | b[3 - n + 1 + k : len(b) - n + 1 + k]
            return np.unique(code, return_counts=True)

        def context(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ctx, first = np.unique(keys >> np.uint32(8), return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else counts[:0]
            return ctx, total, np.diff(np.append(first, len(keys)))

        per = [{n: grams(b, n) for n in (1, 2, 3, 4)} for b in joined]
        wide = len(self.languages)
        self.cost1, self.escape2 = np.zeros((65536, wide), np.float32), np.zeros((65536, wide), np.float32)
        self.keys3 = np.unique(np.concatenate([p[3][0] for p in per] or [np.zeros(0, np.uint32)]))
        self.keys4 = np.unique(np.concatenate([p[4][0] for p in per] or [np.zeros(0, np.uint32)]))
        self.cost2, self.escape3 = np.zeros((len(self.keys3), wide), np.float32), np.zeros((len(self.keys3), wide), np.float32)
        self.cost3 = np.zeros((len(self.keys4), wide), np.float32)
        last = np.arange(65536, dtype=np.uint32)
        for k, p in enumerate(per):
            keys, counts = p[1]
            n, d = counts.sum(), len(keys)
            cost0 = np.full(256, 8 - np.log2(max(d, 1) / max(n + d, 1)))
            cost0[keys] = -np.log2(counts / (n + d))

            def level(order: int, below: np.ndarray, keys_all: np.ndarray, p=p) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Costs of keys_all given those one order below; contexts and the bits of their escapes."""
                keys, counts = p[order + 1]
                ctx, total, distinct = context(keys, counts)
                escape = -np.log2(distinct / (total + distinct)) if len(ctx) else np.zeros(0)
                at = np.searchsorted(ctx, keys_all >> np.uint32(8))
                known = (at < len(ctx)) & (ctx[np.minimum(at, max(len(ctx) - 1, 0))] == keys_all >> np.uint32(8)) if len(ctx) else np.zeros(len(keys_all), bool)
                cost = below.copy()
                cost[known] += escape[at[known]]
                where = np.searchsorted(keys_all, keys)
                own = np.searchsorted(ctx, keys >> np.uint32(8))
                cost[where] = -np.log2(counts / (total[own] + distinct[own])) if len(keys) else cost[where]
                return cost, ctx, escape

            c1, _, _ = level(1, cost0[last & 255], last)
            self.cost1[:, k] = c1
            c2, ctx2, esc2 = level(2, c1[self.keys3 & 0xFFFF], self.keys3)
            self.cost2[:, k] = c2
            self.escape2[ctx2, k] = esc2
            tail = self.keys4 & np.uint32(0xFFFFFF)
            at = np.searchsorted(self.keys3, tail)
            c3, ctx3, esc3 = level(3, c2[np.minimum(at, max(len(self.keys3) - 1, 0))] if len(self.keys3) else np.zeros(len(tail)), self.keys4)
            self.cost3[:, k] = c3
            at = np.searchsorted(self.keys3, ctx3)
            seen = (at < len(self.keys3)) & (self.keys3[np.minimum(at, max(len(self.keys3) - 1, 0))] == ctx3) if len(self.keys3) else np.zeros(len(ctx3), bool)
            self.escape3[at[seen], k] = esc3[seen]
        return self

    def _slots(self) -> tuple[np.ndarray, np.ndarray]:
        """A direct-mapped table over keys4; keys that share a slot with another are found by bisection instead."""
        if self.slots is None:
            table, rows = np.zeros(1 << _SLOTS, np.uint32), np.full(1 << _SLOTS, -1, np.int32)
            slot = (self.keys4 * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)
            table[slot], rows[slot] = self.keys4, np.arange(len(self.keys4), dtype=np.int32)
            self.slots = table, rows
        return self.slots

    def _find(self, keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Rows of codes in sorted keys, -1 where there is none."""
        if not len(keys):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return np.where(keys[at] == codes, at, -1)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, [texts, L]."""
        b = np.frombuffer(_PAD + _PAD.join(texts) + _PAD, np.uint8).astype(np.uint32)
        code = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        table, rows = self._slots()
        slot = (code * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)
        row = np.where(table[slot] == code, rows[slot], -1)
        odd = np.flatnonzero(row < 0)
        row[odd] = self._find(self.keys4, code[odd])
        if len(self.keys4):
            cost = self.cost3[row]
        else:
            cost = np.zeros((len(code), len(self.languages)), np.float32)
        odd = odd[row[odd] < 0]
        if len(odd):
            c = code[odd]
            context, tail = self._find(self.keys3, c >> np.uint32(8)), self._find(self.keys3, c & np.uint32(0xFFFFFF))
            below = self.cost1[c & 0xFFFF] + self.escape2[(c >> np.uint32(8)) & 0xFFFF]
            if len(self.keys3):
                below = np.where((tail >= 0)[:, None], self.cost2[tail], below)
                below = below + np.where((context >= 0)[:, None], self.escape3[context], 0)
            cost[odd] = below
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths + 3) - (lengths + 3)
        edges = np.stack([starts, starts + lengths], 1).ravel()
        sums = np.add.reduceat(np.concatenate([cost, np.zeros((1, cost.shape[1]), np.float32)]), np.minimum(edges, len(cost)), axis=0, dtype=np.float64)[::2]
        sums[lengths == 0] = 0
        return sums


def sample(docs: DataFrame, learn: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[bytes]]:
    """About per_language whole labelled texts for each language (all where there are fewer), chosen by a hash of doc_id and text."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)).alias("h"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return {}
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.col("h") < int(1_000_000 * min(1.0, per_language / n)) + 1))
    rows = labelled.where(chosen).select("lang", "text").collect()
    out: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for r in sorted(rows, key=lambda r: (r["lang"], r["text"])):
        out[r["lang"]].append(r["text"].encode())
    return out


def identify(docs: DataFrame, model: PPM, *, group_bytes: int = 1 << 19) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and bits_per_byte to docs; only the column text is looked at.

    Null texts and texts without a letter, and all texts if the model knows no language, get ``und`` and score 0. Ties go to the
    language that sorts first. Texts of any length are scored whole. Columns of these names in docs are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: it grows with the alphabet and the languages, not with the corpus
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    text_at = kept.index("text")
    source = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            texts = batch.column(text_at).cast(pa.large_binary() if pa.types.is_large_string(batch.column(text_at).type) else pa.binary())
            n = batch.num_rows
            lang, score, rate = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
            group: list[tuple[int, bytes]] = []
            size = 0

            def flush() -> None:
                nonlocal size
                if group:
                    bits = ppm.bits([t for _, t in group])
                    best = bits.argmin(1)
                    length = np.array([len(t) for _, t in group])
                    apart = (bits - bits.min(1)[:, None]) / length[:, None] * np.minimum(length, EVIDENCE_BYTES)[:, None]
                    sure = 1 / np.exp2(-np.minimum(apart, 1000)).sum(1)
                    for (i, _), k, s, r in zip(group, best, sure, bits.min(1) / length):
                        lang[i], score[i], rate[i] = ppm.languages[k], s, r
                    group.clear()
                    size = 0

            if ppm.languages:
                for i, t in enumerate(texts):
                    raw = t.as_py()
                    if raw and LETTER.search(raw.decode("utf-8", "replace")):
                        group.append((i, raw))
                        size += len(raw)
                        if size >= group_bytes:
                            flush()
                flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=[*kept, "lang_pred", "score", "bits_per_byte"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields), "lang_pred string, score double, bits_per_byte double"])
    return source.mapInArrow(lean(run), schema)


def held_out() -> Column:
    """True for documents that nothing is learnt from; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts all of them."""
    return identify(docs, PPM.fit(sample(docs, ~held_out())))
