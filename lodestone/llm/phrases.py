"""Phrase collocation mining by hierarchical pair naming.

Texts are read once, into chunks: a chunk is a sequence of small numbers, its own dictionary's, with -1 where a piece ends. A level counts each
chunk's distinct names and sums them over all chunks; names that are frequent enough get an id, which goes back to the chunks that have them. Adjacent
ids are the names of the next level, so a phrase of k words is a pair of phrases of k - 1 words. Words are joined and summed as rows. Pairs are so many that they travel packed: a chunk's
distinct pairs, dealt by a hash into as many buckets as there are chunks, so that a bucket holds no more pairs on average than a chunk, however large the corpus is. The pair is also its two parents: prefixes and suffixes, of which cuts
need the counts, come down the left and the right parents, and a phrase is a part of a longer one if it is a parent of it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import lean, materialize, settle
from lodestone.llm.shingles import mix

#: The contract: least count, words of a phrase at most, share of a longer phrase that makes a part of it superfluous (in hundredths), phrases to a language.
LEAST, LONGEST, COVERED, FIRST = 30, 4, 80, 2000
SCALE = 2_000_000
UNKNOWN = "und"
#: Words of a chunk, and bytes of text that are taken apart together.
CHUNK, SLICE = 1 << 21, 1 << 20

_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def slices(raw: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A text in lower case with its pieces' ends marked, cut at such ends after every ``size`` bytes."""
    raw = raw.translate(_TABLE)
    begin = 0
    while len(raw) - begin > size:
        end = raw.find(_BREAK, begin + size)
        if end < 0:
            break
        yield raw[begin:end]
        begin = end + 1
    yield raw[begin:]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of (lang, text as bytes)."""
    number = TaskContext.get().partitionId() << 32
    counter, names, parts, held = count(), {}, [], 0

    def chunk() -> pa.RecordBatch:
        total = next(counter)
        langs, words = [None] * total, [None] * total
        for lang, known in names.items():
            for word, k in known.items():
                if k >= 0:
                    langs[k], words[k] = lang, word
        seq = np.concatenate(parts)
        n = np.bincount(seq[seq >= 0], minlength=total)
        lists = [pa.array([langs], pa.list_(pa.string())), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([n.tolist()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([seq.tobytes()], pa.binary())], names=["chunk", "langs", "words", "counts", "seq"])

    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = raw.as_py()
            if not raw:
                continue
            known = names.get(lang)
            if known is None:
                known = names[lang] = defaultdict(counter.__next__)
                known[_BREAK] = -1
            for some in slices(raw):
                words = some.replace(_BREAK, b" \xff ").split(b" ")
                words = list(filter(None, words))
                words.append(_BREAK)
                parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                held += len(words)
                if held >= CHUNK:
                    yield chunk()
                    number += 1
                    counter, names, parts, held = count(), {lang: None}, [], 0
                    known = names[lang] = defaultdict(counter.__next__)
                    known[_BREAK] = -1
    if held:
        yield chunk()


def _packed(left: np.ndarray, right: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in ascending order, with their places in the chunk and their counts."""
    raw = np.diff(left, prepend=np.int64(0)).tobytes() + right.tobytes() + at.astype(np.int32).tobytes() + n.astype(np.int32).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, size: int) -> tuple[np.ndarray, ...]:
    raw = pa.decompress(raw, decompressed_size=24 * size, codec="zstd", asbytes=True)
    wide, narrow = np.frombuffer(raw, np.int64, 2 * size), np.frombuffer(raw, np.int32, 2 * size, 16 * size)
    return np.cumsum(wide[:size]), wide[size:], narrow[:size], narrow[size:]


def _paired(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The next level of chunks (chunk, seq, at, ids): bucket -1: the sequence of pairs; other buckets: the distinct pairs that fall into them, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw, at, ids in zip(*batch.columns):
                seq = np.frombuffer(raw.as_py(), np.int32)
                found = ids.values.flatten().to_numpy(zero_copy_only=False)
                names = at.values.flatten().to_numpy(zero_copy_only=False)[np.argsort(found)]
                found = np.sort(found)
                local = np.full(int(seq.max(initial=-1)) + 2, -1, np.int64)  # the last is for -1
                local[names] = np.arange(len(names))
                here = local[seq]
                ok = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
                pairs, where, n = np.unique(here[ok] * max(1, len(names)) + here[ok + 1], return_inverse=True, return_counts=True)
                out = np.full(len(seq), -1, np.int32)
                out[ok] = where
                left, right = np.divmod(pairs, max(1, len(names)))
                left, right = found[left], found[right]
                key = (mix(left.view(np.uint64) + mix(right.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                key, left, right, n = key[order], left[order], right[order], n[order]
                cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(key))
                blobs = [_packed(left[b:e], right[b:e], order[b:e], n[b:e]) for b, e in zip(cuts.tolist(), ends.tolist())]
                rows = [pa.array([-1, *key[cuts].tolist()], pa.int64()), pa.array([chunk.as_py()] * (len(blobs) + 1)), pa.array([0, *(ends - cuts).tolist()], pa.int64()), pa.array([out.tobytes(), *blobs], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=["bucket", "chunk", "size", "data"])

    return run


def _summed(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of whole buckets: the pairs that occur ``least`` times (chunk -1) and, by chunk, the places and ids of those it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, parts = [], []
        for batch in batches:
            for chunk, size, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "size", "data"))):
                chunks.append(np.full(size, chunk))
                parts.append(_unpacked(data, size))
        if not parts:
            return
        left, right, at, n = (np.concatenate(x) for x in zip(*parts))
        chunk = np.concatenate(chunks)
        order = np.lexsort((right, left))
        left, right, at, n, chunk = left[order], right[order], at[order], n[order].astype(np.int64), chunk[order]
        new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        first = np.flatnonzero(new)
        total = np.add.reduceat(n, first)
        name = np.where(total >= least, np.cumsum(total >= least) - 1, -1)
        kept = first[total >= least]
        ids = (TaskContext.get().partitionId() << 36) + np.arange(len(kept), dtype=np.int64)
        of = lambda *x: [pa.array([v], pa.list_(pa.int64())) for v in x]
        none = np.zeros(0, np.int64)
        names = ["chunk", "at", "ids", "lefts", "rights", "counts"]
        yield pa.RecordBatch.from_arrays([pa.array([-1]), *of(none, ids, left[kept], right[kept], total[total >= least])], names=names)
        each = name[np.cumsum(new) - 1]
        use = np.flatnonzero(each >= 0)
        use = use[np.argsort(chunk[use], kind="stable")]
        borders = np.flatnonzero(np.diff(chunk[use])) + 1
        for some in np.split(use, borders) if len(use) else ():
            yield pa.RecordBatch.from_arrays([pa.array([int(chunk[some[0]])]), *of(at[some].astype(np.int64), ids[each[some]], none, none, none)], names=names)

    return run


def _next_level(chunks: DataFrame, back: DataFrame, buckets: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of pairs, (chunk, at, ids) of their frequent ones, and these (id, left, right, a). What is gathered by chunk is no more than a chunk's dictionary."""
    ids = back.groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("ids").alias("ids"))
    pairs = chunks.join(ids, "chunk").select("chunk", "seq", "at", "ids").mapInArrow(lean(_paired(buckets)), "bucket long, chunk long, size long, data binary")
    pairs = materialize(pairs, "pairs", "zstd")
    settle(chunks.sparkSession)
    dealt = pairs.where("bucket >= 0").repartition(buckets, "bucket")
    found = dealt.mapInArrow(lean(_summed(least)), "chunk long, at array<long>, ids array<long>, lefts array<long>, rights array<long>, counts array<long>")
    found = materialize(found, "found", "zstd")
    settle(chunks.sparkSession)
    level = found.where("chunk = -1").select(F.explode(F.arrays_zip("ids", "lefts", "rights", "counts")).alias("_x")).select(F.col("_x.ids").alias("id"), F.col("_x.lefts").alias("left"), F.col("_x.rights").alias("right"), F.col("_x.counts").alias("a"))
    following = pairs.where("bucket = -1").select("chunk", F.col("data").alias("seq"))
    for df, source in ((following, pairs), (level, found)):
        df._lodestone_path = source._lodestone_path
    return following, found.where("chunk >= 0").select("chunk", "at", "ids"), level


def grams(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for 1 to ``longest`` words, the phrases that occur ``least`` times: id, left, right (parents), a, lang, phrase, last (its last word), before and after: counts of its
    prefixes and suffixes, shortest first."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    chunks = materialize(rows.mapInArrow(lean(_chunked), "chunk long, langs array<string>, words array<string>, counts array<long>, seq binary"), "chunks", "zstd")
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("at", "_w"))
    named = each.select("chunk", "at", F.col("_w.langs").alias("lang"), F.col("_w.words").alias("word"), F.col("_w.counts").alias("n"))
    words = named.groupBy("lang", "word").agg(F.sum("n").alias("a"))
    words = materialize(words.where(F.col("a") >= least).withColumn("id", F.monotonically_increasing_id()), "words")
    totals = materialize(named.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    none = F.lit(None).cast("long")
    levels = [words.select("id", none.alias("left"), none.alias("right"), "a", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), *(F.array().cast("array<long>").alias(c) for c in ("before", "after")))]
    back = named.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.col("at").cast("long")).alias("at"), F.collect_list("id").alias("ids"))
    buckets = max(1, chunks.count())
    done = [chunks]
    chunks = chunks.select("chunk", "seq")
    for _ in range(2, longest + 1):
        chunks, back, counted = _next_level(chunks, back, buckets, least)
        settle(spark, *done)
        first = levels[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_head"), F.array_append("before", F.col("a")).alias("before"))
        second = levels[-1].select(F.col("id").alias("right"), "last", F.array_append("after", F.col("a")).alias("after"))
        level = counted.join(first, "left").join(second, "right")
        level = level.select("id", "left", "right", "a", "lang", F.concat_ws(" ", "_head", "last").alias("phrase"), "last", "before", "after")
        levels.append(materialize(level, "grams"))
        done = [chunks, counted]
    settle(spark, *done)
    return totals, levels


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    docs: lang (null: ``und``) and text (null: no word) of any length; other columns are ignored. Repeated rows count each time; equal scores go by count, then by the phrase's bytes.
    An empty table gives an empty result. A phrase's score is that of its worst cut, in whole SCALE-ths; sums and products are exact. Phrases that are part of one a word longer with COVERED hundredths of
    their count are dropped; still longer ones occur no more often than that one, so they need no look.
    """
    totals, levels = grams(docs, least=least, longest=longest)
    candidates = None
    for k in range(1, len(levels)):
        level = levels[k]
        if k + 1 < len(levels):
            above = levels[k + 1].select(F.explode(F.array("left", "right")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("_most"))
            level = level.join(above, "id", "left").where(f"_most IS NULL OR 100 * CAST(_most AS DECIMAL(20, 0)) < {COVERED} * CAST(a AS DECIMAL(20, 0))")
        cuts = [f"named_struct('score', CAST({SCALE} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0)) div (before[{c - 1}] + after[{k - c}]), 'k', {c}, 'l', before[{c - 1}], 'r', after[{k - c}])" for c in range(1, k + 1)]
        rows = level.select("lang", "phrase", "a", F.expr(f"array_min(array({', '.join(cuts)}))").alias("_cut"))
        candidates = rows if candidates is None else candidates.unionByName(rows)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = candidates.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
