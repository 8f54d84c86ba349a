"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles. Two documents A, B with Jaccard similarity of at least 3/4 differ in at most
d = floor((|A| + |B|) / 7) shingles. Shingles are dealt by hash over the parts of a sketch (as many for all documents of a size band, fewer
than shingles in large documents); each part is the XOR of its shingles' hashes. A differing shingle changes one part, so of the non-empty
parts of A at most d differ from B's. In one global order of parts, the first l that they share are therefore among the first d + l of A and
of B. Those are the join keys, with l a fixed share of the size, so a document that shares fewer than l keys with all others together is
similar to none. The order puts parts of frequent shingles last, and parts of several shingles before those of one, as these hardly meet by
chance; it changes the work but never the result.

Candidates are then held against a parity bit sketch of 4 to 8 bits a shingle: the Hamming distance of two sketches is at most the symmetric
difference, so pairs beyond d can be dropped. What is left is verified on the sets themselves.

Only connectivity is asked for, so not all pairs are made: documents with equal sets are one class; in each key's
group all classes are first held against a few of them. After that few classes are left that share enough keys with a larger component than
their own; these are held against all of it, block by block of sketches, and only pairs that the sketches allow are verified: first
a few for each class, then all that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import lean, materialize, settle
from lodestone.llm.components import components
from lodestone.llm.shingles import hashed_rows, mix, shingle_set

#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 75, 100
SHINGLE = 5
#: Keys that similar documents share at least: one in this many of the smaller one's shingles.
SHARED = 16
#: Counters of shingle frequency, and the times the mean beyond which a worker reports one.
HOT_BUCKETS = 1 << 18
#: Classes of a key group that all others in it are held against at first, and rows of a group that are looked at together.
HUBS, HELD = 3, 200_000
#: Members of a hub's group that one task verifies together.
SALT = 512
#: Classes in a block, and shingles of all of them: a sketch has up to a byte for each.
BLOCK, BLOCK_SHINGLES = 2048, 32_000_000
#: Classes that are held against a block at a time, and those of one component's neighbours that one task gets, about.
CHUNK, SLICE = 1024, 4096
#: Components in a group up to which classes are held against whole components; in groups of more, all classes are held against each other.
FEW = 16
#: Ids up to which (4 MB) a set of documents is looked up by broadcasting their ids; for more the texts are shuffled.
BROADCAST_IDS = 500_000
#: Candidates of one class, outside its component, that are verified in turn. The last takes all that are left.
RANKS = (2, float("inf"))


def max_difference(a: int, b: int) -> int:
    """Largest symmetric difference of sets of these sizes that are still similar."""
    return (DENOMINATOR - NUMERATOR) * (a + b) // (DENOMINATOR + NUMERATOR)


def largest_partner(n: int) -> int:
    return n * DENOMINATOR // NUMERATOR


def shared_keys(n: int) -> int:
    """Keys in common that are looked for by a set of this size."""
    return max(1, n // SHARED)


def band(n: int) -> tuple[int, int]:
    """Upper size of n's band and its number of parts. Sets of up to 16 have parts of their own for all shingles.

    A set of n shingles fills more than d + shared_keys(n) parts: their expected number lies at least six standard deviations above that.
    """
    if n <= 16:
        return 16, 1 << 32
    upper = 64
    while upper < n:
        upper *= 4
    return upper, {64: 96, 256: 192}.get(upper, upper * 5 // 8)


def size_code(n: int) -> int:
    """n, rounded down, in 16 bits that sort like it: 4 of exponent, 12 of mantissa. Sizes below 4096 are exact."""
    exponent = min(max(0, n.bit_length() - 12), 15)
    return exponent << 12 | min(n >> exponent, 4095)


def size_bounds(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest size with these codes."""
    exponent, mantissa = code >> 12, code & 4095
    most = ((mantissa + 1) << exponent) - 1
    return mantissa << exponent, np.where(code == 0xFFFF, np.int64(1) << 55, most)


def bit_sketch(found: np.ndarray) -> bytes:
    """Parity of the shingles at each of 4n to 8n bits (a power of two, 64 at least)."""
    bits = 64
    while bits < 4 * len(found):
        bits *= 2
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance; the longer sketch is folded to the length of the shorter."""
    x, y = (np.frombuffer(s, np.uint64) for s in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def join_keys(found: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """48-bit keys of a sorted set in its own band and, if a larger partner can be in the next, there too."""
    n, most = len(found), largest_partner(len(found))
    d = max_difference(n, most)
    if not d:
        return np.zeros(0, np.int64)  # similar sets of this size are equal
    upper, parts = band(n)
    size = d + shared_keys(n)
    out = []
    for upper, parts in [(upper, parts)] + ([band(upper + 1)] if most > upper else []):
        part = ((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first, count = _sized(np.concatenate([[True], part[1:] != part[:-1]]))
        word = mix(np.bitwise_xor.reduceat(found, first) + np.uint64(upper))
        level = np.minimum.reduceat(hot[(found & np.uint64(len(hot) - 1)).astype(np.int64)], first).astype(np.uint64)
        order = word >> np.uint64(16) | (3 - np.minimum(count, 3)).astype(np.uint64) << np.uint64(48) | level << np.uint64(56)
        keep = np.partition(order, size - 1)[:size] if len(order) > size else order
        out.append((keep & np.uint64((1 << 48) - 1)).astype(np.int64))
    return np.concatenate(out)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """doc_id and set of each row of (doc_id, text)."""
    ids = batch.column(0).to_pylist()
    for i, words in hashed_rows(batch.column(1), lower=True):
        yield ids[i], shingle_set(words, SHINGLE)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2, sketch, text_key) per document, and rows with n null that carry counts of frequent shingles: bucket in d1, count in d2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(HOT_BUCKETS, np.int64), 0
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.binary()), ("text_key", pa.int64())])
        for batch in batches:
            rows, group = [], []
            for (doc_id, found), text_key in zip(_sets(batch), batch.column(2).to_pylist()):
                rows.append((doc_id, len(found), *class_of(found), bit_sketch(found) if len(found) else None, text_key))
                group.append(found)
                if len(rows) == 2000:
                    total += _count(counts, group)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, group = [], []
            if rows:
                total += _count(counts, group)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        mean = total / HOT_BUCKETS
        often = np.flatnonzero(counts > 3 * mean + 8)
        if len(often):
            none = pa.nulls(len(often), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(often), pa.array(counts[often]), pa.nulls(len(often), pa.binary()), none], schema=schema)

    return docs.select("doc_id", "text", "text_key").mapInArrow(lean(run), "doc_id long, n long, d1 long, d2 long, sketch binary, text_key long")


def _count(counts: np.ndarray, group: list[np.ndarray]) -> int:
    joined = np.concatenate(group)
    counts += np.bincount((joined & np.uint64(HOT_BUCKETS - 1)).astype(np.int64), minlength=HOT_BUCKETS)
    return len(joined)


def _hot_levels(described: DataFrame) -> np.ndarray:
    """0 for most buckets, else the power of two of the count that workers reported (at most HOT_BUCKETS rows)."""
    levels = np.zeros(HOT_BUCKETS, np.uint8)
    for r in described.where("n is null").groupBy("d1").agg(F.sum("d2").alias("c")).collect():
        levels[r["d1"]] = min(int(r["c"]).bit_length(), 63)
    return levels


def key_rows(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, cls) of all classes, the key with the class's size code in its lowest 16 bits; a class that several tasks meet comes from each."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # HOT_BUCKETS bytes

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        levels = shared.value
        for batch in batches:
            keys, classes, size = [], [], 0
            for _, found in _sets(batch):
                cls = class_of(found)[0]
                if cls in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(cls)
                keys.append(join_keys(found, levels) << 16 | size_code(len(found)))
                classes.append(cls)
                size += len(keys[-1])
                if size > 200_000:
                    yield _key_batch(keys, classes)
                    keys, classes, size = [], [], 0
            if size:
                yield _key_batch(keys, classes)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(lean(emit), "key long, cls long")


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int | None]]:
    """Of rows (key, cls) sorted by both, without repeats and in whole groups of a key: the key without and with its size code, the code, the class; last, the key
    of a group of over ``most`` rows, which comes in several stretches.

    A key's classes are parted where the next one is too large to be similar to the one before it, except in such long groups.
    """
    held, long = None, None

    def split(coded: np.ndarray, cls: np.ndarray):
        fresh = np.concatenate([[True], (coded[1:] != coded[:-1]) | (cls[1:] != cls[:-1])])
        coded, cls = coded[fresh], cls[fresh]
        key, code = (coded.view(np.uint64) >> np.uint64(16)).view(np.int64), coded & 0xFFFF
        low, high = size_bounds(code)
        apart = (DENOMINATOR * high[:-1] < NUMERATOR * low[1:]) & (key[1:] != (-1 if long is None else long))
        first, size = _sized(np.concatenate([[True], (key[1:] != key[:-1]) | apart]))
        keep = (size > 1) | (key[first] == (-1 if long is None else long))
        kept = np.repeat(keep, size)
        return coded[kept], key[kept], code[kept], cls[kept], size[keep], long

    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        key = columns[0].view(np.uint64) >> np.uint64(16)
        if not len(key):
            continue
        whole = int(np.searchsorted(key, key[-1]))  # the last group may go on
        if len(key) - whole > most:
            whole, long = len(key), int(key[-1])
        if whole:
            yield split(*(c[:whole] for c in columns))
        held = [c[whole:] for c in columns]
    if held is not None and len(held[0]):
        yield split(*held)


def _sized(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of each group, from the rows that begin one."""
    first = np.flatnonzero(starts)
    return first, np.diff(np.append(first, len(starts)))


def _by_key(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows (key, cls) of a key together, ordered by size and class."""
    return rows.select("key", "cls").repartition(partitions, F.shiftrightunsigned("key", 16)).sortWithinPartitions("key", "cls")


def shared_rows(rows: DataFrame, partitions: int) -> DataFrame:
    """(key, cls) of keys that two classes of similar size have at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for coded, _, _, cls, _, _ in _stretches(batches, HELD):
            if len(coded):
                yield pa.RecordBatch.from_arrays([pa.array(coded), pa.array(cls)], names=["key", "cls"])

    return _by_key(rows, partitions).mapInArrow(lean(run), "key long, cls long")


def sharing_enough(shared: DataFrame) -> DataFrame:
    """The rows of classes that have as many shared keys as one pair of similar documents needs. The size of the smallest partner decides how many."""
    n = F.expr("shiftleft(key & 4095, cast(shiftright(key, 12) & 15 as int))")
    return shared.withColumn("c", F.count("*").over(Window.partitionBy("cls"))).where(F.col("c") >= _need(n)).select("key", "cls")


def _need(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.floor(n * NUMERATOR / DENOMINATOR) / SHARED)).cast("long")


def grouped(rows: DataFrame, partitions: int) -> DataFrame:
    """(grp, cls, n, h0 .. h2, keys): the groups of (key, cls), those of the same classes only once, with the number of their keys.

    The hubs are the group's first classes in HUBS orders that are the same for all groups; a group of over HELD rows has hubs for each stretch of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, code, cls, size, long in _stretches(batches, HELD):
            # a long group's stretch ends with its key, other groups are whole
            if not len(key):
                continue
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            group = np.repeat(np.arange(len(size)), size)
            name = mix(np.add.reduceat(mix(cls.view(np.uint64)), first) + size.astype(np.uint64))
            if long is not None:
                name = np.where(key[first] == long, mix(key[first].view(np.uint64)), name)
            hubs = []
            for turn in range(HUBS):
                order = mix(cls.view(np.uint64) + np.uint64(turn + 1))
                at = np.flatnonzero(order == np.minimum.reduceat(order, first)[group])
                hub = np.empty(len(first), np.int64)
                hub[group[at]] = cls[at]
                hubs.append(hub[group])
            columns = (name.view(np.int64)[group], cls, size_bounds(code)[0], *hubs)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["grp", "cls", "n", *(f"h{k}" for k in range(HUBS))])

    out = _by_key(rows, partitions).mapInArrow(lean(run), "grp long, cls long, n long, " + ", ".join(f"h{k} long" for k in range(HUBS)))
    return out.groupBy("grp", "cls").agg(F.first("n").alias("n"), *(F.min(f"h{k}").alias(f"h{k}") for k in range(HUBS)), F.count("*").alias("keys"))


def _key_batch(keys: list[np.ndarray], classes: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(classes, np.int64), [len(k) for k in keys]))], names=["key", "cls"])


def _prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(hub, member) of those class pairs (a, b) that sizes and bit sketches allow."""
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"{s}_n"), F.col("sketch").alias(f"{s}_sketch"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = both.where(f"least(a_n, b_n) * {DENOMINATOR} >= greatest(a_n, b_n) * {NUMERATOR}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (batch.column(k) for k in range(6))
            ok = [sketch_distance(p.as_py(), q.as_py()) <= max_difference(i, j) for p, q, i, j in zip(x, y, n.to_pylist(), m.to_pylist())]
            kept = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(kept), b.filter(kept)], names=["hub", "member"])

    return sized.select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(lean(run), "hub long, member long")


def class_of(found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set; the first half is its class."""
    one, two = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
    return int(one), int(two)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(cls, items) of the documents in ``ids`` (doc_id): 48 bits of each shingle's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for _, found in _sets(batch):
                rows.append((class_of(found)[0], found.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()))
                size += len(rows[-1][1])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["cls", "items"])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["cls", "items"])

    few = ids.count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(lean(run), "cls long, items binary")


def verify(sets: DataFrame, pairs: DataFrame, partitions: int) -> DataFrame:
    """The pairs (hub, member) of classes whose sets (cls, items) are similar, as (a, b).

    A member's set goes to its hubs; a hub's set goes to as many tasks as its members need, so no task holds more than one hub's set and
    one member's at a time.
    """
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    own = sets.join(salts, sets["cls"] == salts["hub"]).select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"), "items")
    to = pairs.join(salts, "hub").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int")).select("hub", "salt", "member")
    sent = own.union(sets.join(to, sets["cls"] == to["member"]).select("hub", "salt", "member", "items"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = lambda raw: np.sort(np.pad(np.frombuffer(raw, np.uint8).reshape(-1, 6), ((0, 0), (0, 2))).view(np.uint64).ravel())
        at, own = None, []
        for batch in batches:
            left, right = [], []
            for hub, salt, member, items in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if (hub, salt) != at:
                    at, own = (hub, salt), []
                found = unpack(items.as_py())
                if member is None:
                    own.append(found)
                    continue
                for x in own:
                    both = np.sort(np.concatenate([found, x]))
                    same = int((both[1:] == both[:-1]).sum())
                    if DENOMINATOR * same >= NUMERATOR * (len(both) - same):
                        left.append(hub)
                        right.append(member)
                        break
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return sent.repartition(partitions, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first()).mapInArrow(lean(compare), "a long, b long")


#: What a class is in a unit, in the order in which they come: held in the block, held in it and against it, held against it.
MEMBER, BOTH, AGAINST = 0, 1, 2


class Sketched:
    """Classes with their labels, sizes and sketches, as arrays by sketch length."""

    def __init__(self, rows: list[tuple]):
        cls, label, n, self.sketches = zip(*rows)
        self.cls, self.label, self.n = (np.array(c, np.int64) for c in (cls, label, n))
        self.width = np.array([len(s) for s in self.sketches])

    def words(self, rows: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(self.sketches[i] for i in rows), np.uint64).reshape(len(rows), -1)


def _fold(x: np.ndarray) -> np.ndarray:
    return x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]


def allowed_pairs(one: Sketched, two: Sketched, most: float) -> set[tuple[int, int]]:
    """Pairs across the two with different labels that sizes and sketches allow: for each class of the first, the first ``most`` in a fixed order. Has (0, 0) if any were left out."""
    found_i, found_j = [], []
    for w in np.unique(one.width):
        for v in (w // 2, w, 2 * w):
            small, large = np.flatnonzero(one.width == w), np.flatnonzero(two.width == v)
            if not len(large):
                continue
            x, y = one.words(small), two.words(large)
            x, y = (_fold(x) if x.shape[1] > y.shape[1] else x), (_fold(y) if y.shape[1] > x.shape[1] else y)
            step = max(1, 500_000 // (len(large) * x.shape[1]))
            for k in range(0, len(small), step):
                i = small[k : k + step]
                distance = np.bitwise_count(x[k : k + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int32)
                total, least = one.n[i][:, None] + two.n[large][None, :], np.minimum(one.n[i][:, None], two.n[large][None, :])
                ok = (distance <= (DENOMINATOR - NUMERATOR) * total // (DENOMINATOR + NUMERATOR)) & (DENOMINATOR * least >= NUMERATOR * (total - least))
                a, b = np.nonzero(ok & (one.label[i][:, None] != two.label[large][None, :]))
                found_i.append(i[a])
                found_j.append(large[b])
    if not sum(map(len, found_i)):
        return set()
    x, y = np.concatenate(found_i), np.concatenate(found_j)
    order = np.lexsort((mix(one.cls[x].view(np.uint64) ^ mix(two.cls[y].view(np.uint64))), x))
    x, y = x[order], y[order]
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    chosen = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x)))) < most
    a, b = one.cls[x[chosen]], two.cls[y[chosen]]
    found = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    return found if chosen.all() else found | {(0, 0)}


def _blocks(rows: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _cross_pairs(groups: DataFrame, labelled: DataFrame, classes: DataFrame, partitions: int, most: float) -> DataFrame:
    """(a, b) of classes that aren't connected yet, as far as keys, sizes and sketches allow; ``most`` of them for a class and a block.

    In groups of few components, of two components the smaller one's classes are looked at: those that share enough keys with the larger one as a whole are held
    against all of its classes, so sketches are sent once for each component, not for each key. In groups of more components all classes are held against each
    other, a group beyond a block's size in several blocks. A pair that shares enough keys shares them in groups of the first kind, or has one in a group of the second.
    """
    rows = groups.select("grp", "cls", "n", "keys").join(labelled.select("cls", "label", "size", "blocks"), "cls")
    kinds = rows.groupBy("grp").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("rows"), F.sum("n").alias("shingles")).where("labels > 1")
    rows = rows.join(kinds, "grp")
    few, many = rows.where(f"labels <= {FEW}"), rows.where(f"labels > {FEW}")
    there = few.select("grp", F.col("label").alias("other"), F.col("size").alias("larger"), F.col("blocks").alias("there")).distinct()
    beside = few.select("grp", "cls", "n", "keys", "label", "size").join(there, "grp").where("larger > size or larger = size and other > label")
    wanted = beside.groupBy("cls", "other").agg(F.sum("keys").alias("c"), F.first("n").alias("n"), F.first("there").alias("there"), F.first("label").alias("label")).where(F.col("c") >= _need(F.col("n")))
    wanted = materialize(wanted.select("cls", "label", "other", "there"), "wanted")
    targets = wanted.groupBy("other").agg(F.first("there").alias("there"), F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda c: F.pmod(F.xxhash64("cls"), F.col(c)).cast("int")
    minors = wanted.join(targets.select("other", "slices"), "other").select("other", upto("there").alias("unit"), one("slices").alias("slice"), F.lit(AGAINST).alias("role"), "cls", "label")
    members = labelled.join(targets, labelled["label"] == targets["other"]).select("other", one("there").alias("unit"), upto("slices").alias("slice"), F.lit(MEMBER).alias("role"), "cls", "label")
    many = many.withColumn("many", _blocks("rows", "shingles"))
    whole = many.where("many = 1").select(F.col("grp").alias("other"), F.lit(0).alias("unit"), F.lit(-1).alias("slice"), F.lit(BOTH).alias("role"), "cls", "label")
    dealt = many.where("many > 1").withColumn("own", one("many")).withColumn("unit", upto("many"))
    dealt = dealt.select(F.col("grp").alias("other"), "unit", F.lit(-1).alias("slice"), F.when(F.col("unit") == F.col("own"), BOTH).otherwise(AGAINST).alias("role"), "cls", "label")
    units = minors.union(members).union(whole).union(dealt).join(classes.select("cls", "n", "sketch"), "cls").select("other", "unit", "slice", "role", "cls", "label", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, chunk, block = None, [], [], None
        found: set[tuple[int, int]] = set()

        def compare() -> None:
            nonlocal block, chunk
            if members and chunk:
                block = block or Sketched(members)
                found.update(allowed_pairs(Sketched(chunk), block, most))
            chunk = []

        def end() -> None:
            nonlocal chunk
            compare()
            for k in range(0, len(both), CHUNK):
                chunk = both[k : k + CHUNK]
                compare()

        both: list[list] = []
        for batch in batches:
            for other, unit, part, role, *row in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if (other, unit, part) != at:
                    end()
                    at, members, both, block = (other, unit, part), [], [], None
                if role != AGAINST:
                    members.append(row)
                    if role == BOTH:
                        both.append(row)
                    continue
                chunk.append(row)
                if len(chunk) >= CHUNK:
                    compare()
            if len(found) > 100_000:
                yield _pair_batch(found)
                found.clear()
        end()
        if found:
            yield _pair_batch(found)

    keys = ["other", "unit", "slice"]
    return units.repartition(partitions, *keys).sortWithinPartitions(*keys, "role").mapInArrow(lean(run), "a long, b long").distinct()


def _pair_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*sorted(found))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs (doc_id, text): see near_duplicate_rows."""
    return near_duplicate_rows(docs).select("doc_id", "n_shingles", "component_id")


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, component, text_key) per row of docs (doc_id, text; other columns are dropped).

    component_id is the smallest doc_id that can be reached by links, the document's own included. Documents without a shingle (null, empty or blank
    text) are linked with nothing. Repeated rows are copies of each other. Rows with a null doc_id get their n_shingles and a null
    component. If a doc_id repeats with different texts, each row goes by its own text: ``component`` tells components with the same component_id apart, and
    text_key, a checksum of the text, tells such rows apart. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    described = materialize(describe(docs), "described")
    rows = described.where("n is not null")
    classes = rows.where("n > 0 and doc_id is not null").groupBy(F.col("d1").alias("cls"), "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    shared = materialize(shared_rows(key_rows(docs, _hot_levels(described)), partitions), "shared")
    settle(spark)
    groups = materialize(grouped(sharing_enough(shared), partitions), "groups")
    settle(spark, shared)
    done, sets, labels, tested = [groups], None, None, None

    def kept(df: DataFrame, name: str) -> DataFrame:
        done.append(materialize(df, name))
        return done[-1]

    def settle_pairs(pairs: DataFrame) -> None:
        """Verifies pairs (hub, member) of classes and merges components."""
        nonlocal sets, labels, tested
        pairs = kept(pairs if tested is None else pairs.join(tested, ["hub", "member"], "left_anti"), "pairs")
        if tested is not None and pairs.isEmpty():
            return
        cls = pairs.select(F.explode(F.array("hub", "member")).alias("cls")).distinct()
        ids = kept((cls if sets is None else cls.join(sets, "cls", "left_anti")).join(classes.select("cls", "rep"), "cls").select(F.col("rep").alias("doc_id")).distinct(), "ids")
        if sets is None or not ids.isEmpty():
            new = kept(sets_of(docs, ids), "sets")
            sets = new if sets is None else sets.union(new)
        links = kept(verify(sets, pairs, partitions), "links")
        settle(spark)
        labels = components(links if labels is None else links.union(labels.select("node", "label")))
        tested = pairs if tested is None else tested.union(pairs)

    def labelled() -> DataFrame:
        """(cls, label, size, blocks) of the classes in groups: their component, its classes and the blocks these make."""
        rows = groups.groupBy("cls").agg(F.first("n").alias("n")).join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        rows = rows.select("cls", "n", F.coalesce("label", "cls").alias("label"))
        sizes = rows.groupBy("label").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
        return kept(rows.join(sizes, "label").select("cls", "label", "size", _blocks("size", "shingles").alias("blocks")), "labelled")

    hubs = groups.select(F.explode(F.array(*(f"h{k}" for k in range(HUBS)))).alias("a"), F.col("cls").alias("b")).where("a <> b").distinct()
    settle_pairs(_prune(hubs, classes))
    for most in RANKS:
        crossing = kept(_cross_pairs(groups, labelled(), classes, partitions, most), "crossing")
        settle_pairs(crossing.where("a <> b").select(F.col("a").alias("hub"), F.col("b").alias("member")))
        if crossing.where("a = 0 and b = 0").isEmpty():
            break
    linked = labels.withColumnRenamed("node", "cls").join(classes.select("cls", "rep"), "cls")
    least = linked.groupBy("label").agg(F.min("rep").alias("least"))
    linked = materialize(linked.join(least, "label").select("cls", "label", "least"), "linked")
    settle(spark, *done)
    final = classes.join(linked, "cls", "left").select(F.col("cls").alias("d1"), "d2", F.coalesce("least", "rep").alias("least"), F.coalesce("label", "cls").alias("label"))
    named = F.col("doc_id").isNotNull()
    return (
        rows.select("doc_id", "n", "d1", "d2", "text_key")
        .join(final, ["d1", "d2"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(named, F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))).alias("component_id"),
            F.when(named & (F.col("n") > 0), F.col("label")).alias("component"),
            "text_key",
        )
    )
