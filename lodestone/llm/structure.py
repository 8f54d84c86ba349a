"""Conversation structure repair: the cheapest edits that bring a damaged conversation back to ``(s?(ua)+)?``.

A macro edit is a run of inserted turns and what becomes of the row after them. Its code (``D``, ``IIK``, ``K``, ...) is prefix-free, so audits with
as many macro edits compare as their sequences of codes do. A layer of the dynamic program (the rows so far) therefore needs no audit strings:
of each state it holds the cost, the rank of its audit among the layer's states and, for the way back, the state before.

What rows do to the four states is a 4 x 4 matrix of costs and ranks, and matrices of neighbours combine into one. So a conversation of any
length is solved in blocks of BLOCK rows, blocks of BLOCK blocks and so on; the way back goes down the same tree, and no task holds more than
BLOCK rows of a conversation at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import lean, materialize, settle

#: Bits of a position within its block.
BLOCK_BITS = 12
GAP = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 56
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. Inserts at the end by state.
STATES = 4
CLOSING = ("", "II", "I", "")
_INSERTED = (2, 2, 3, 2)
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
INITIALS = ("s", "u", "a", "")
#: Codes of macro edits in ASCII order. Inserts before a deletion are left out: after it they cost the same, lead to the same state and read smaller.
CODES = ("D", "IIK", "IIR", "IK", "IR", "K", "R")


@cache
def row_matrices() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, rank and code by class of row, state before and state after. Class: 4 * fault + initial; fault 0 none, 1 truncated, 2 to be deleted."""
    cost = np.full((12, STATES, STATES), NEVER, np.int64)
    code = np.full((12, STATES, STATES), len(CODES), np.int64)
    for fault in range(3):
        for who, initial in enumerate(INITIALS):
            for state in range(STATES):
                found = {}
                for k, name in enumerate(CODES):
                    at, inserts = state, name.count("I")
                    for _ in range(inserts):
                        at = _INSERTED[at]
                    price = inserts * INSERT
                    if name == "D":
                        after, price = state, DELETE
                    elif fault == 2:
                        continue
                    elif name.endswith("K"):
                        after, price = _KEPT[initial].get(at), price + TRUNCATED * (fault == 1)
                    else:
                        after, price = _INSERTED[at], price + REROLE + TRUNCATED * (fault == 1)
                    if after is not None:
                        found[after] = min(found.get(after, (NEVER, 0)), (price, k))
                for after, (price, k) in found.items():
                    cost[4 * fault + who, state, after], code[4 * fault + who, state, after] = price, k
    return cost, np.argsort(np.argsort(code, 2, kind="stable"), 2), code


def fold(cost: np.ndarray, rank: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of the matrices items[offsets[b]:offsets[b + 1]], for all b at once, layer by layer: (cost, rank) by b, and by item the best state before (entry, after)."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    n = len(order)
    best = np.full((n, STATES, STATES), NEVER, np.int64)
    best[:, range(STATES), range(STATES)] = 0
    ranks = np.tile(np.argsort(np.argsort(~np.eye(STATES, dtype=bool), 1, kind="stable"), 1), (n, 1, 1)).astype(np.int64)
    parents = np.zeros((len(cost), STATES, STATES), np.int8)
    active = n
    for layer in range(int(lengths.max()) if n else 0):
        while active and lengths[order[active - 1]] <= layer:
            active -= 1
        item = offsets[order[:active]] + layer
        keys = ((best[:active, :, :, None] + cost[item][:, None]) << 2) | ranks[:active, :, :, None]
        before = keys.argmin(2)
        parents[item] = before
        total = np.minimum(np.take_along_axis(keys, before[:, :, None], 2)[:, :, 0] >> 2, NEVER)
        place = np.take_along_axis(ranks[:active], before, 2) * STATES + rank[item[:, None, None], before, np.arange(STATES)]
        place[total >= NEVER] += STATES * STATES
        best[:active], ranks[:active] = total, np.argsort(np.argsort(place, 2, kind="stable"), 2)
    out_cost, out_rank = np.empty_like(best), np.empty_like(ranks)
    out_cost[order], out_rank[order] = best, ranks
    return out_cost, out_rank, parents


def trace(parents: np.ndarray, offsets: np.ndarray, entry: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before and after each item on the best way from entry to end."""
    before, after = np.zeros(len(parents), np.int64), np.zeros(len(parents), np.int64)
    lengths, at = np.diff(offsets), end.copy()
    for back in range(int(lengths.max()) if len(lengths) else 0):
        live = np.flatnonzero(lengths > back)
        item = offsets[live + 1] - 1 - back
        after[item] = at[live]
        before[item] = at[live] = parents[item, entry[live], at[live]]
    return before, after


def _items(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(cost, rank, offsets, class) of a column of blocks: of rows (class, deletions) or of blocks (matrix)."""
    flat = lists.flatten()
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    if flat.type.get_field_index("matrix") >= 0:
        both = np.array(flat.field("matrix").to_pylist(), np.int64).reshape(-1, 2, STATES, STATES)
        return both[:, 0], both[:, 1], offsets, None
    cost, rank, _ = row_matrices()
    kind = flat.field("class").to_numpy(zero_copy_only=False).astype(np.int64)
    deletions = flat.field("deletions").to_numpy(zero_copy_only=False)[:, None, None]
    return np.minimum(cost[kind] + DELETE * deletions, NEVER), rank[kind], offsets, kind


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cost, rank, offsets, _ = _items(batch.column("items"))
        done = fold(cost, rank, offsets)
        matrix = pa.array(np.stack(done[:2], 1).reshape(batch.num_rows, -1).tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), matrix], names=["conv_id", "block", "matrix"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cost, rank, offsets, kind = _items(batch.column("items"))
        parents = fold(cost, rank, offsets)[2]
        entry, end = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("entry", "end"))
        before, after = trace(parents, offsets, entry, end)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int64()))
        codes = row_matrices()[2][kind, before, after] if kind is not None else np.zeros(len(before), np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "block")), lists(before), lists(after), lists(codes)], names=["conv_id", "block", "before", "after", "codes"])


def _joined(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join by keys of which null equals null; the keys are the left side's."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(other, reduce(lambda a, b: a & b, on), how).drop(*(f"_{k}" for k in keys))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations rows (conv_id, turn, role, text; other columns are dropped) with the faults of the exercise, by crc32 of ``conv_id:turn`` modulo 20. Nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")), F.lit(20))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    out = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("times"), fault.alias("_fault"))
    return out.where("_fault <> 0").drop("_fault")


def _light(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one, without their text: conv_id, turn, role, digest, times, blank, cut, initial, and whether role and text come in an earlier turn (seen)."""
    last = F.right(F.rtrim(F.col("text"), F.lit(GAP)), F.lit(1))
    rows = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "times", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    rows = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("times").alias("times"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("_first"), F.count("*").alias("_turns")).where("_turns > 1")
    first = first.drop("_turns")
    seen = _joined(rows, first, "conv_id", "role", "digest", how="left")
    later = F.coalesce(F.col("_first") < F.struct(F.col("turn").isNotNull(), "turn"), F.lit(False))
    initial = F.substring("role", 1, 1)
    return seen.select(*rows.columns, later.alias("seen"), F.when(initial.isin(*INITIALS[:3]), initial).otherwise("").alias("initial"))


def _placed(light: DataFrame) -> DataFrame:
    """With pos, counted from 0 in each conversation: by turn (nulls first), role and the text's SHA-256. Rows are sorted in ranges, so a long conversation lies in many tasks."""
    order = ["conv_id", "turn", "role", "digest"]
    ranged = light.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("range", F.shiftright("place", 33)), "ranged")
    parts = ranged.groupBy("conv_id", "range").agg(F.min("place").alias("_from"), F.count("*").alias("_n"))
    window = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a conversation reaches into
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(window), F.lit(0)))
    out = _joined(ranged, parts, "conv_id", "range").select(*light.columns, (F.col("_before") + F.col("place") - F.col("_from")).alias("pos"))
    out = materialize(out, "placed")
    settle(light.sparkSession, ranged)
    return out


def _grouped(items: DataFrame, item: Column, *more: Column) -> DataFrame:
    """Blocks of at most 2 ** BLOCK_BITS neighbours: conv_id, block, items in order."""
    block = F.shiftright("at", BLOCK_BITS)
    return items.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", item.alias("item")))).getField("item").alias("items"), *more)


def _solved(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(conv_id, cost) and, by block of rows: conv_id, block, first row, end state, codes."""
    spark = rows.sparkSession
    must = F.col("blank") | F.col("seen")
    kind = F.when(must, 8).when(F.col("cut"), 4).otherwise(0) + F.array_position(F.array(*map(F.lit, INITIALS)), F.col("initial")).cast("int") - 1
    first = F.min(F.struct(F.col("turn").isNotNull().alias("named"), "turn", "role", "digest")).alias("first")
    tables = [materialize(_grouped(rows.withColumn("at", F.col("pos")), F.struct(kind.alias("class"), (F.col("times") - 1).alias("deletions")), first), "rows")]
    matrix = f"{key}, block long, matrix array<long>"
    sums = [materialize(tables[0].select("conv_id", "block", "items").mapInArrow(lean(_folded), matrix), "sums")]
    while not sums[-1].where("block > 0").isEmpty():
        tables.append(materialize(_grouped(sums[-1].withColumnRenamed("block", "at"), F.struct("matrix")), "blocks"))
        sums.append(materialize(tables[-1].mapInArrow(lean(_folded), matrix), "sums"))
    ends = F.array(*(F.struct((F.get("matrix", F.lit(s)) + INSERT * len(CLOSING[s])).alias("cost"), F.get("matrix", F.lit(STATES * STATES + s)).alias("rank"), F.lit(s).cast("long").alias("end")) for s in range(STATES)))
    top = sums[-1].select("conv_id", "block", F.array_min(ends).alias("best"))
    costs = top.select("conv_id", F.col("best.cost").alias("cost"))
    known = top.select("conv_id", "block", F.lit(0).cast("long").alias("entry"), F.col("best.end").alias("end"))
    states = f"{key}, block long, before array<long>, after array<long>, codes array<long>"
    for level in reversed(range(len(tables))):
        table = tables[level]
        found = _joined(table, known, "conv_id", "block").select("conv_id", "block", "items", "entry", "end").mapInArrow(lean(_traced), states)
        if level:
            each = found.select("conv_id", F.col("block").alias("_up"), F.posexplode(F.arrays_zip("before", "after")).alias("_k", "_s"))
            known = materialize(each.select("conv_id", (F.shiftleft("_up", BLOCK_BITS) + F.col("_k")).alias("block"), F.col("_s.before").alias("entry"), F.col("_s.after").alias("end")), "states")
    starts = tables[0].select("conv_id", "block", "first")
    codes = found.select("conv_id", "block", F.element_at("after", -1).alias("end"), "codes", F.col("before").alias("states"))
    codes = materialize(_joined(codes, starts, "conv_id", "block"), "codes")
    costs = materialize(costs, "costs")
    settle(spark, *tables, *sums)
    return costs, codes


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, each block's codes before its rows: the audit and the hash of what is left, one conversation after another. Texts go into the hash as they pass."""
    kind = None
    conv: object = batches  # equal to no id
    out: list[tuple] = []

    def close() -> None:
        if conv is not batches:
            insert(CLOSING[state])
            out.append((conv, "".join(audit), digest.hexdigest()))

    def put(line: str) -> None:
        nonlocal lines
        digest.update(("\n" if lines else "").encode() + line.encode())
        lines += 1

    def insert(run: str) -> None:
        nonlocal state
        for _ in run:
            put("assistant:" if state == 2 else "user:")
            state = _INSERTED[state]
        audit.append(run)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for ident, turn, role, mark, text, codes, states, times in zip(*(c.to_pylist() for c in batch.columns)):
            if ident != conv:
                close()
                conv, audit, digest, lines, state, row, known, at = ident, [], hashlib.sha256(), 0, 0, None, [], 0
            if codes is not None:
                known, at = list(zip(codes, states)), 0
                continue
            if (turn, role, mark) == row:  # an equal row again
                audit.append("D" * times)
                continue
            row = (turn, role, mark)
            code, state = known[at]
            at += 1
            name = CODES[code]
            insert(name[:-1])
            audit.append(name[-1])
            if name[-1] == "K":
                put(f"{role}:{text}")
                state = _KEPT[role[:1] if role[:1] in INITIALS else ""][state]
            elif name[-1] == "R":
                put(("assistant:" if state == 2 else "user:") + text)
                state = _INSERTED[state]
            audit.append("D" * (times - 1))
        if len(out) > 500:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.string(), pa.string()))], names=["conv_id", "audit", "repaired_sha256"])
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.string(), pa.string()))], names=["conv_id", "audit", "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, times: how often the row stands there): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand in the order of turn (nulls first), then role, then the text's SHA-256; equal rows are repeats. Roles other than system, user and assistant count by
    their first letter; others can only be deleted or get a new role. A null conv_id is a conversation of its own. Texts of any length are hashed whole.
    An empty table gives an empty result; other columns are dropped. Only what the contract asks of a whole conversation, its audit and
    the one SHA-256 over its text, passes through one task, as a stream of sorted rows.
    """
    spark = rows.sparkSession
    key = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    light = _placed(_light(rows))
    costs, codes = _solved(light, key)
    repeats = F.when(~F.col("blank"), F.col("times") - 1 + F.col("seen").cast("long")).otherwise(0)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = light.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("times")).otherwise(0)).alias("blank"),
        F.sum(repeats).alias("duplicate"),
        one(~F.col("blank") & ~F.col("seen") & F.col("cut")).alias("truncated"),
        F.sum(F.col("times") - 1).alias("_same"),
    )
    # each row with the initial before it: those of a block by a window, the last of the block before comes along
    pairs = light.select("conv_id", "pos", "initial", F.explode(F.when((F.col("pos") + 1) % (1 << BLOCK_BITS) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_next"))
    pairs = pairs.withColumn("block", F.shiftright("pos", BLOCK_BITS) + F.col("_next"))
    pair = F.concat(F.lag("initial").over(Window.partitionBy("conv_id", "block").orderBy("pos")), F.col("initial"))
    illegal = pairs.withColumn("pair", pair).where("_next = 0 and pair is not null").groupBy("conv_id").agg(one(~F.col("pair").isin("su", "ua", "au")).alias("_illegal"))
    texts = rows.withColumn("digest", F.sha2("text", 256)).select("conv_id", F.col("turn").isNotNull().alias("named"), "turn", "role", "digest", F.lit(1).alias("_kind"), "text", F.lit(None).cast("array<long>").alias("codes"), F.lit(None).cast("array<long>").alias("states"), "times")
    heads = codes.select("conv_id", "first.named", "first.turn", "first.role", "first.digest", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("text"), "codes", "states", F.lit(None).cast("int").alias("times"))
    stream = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "named", "turn", "role", "digest", "_kind")
    stream = stream.select("conv_id", "turn", "role", "digest", "text", "codes", "states", "times")
    made = stream.mapInArrow(lean(_rewritten), f"{key}, audit string, repaired_sha256 string")
    found = _joined(_joined(_joined(made, counts, "conv_id"), illegal, "conv_id", how="left"), costs, "conv_id")
    illegal_rows = (F.coalesce("_illegal", F.lit(0)) + F.col("_same")).cast("long").alias("illegal")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", illegal_rows, "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with the faults of the exercise, repaired; those of which no row is left have zeros, an empty audit and the hash of nothing."""
    named = conversations.select("conv_id").distinct()
    found = repair(damaged(conversations))
    out = _joined(named, found, "conv_id", how="left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
