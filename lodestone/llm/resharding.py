"""Minimum-cost-flow resharding: move the fewest bytes from old shards to new capacities.

The plan is a transport problem between old shards and new shards: what stays costs nothing, what
moves costs one per byte. Its size is (old shards) x (new shards), whatever the corpus holds, so it is solved on the
driver. Documents are then laid out along a byte line of each old shard, in blocks, and each flow takes an interval of
that line; a document goes where its first byte lies. Large documents are laid out first; the small ones then fill what these have left, by
a flow of their own, so new shards miss their capacities by a few small documents at most, unless a single document is larger than what is missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import remove

#: Blocks per old shard. The block totals (old shards x this) are all that the driver gets.
BLOCKS = 256
#: A document is large if it takes more than this share of an average new shard.
LARGE = 1 / 200


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Flow of least cost that ships every supply within the capacities (successive shortest paths with potentials).

    ``sum(capacity)`` has to be at least ``sum(supply)``. Deterministic: ties go to the lower index.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards can't hold the old ones")
    m, n = len(supply), len(capacity)
    flow = [[0] * n for _ in range(m)]
    left, room = list(supply), list(capacity)
    pot = [0] * (m + n)
    while any(left):
        dist, back = [float("inf")] * (m + n), [-1] * (m + n)
        heap: list[tuple[int, int]] = []
        for i in range(m):
            if left[i]:
                dist[i] = 0
                heappush(heap, (0, i))
        while heap:
            d, u = heappop(heap)
            if d > dist[u]:
                continue
            arcs = [(m + j, cost[u][j]) for j in range(n)] if u < m else [(i, -cost[i][u - m]) for i in range(m) if flow[i][u - m]]
            for v, c in arcs:
                reduced = d + c + pot[u] - pot[v]
                if reduced < dist[v]:
                    dist[v], back[v] = reduced, u
                    heappush(heap, (reduced, v))
        ends = [m + j for j in range(n) if room[j] and dist[m + j] < float("inf")]
        end = min(ends, key=lambda v: (dist[v] - pot_start(pot, back, v) + pot[v], v))
        reach = max(d for d in dist if d < float("inf"))
        pot = [p + (d if d < float("inf") else reach) for p, d in zip(pot, dist, strict=True)]
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - m], *(flow[v][u - m] for u, v in zip(path, path[1:]) if u >= m), left[path[0]])
        for u, v in zip(path, path[1:]):
            if u < m:
                flow[u][v - m] += amount
            else:
                flow[v][u - m] -= amount
        left[path[0]] -= amount
        room[end - m] -= amount
    return flow


def pot_start(pot: list[int], back: list[int], v: int) -> int:
    """Potential of the node at which the shortest path to ``v`` begins."""
    while back[v] >= 0:
        v = back[v]
    return pot[v]


def even_capacities(total: int, shards: int) -> list[int]:
    """``total`` split into ``shards`` integers at most one apart."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def plan_transfers(old_sizes: Sequence[int], capacities: Sequence[int]) -> list[list[int]]:
    """Bytes from each old shard to each new one; keeping shard i as shard i is free."""
    return min_cost_flow(old_sizes, capacities, [[0 if i == j else 1 for j in range(len(capacities))] for i in range(len(old_sizes))])


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int, *, size: Column, order: Sequence[Column], capacities: Sequence[int] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Adds ``old_shard``, ``shard`` and ``slot`` (gapless from 0 in each shard) to ``docs``.

    ``old_shard`` gives 0 to ``old_shards - 1`` (null counts as 0), ``size`` a positive long, ``order`` a total order of the rows as
    far as they differ. Equal rows may swap places among themselves. An empty table gives an empty result. Extra columns
    are kept, but for those named ``old_shard``, ``shard`` and ``slot``, which are replaced. Equal texts go wherever their bytes lie: the law ``bytes`` asks for even sizes, not
    for copies to stay together.

    Hot old shards are spread over ``blocks`` blocks by a hash of the order columns, so no window
    holds more than about 1/blocks of a shard. Rows are dealt to tasks by ranges of these blocks, so what a task holds goes to few new shards.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("old_shard", "shard", "slot")]
    by = [f"order {k}" for k in range(len(order))]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"kept {k}") for k, c in enumerate(columns)), F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"), size.cast("long").alias("_size"), *(o.alias(b) for o, b in zip(order, by)))
    order = [F.col(f"`{b}`") for b in by]
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    total = rows.agg(F.sum("_size")).first()[0] or 0
    rows = rows.withColumn("_small", (F.col("_size") <= total / new_shards * LARGE).cast("int"))
    totals = rows.groupBy("old_shard", "_small", "_block").agg(F.sum("_size").alias("bytes")).collect()  # at most 2 x old_shards x blocks rows
    of = {(r["old_shard"], r["_small"], r["_block"]): r["bytes"] for r in totals}
    tiers = [[sum(of.get((i, small, b), 0) for b in range(blocks)) for i in range(old_shards)] for small in (0, 1)]
    starts, line, at = [], [[0] * old_shards, [0] * old_shards], 0  # where each block begins on one line through all tiers and old shards
    for small in (0, 1):
        for i in range(old_shards):
            line[small][i] = at
            for b in range(blocks):
                if (i, small, b) in of:
                    starts.append((i, small, b, at))
                    at += of[i, small, b]
    by_block = Window.partitionBy("old_shard", "_small", "_block").orderBy(*order)
    starts_frame = F.broadcast(spark.createDataFrame(starts, "old_shard int, _small int, _block int, _start long"))
    dealt = rows.repartitionByRange("old_shard", "_block", "_small")  # the one exchange of whole rows; it serves both windows below
    along = dealt.join(starts_frame, ["old_shard", "_small", "_block"]).withColumn("_at", F.col("_start") + F.coalesce(F.sum("_size").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def intervals(flows: list[list[int]], small: int) -> list[tuple[int, int]]:
        """(end on the line, new shard) of each flow, stretched to the tier's bytes. What stays comes first, so a shard that only gives away keeps a prefix."""
        out = []
        for i, row in enumerate(flows):
            whole, done = sum(row), 0
            for j in sorted(range(new_shards), key=lambda j: (j != i, j)):
                if row[j]:
                    done += row[j]
                    out.append((line[small][i] + done * tiers[small][i] // whole, j))
        return out

    def cut(frame: DataFrame, ends: list[tuple[int, int]]) -> DataFrame:
        if not ends:
            return frame.withColumn("shard", F.lit(0))
        bounds, targets = (F.array(*(F.lit(e[k]) for e in ends)) for k in (0, 1))
        return frame.withColumn("shard", F.element_at(targets, F.least(F.size(F.filter(bounds, lambda e: e <= F.col("_at"))) + 1, F.lit(len(ends)))).cast("int"))

    room = list(capacities or even_capacities(total, new_shards))
    ends = intervals(plan_transfers([a + b for a, b in zip(*tiers)], room), 0) if total else []
    ends = [e for k, e in enumerate(ends) if e[0] > (ends[k - 1][0] if k else 0)]  # old shards without large documents
    if ends and sum(tiers[1]):
        taken = {r["shard"]: r["b"] for r in cut(along.where("_small = 0"), ends).groupBy("shard").agg(F.sum("_size").alias("b")).collect()}  # one row for each new shard
        left = [max(0, c - taken.get(j, 0)) for j, c in enumerate(room)]
        short = sum(tiers[1]) - sum(left)
        left = [x + extra for x, extra in zip(left, even_capacities(max(0, short), new_shards))]
        ends += intervals(plan_transfers(tiers[1], left), 1)
    elif sum(tiers[1]):
        ends = intervals(plan_transfers(tiers[1], room), 1)
    placed = cut(along, ends)
    place = ["old_shard", "_small", "_block"]
    counts = placed.groupBy("shard", *place).agg(F.count("*").alias("n"))  # at most 2 x old_shards x blocks + flows rows
    offsets = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*place, "shard").orderBy(*order)) - 1
    out = placed.withColumn("_rank", rank).join(F.broadcast(offsets.drop("n")), ["shard", *place]).withColumn("slot", (F.col("_before") + F.col("_rank")).cast("long"))
    return out.select(*(F.col(f"`kept {k}`").alias(c) for k, c in enumerate(columns)), "old_shard", "shard", "slot")


def rewrite(sharded: DataFrame, path: str) -> list[int]:
    """Writes the shards whose content changes to ``path/shard=N``, rows by slot, and returns their numbers.

    A shard is affected if a row enters or leaves it; the files of all others stay as they are. The folders of shards that are left without rows
    go. Rows may come from ``path`` itself: its files are replaced when all new ones are written.
    """
    spark = sharded.sparkSession
    moved = sharded.where("shard <> old_shard")
    rows = moved.select(F.explode(F.array("shard", "old_shard")).alias("s")).groupBy("s").count().collect()  # one row per shard
    affected = sorted(r["s"] for r in rows)
    if affected:
        changed = sharded.where(F.col("shard").isin(affected))
        filled = {r["shard"] for r in changed.select("shard").distinct().collect()}  # one row per shard
        changed.drop("old_shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
        for s in affected:
            if s not in filled:
                remove(spark, f"{path}/shard={s}")
    return affected
