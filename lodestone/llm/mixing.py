"""Temperature mixing: source weights by exponentiated token shares, realised as budgeted block permutations.

A source with the share p of all tokens gets a weight in proportion to p**a. The exponent a is bisected between 0 (all sources alike) and 1 (as they are): the largest that
reaches a target entropy, or the smallest whose repetition keeps a limit. Each source's documents are dealt into blocks by hash; an epoch of a source is a permutation of its blocks, by hash of
seed, source, epoch and block. A source's token budget takes whole epochs and then the first blocks of one more that still fit.

Only totals per source reach the driver, and only totals per block are sorted, so a source that holds a third of all documents is spread over as many
tasks as any other third.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import apart, lean

BLOCKS = 1024
#: Rows of the block table up to which it is broadcast; beyond them the join shuffles.
BROADCAST_ROWS = 100_000
_STEPS = 60


@dataclass(frozen=True)
class Weights:
    """exponent, weight by source, epochs (uses of each token, a fraction) by source and the token budget."""

    exponent: float
    weight: dict
    epochs: dict
    budget: float


def weights_at(tokens: dict, exponent: float) -> dict:
    """Normalised weights of sources with tokens."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent for s, n in tokens.items() if n}
    norm = sum(raw[s] for s in sorted(raw, key=repr))
    return {s: w / norm for s, w in raw.items()}


def entropy(weight: dict) -> float:
    return -sum(w * math.log(w) for w in weight.values() if w > 0)


def _plan(tokens: dict, exponent: float, budget: float | None) -> Weights:
    weight = weights_at(tokens, exponent)
    # without a budget: the least with which no source gives up a document
    most = max((tokens[s] / w for s, w in weight.items()), default=0.0) if budget is None else budget
    return Weights(exponent, weight, {s: most * w / tokens[s] for s, w in weight.items()}, most)


def solve(tokens: dict, *, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None) -> Weights:
    """Bisects the exponent for exactly one of the two targets. A target that can't be met gets the nearest end, 0 or 1. Sources without tokens have no weight."""
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give a target entropy or a repetition limit")
    if repetition_limit is not None:
        good = lambda a: max(_plan(tokens, a, budget).epochs.values(), default=0.0) <= repetition_limit + 1e-9
        low, high = 0.0, 1.0  # smallest good exponent
        if good(low):
            return _plan(tokens, low, budget)
        for _ in range(_STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if good(mid) else (mid, high)
        return _plan(tokens, high, budget)
    reach = lambda a: entropy(weights_at(tokens, a)) >= target_entropy - 1e-12
    low, high = 0.0, 1.0  # largest exponent that reaches the target
    if reach(high):
        return _plan(tokens, high, budget)
    for _ in range(_STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if reach(mid) else (low, mid)
    return _plan(tokens, low, budget)


def word_count(text: Column) -> Column:
    """Words as a stand-in for tokens; null has none. Texts without spaces count as few words, however many tokens they hold."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def counted(docs: DataFrame, encoder: Callable[[], Callable[[bytes], bytes]], name: str = "_count") -> DataFrame:
    """docs with the number of token ids (unsigned 32-bit) that ``encoder`` of the packing operator gives for each text; null has none."""
    columns = docs.columns
    text_at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            counts = [len(encode(raw.encode())) // 4 if (raw := t.as_py()) else 0 for t in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*columns, name])

    return docs.mapInArrow(lean(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` long"]))


def mix(docs: DataFrame, tokens: Column, *, seed: int = 0, blocks: int = BLOCKS, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None) -> DataFrame:
    """Rows of docs, once for each use, with n_tokens, weight, epoch (from 0) and position (uses sort by it, then by doc_id, within their source).

    A null source is a source of its own. Documents of a source without tokens are used once. Repeated rows count and are used one by
    one. An empty table gives an empty result. Columns of docs with the new names are replaced.
    """
    new = ("n_tokens", "weight", "epoch", "position")
    rows = docs.withColumn("tokens of a row", tokens.cast("long")).drop(*new)
    rows, names = apart(rows, "doc_id", "source", "tokens of a row")
    kept = [c for c in rows.columns if c != "tokens of a row"]
    named = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    rows = rows.select(*(F.col(f"`{c}`") for c in kept), F.col("`tokens of a row`").alias("n_tokens"), named.alias("_source"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "n_tokens"), F.lit(blocks)).cast("int"))
    totals = {r["_source"]: r["n"] for r in rows.groupBy("_source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each source
    plan = solve(totals, target_entropy=target_entropy, repetition_limit=repetition_limit, budget=budget)
    spark = docs.sparkSession
    sources = spark.createDataFrame(
        [(s, plan.weight.get(s, 0.0), int(plan.epochs.get(s, 1.0) + 1e-9), int(n * max(0.0, plan.epochs.get(s, 1.0) - int(plan.epochs.get(s, 1.0) + 1e-9)) + 1e-6)) for s, n in totals.items()],
        "_source string, weight double, _whole int, _rest long",
    )
    table = rows.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("_tokens"))
    turn = lambda e: F.xxhash64(F.lit(seed), F.col("_source"), e, F.col("_block"))
    table = table.join(F.broadcast(sources), "_source")  # one row for each source
    last = Window.partitionBy("_source").orderBy(turn(F.col("_whole").cast("long")), "_block")  # at most ``blocks`` rows of a source
    table = table.withColumn("_used", (F.sum("_tokens").over(last.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("_rest")) & (F.col("_rest") > 0))
    table = table.withColumn("_uses", F.col("_whole") + F.col("_used").cast("int")).where("_uses > 0").select("_source", "_block", "weight", "_uses")
    if len(totals) * blocks <= BROADCAST_ROWS:
        table = F.broadcast(table)
    out = rows.join(table, ["_source", "_block"]).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_uses") - 1)))
    # epochs follow each other; within one, blocks come in its permutation
    place = F.shiftleft(F.col("epoch").cast("long"), 48) + F.shiftrightunsigned(turn(F.col("epoch").cast("long")), 16)
    return out.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in kept), "n_tokens", "weight", "epoch", place.alias("position"))
