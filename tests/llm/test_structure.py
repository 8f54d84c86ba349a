"""Conversation repair against a search over all edits, on odd rows and in small blocks."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import structure

SCHEMA = "conv_id long, turn long, role string, text string, times int, cost string, first int"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def searched(rows):
    """(cost, audit, repaired) of rows (initial, must go, truncated, role, text): every edit of every row, with up to three inserts before it, audits kept as strings."""
    best = {"": (0, "", ())}
    for initial, must, cut, role, text in rows:
        found = {}
        for state, (cost, audit, lines) in best.items():
            at, said, edits = state, lines, ""
            for inserts in range(4):
                options = [(at, cost + 2 * inserts + 3, edits + "D", said)]
                if not must:
                    if initial == NEXT[at] or (initial == "s" and at == ""):
                        options.append((initial, cost + 2 * inserts + cut, edits + "K", (*said, f"{role}:{text}")))
                    new = NEXT[at]
                    options.append((new, cost + 2 * inserts + 2 + cut, edits + "R", (*said, f"{'user' if new == 'u' else 'assistant'}:{text}")))
                for after, price, more, left in options:
                    one = (price, audit + more, left)
                    if after not in found or one[:2] < found[after][:2]:
                        found[after] = one
                new = NEXT[at]
                at, said, edits = new, (*said, "user:" if new == "u" else "assistant:"), edits + "I"
        best = found
    ends = []
    for state, (cost, audit, lines) in best.items():
        more = {"": (), "s": ("user:", "assistant:"), "u": ("assistant:",), "a": ()}[state]
        ends.append((cost + 2 * len(more), audit + "I" * len(more), lines + more))
    return min(ends)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv for _ in range(r[4])]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        seen, prepared, counts, initials = set(), [], [0, 0, 0], [r[2][:1] if r[2][:1] in "sua" else "" for r in mine]
        for r, initial in zip(mine, initials):
            core = r[3].strip(structure.GAP)
            fault = 0 if not core else 1 if (r[2], r[3]) in seen else 2 if core[-1] not in ".!?" else None
            seen.add((r[2], r[3]))
            if fault is not None:
                counts[fault] += 1
            prepared.append((initial, fault in (0, 1), int(fault == 2), r[2], r[3]))
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit, lines = searched(prepared)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n=60):
    r = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in r.sample([None, *range(12)], r.randint(1, 11)):
            text = r.choice(["Yes.", "No!", "cut off", "", " \n", "漢字。", "Yes.", f"t{turn}?"])
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "usher"]), text, r.choice([1, 1, 1, 2, 3]), "x", 1))
    return rows


@pytest.mark.parametrize("bits", [12, 1])
def test_cheapest_repairs(spark, monkeypatch, bits):
    monkeypatch.setattr(structure, "BLOCK_BITS", bits)  # 1: blocks of two, so trees of four levels
    rows = conversations(bits)
    got = {r["conv_id"]: tuple(r[1:]) for r in structure.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == expected(rows)


def test_damage_and_odd_tables(spark):
    rows = [(k // 5, k % 5, None if k % 7 == 0 else "user", None if k % 11 == 0 else f"Line {k}. And", 1, "x", 1) for k in range(200)] + [(None, None, "assistant", "Only one.", 1, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = structure.repair_damaged(df)
    assert got.count() == 41 and got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    left = {r["conv_id"] for r in structure.damaged(df).select("conv_id").distinct().collect()}
    gone = [r for r in got.collect() if r["conv_id"] not in left]
    assert all(tuple(r[1:8]) == (0, 0, 0, 0, 0, 0, "") and r["repaired_sha256"] == hashlib.sha256().hexdigest() for r in gone)
    assert structure.repair_damaged(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", "x" * 1000 + f"{k}.", 1, "x", 1) for k in range(9000)], SCHEMA)  # one conversation in three blocks
    row = structure.repair(long).first()
    assert (row["cost"], row["illegal"], row["audit"]) == (0, 0, "K" * 9000)


def test_matrices_of_neighbours_combine():
    r = np.random.default_rng(0)
    cost, rank, _ = structure.row_matrices()
    kinds = r.integers(0, 12, 50)
    whole = structure.fold(cost[kinds], rank[kinds], np.array([0, 50]))
    halves = structure.fold(cost[kinds], rank[kinds], np.array([0, 20, 50]))
    joined = structure.fold(halves[0], halves[1], np.array([0, 2]))
    reached = whole[0] < structure.NEVER
    assert (whole[0] == joined[0]).all() and (whole[1][reached] == joined[1][reached]).all()
