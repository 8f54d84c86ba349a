import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm import mixing as M
from lodestone.llm import packing, queries


def test_repetition_limit_is_met_exactly():
    tokens = {"a": 1000, "b": 100, "c": 10}
    plan = M.solve(tokens, repetition_limit=2.0)
    assert abs(max(plan.epochs.values()) - 2.0) < 1e-6
    assert abs(min(plan.epochs.values()) - 1.0) < 1e-9
    assert abs(sum(plan.weight.values()) - 1) < 1e-12


def test_target_entropy_is_met():
    tokens = {"a": 1000, "b": 100, "c": 10}
    plan = M.solve(tokens, target_entropy=0.9, budget=500)
    assert abs(M.entropy(plan.weight) - 0.9) < 1e-9
    assert abs(sum(plan.epochs[s] * tokens[s] for s in tokens) - 500) < 1e-6


def test_ends():
    assert M.solve({"a": 5, "b": 5}, repetition_limit=3.0).exponent == 0.0
    assert M.solve({"a": 5, "b": 1}, target_entropy=0.1).exponent == 1.0
    assert M.solve({"a": 5, "b": 1}, target_entropy=math.log(2)).exponent < 1e-4
    assert M.solve({}, repetition_limit=2.0).weight == {}
    assert M.solve({"a": 0}, repetition_limit=2.0).weight == {}


def test_budgets_hold(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 7}", " ".join(["w"] * (k % 40))) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.mix(docs, M.word_count(F.col("text")), repetition_limit=2.0, blocks=32).collect()
    tokens, used = defaultdict(int), defaultdict(int)
    for k, source, text in rows:
        tokens[source] += k % 40
    for r in got:
        used[r["source"]] += r["n_tokens"]
    plan = M.solve(tokens, repetition_limit=2.0)
    largest = max(tokens.values()) / 8
    for s in tokens:
        assert used[s] <= plan.epochs[s] * tokens[s] + 1e-6
        assert used[s] >= plan.epochs[s] * tokens[s] - largest
    uses = Counter(r["doc_id"] for r in got)
    assert set(uses) == {k for k, _, _ in rows} and max(uses.values()) <= 2
    assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
    # an epoch's blocks differ in order from the next one's
    first = [r["doc_id"] for r in sorted(got, key=lambda r: (r["position"], r["doc_id"])) if r["source"] == "s0" and r["epoch"] == 0]
    second = [r["doc_id"] for r in sorted(got, key=lambda r: (r["position"], r["doc_id"])) if r["source"] == "s0" and r["epoch"] == 1]
    assert first != second


def test_odd_rows(spark):
    schema = "doc_id long, source string, text string, weight int, epoch string"
    assert M.mix(spark.createDataFrame([], schema), M.word_count(F.col("text")), repetition_limit=2.0).count() == 0
    docs = spark.createDataFrame([(1, None, "a b"), (1, None, "a b"), (2, "", None), (None, "x", ""), (3, "x", "a " * 5000)], "doc_id long, source string, text string")
    got = M.mix(docs, M.word_count(F.col("text")), repetition_limit=2.0).collect()
    assert Counter(r["doc_id"] for r in got)[2] == 1
    assert {r["doc_id"] for r in got} == {1, 2, 3, None}


def test_shares_are_of_tokens(spark, tmp_path):
    rows = [(k, "spaced", "two words") for k in range(50)] + [(100 + k, "unspaced", "漢字仮名交文" * 40) for k in range(50)] + [(200, None, None), (201, "spaced", "")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    encode = packing.word_encoder(queries.tokenizer_path())()
    want = {k: len(encode((t or "").encode())) // 4 for k, _, t in rows}
    got = queries.op7_temperature_mixing(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and want[100] > 100
    plan = M.solve({"spaced": sum(want[k] for k in range(50)), "unspaced": sum(want[100 + k] for k in range(50))}, repetition_limit=queries.REPETITION_LIMIT)
    assert all(abs(r["weight"] - plan.weight[r["source"]]) < 1e-9 for r in got if r["source"])
