"""Postings and sketches of documents that reach over several lots, against plain Python; what they shuffle."""

import numpy as np
import pytest

from lodestone.operators import candidates, sketches


@pytest.fixture(params=[1, 40, 1 << 20])
def lots(request, spark, monkeypatch):
    monkeypatch.setattr(candidates, "TOGETHER", request.param)
    monkeypatch.setattr(sketches, "LOT", request.param)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


ROWS = [(d, o, ["Hé", None, "ab", "kopf kopf"][o % 4], ["漢字漢字 text %d" % o, "", "abcabcabc", None, "😀😀😀x", "long line " * 9][(d + o) % 6]) for d in range(-2, 6) for o in range(30)]
SCHEMA = "document_id long, ordinal int, norm_heading string, norm_content string"


def set_bits(words):
    return set(np.flatnonzero(np.unpackbits(np.array(words, np.int64).view(np.uint8), bitorder="little")).tolist())


def wanted_bits(texts):
    return {int(b) for t in texts if t for b in sketches.gram_bits(np.array([ord(c) for c in t], np.uint32))}


def blocks_of(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


def test_postings_of_documents_over_several_lots(spark, lots):
    posted = candidates.postings(blocks_of(spark))
    want = sorted({(candidates.gram_code(t[k : k + 3]), r[0]) for r in ROWS for t in r[2:] if t for k in range(len(t) - 2)})
    assert sorted(map(tuple, posted.collect())) == want


def test_document_sketches_over_several_lots(spark, lots):
    got = {r["document_id"]: set_bits(r["sketch"]) for r in sketches.document_sketches(blocks_of(spark)).collect()}
    assert got == {d: wanted_bits([t for r in ROWS if r[0] == d for t in r[2:]]) for d in {r[0] for r in ROWS}}


@pytest.mark.parametrize("size", [16, 50, 4096])
def test_payloads_over_several_lots(spark, lots, size):
    want = []
    for d in sorted({r[0] for r in ROWS}):
        held, texts = None, []
        for _, o, _, text in (r for r in ROWS if r[0] == d):
            text = text or ""
            for at in range(0, max(1, len(text)), size):
                n = len(text[at : at + size].encode())
                if held is None or held + n > size:
                    want.append([d, 0 if held is None else want[-1][1] + 1, 0, o, o])
                    texts.append([])
                    held = 0
                if texts[-1] and texts[-1][-1][0] == o:
                    texts[-1][-1][1] += text[at : at + size]
                else:
                    texts[-1].append([o, text[at : at + size]])
                held += n
                want[-1][2], want[-1][4] = held, o
        for row, some in zip([w for w in want if w[0] == d], texts):
            row.append(frozenset(wanted_bits([t for _, t in some])))
    got = [[*r[:5], frozenset(set_bits(r[5]))] for r in sketches.payloads(blocks_of(spark), size).collect()]
    assert sorted(got, key=lambda r: r[:2]) == want


def test_texts_are_shuffled_once_and_what_is_made_of_them_never(spark):
    for made in (candidates.postings(blocks_of(spark)), sketches.document_sketches(blocks_of(spark))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.index("MapInArrow") < plan.index("Exchange")
