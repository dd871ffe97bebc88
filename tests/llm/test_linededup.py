import random

import pytest
from brute import line_dedup as plain

import verdictlake.llm.common as common
from verdictlake.llm.linededup import line_dedup, suspected


def corpus():
    r = random.Random(2)
    shared = [f"Shared line number {i} É" for i in range(12)] + ["short", "  SHARED LINE NUMBER 3 É\t", ""]
    docs = [(i, "\n".join(r.choices(shared, k=r.randint(0, 8)) + [f"own line of {i} {j}" for j in range(r.randint(0, 4))])) for i in range(60)]
    return [*docs, (60, None), (61, ""), (3, "Shared line number 1 É\nown"), (None, "Shared line number 2 É\nShared line number 2 É"), (62, "\n".join(f"line {j} of a long text" for j in range(20_000))), (63, "line 7 of a long text")]


@pytest.mark.parametrize(("step", "most_bits"), [(1 << 10, 1 << 28), (8 << 20, 1 << 28), (8 << 20, 1 << 17)])
def test_matches_brute_force(spark, monkeypatch, step, most_bits):
    monkeypatch.setattr(common, "STEP_BYTES", step)
    monkeypatch.setattr(common.steps, "__defaults__", (step,))
    docs = corpus()
    frame = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, n_lines int").repartition(5)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.text) for r in line_dedup(frame, most_bits=most_bits).collect())
    want = sorted((i is None, i or 0, n, d, t) for i, n, d, t in plain(docs))
    assert got == want


def test_empty_table_and_other_columns(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, __line_keys string")
    assert line_dedup(frame).count() == 0
    one = line_dedup(spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, __line_keys string")).collect()
    assert [tuple(r) for r in one] == [(1, "a", "x", 1, 0)]


def test_string_ids_and_ties(spark):
    frame = spark.createDataFrame([("b", "the same long line"), ("a", "the same long line"), ("a", "the same long line")], "doc_id string, text string")
    got = sorted((r.doc_id, r.n_dropped) for r in line_dedup(frame).collect())
    assert got == [("a", 0), ("a", 0), ("b", 1)]


@pytest.mark.parametrize("most_bits", [1 << 16, 1 << 28])
def test_suspects_stay_near_true_repeats_whatever_the_bound(spark, most_bits):
    docs = [(i, "\n".join([f"line {j} of document {i}" for j in range(100)] + [f"shared line {i % 40}"] * (i < 80))) for i in range(400)]
    got = suspected(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), most_bits=most_bits)
    keys = [r.key for r in got.collect()]
    repeated = {k for k in keys if keys.count(k) == 2}
    assert len(repeated) == 40
    assert 80 <= len(keys) <= 80 + 0.02 * 40_000
