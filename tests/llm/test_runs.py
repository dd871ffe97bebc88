import random

import numpy as np
import pytest
from brute import periodic
from brute import runs as plain

from verdictlake.llm.runs import lcp_of, longest_previous, periodic_runs, runs_of, suffix_ranks

NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def ranked(w):
    rank, deep = suffix_ranks(np.array(w, np.int64), np.zeros(len(w), np.int64), 1)
    sa = np.empty(len(w), np.int64)
    sa[rank] = np.arange(len(w))
    return sa.tolist(), rank.tolist(), bool(deep[0])


def texts(r):
    """Word numbers: few words, repeated pieces, powers inside powers, Fibonacci words."""
    kind = r.randrange(5)
    if kind == 0:
        return [r.randrange(2) for _ in range(r.randint(1, 60))]
    if kind == 1:
        piece = [r.randrange(3) for _ in range(r.randint(1, 7))]
        return [r.randrange(3) for _ in range(r.randint(0, 9))] + (piece * 9)[: r.randint(1, 50)] + [r.randrange(3) for _ in range(r.randint(0, 9))]
    if kind == 2:
        inner = [r.randrange(2) for _ in range(2)] * r.randint(3, 5) + [r.randrange(3)]
        return (inner * r.randint(2, 6))[: r.randint(5, 80)] + inner
    if kind == 3:
        a, b = [0], [0, 1]
        for _ in range(r.randint(2, 7)):
            a, b = b, b + a
        return b
    part = [r.randrange(2) for _ in range(12)] + [1] * r.randint(4, 8)
    return part + [2] + part + [3, *part, 0] + part * r.randint(1, 5)


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_a_search_over_all_periods(seed):
    r = random.Random(seed)
    for _ in range(300):
        w = texts(r)
        sa, rank, deep = ranked(w)
        assert sa == sorted(range(len(w)), key=lambda i: w[i:])
        want = plain(w)
        assert runs_of(w, sa, rank) == want, w
        assert deep or not want


def test_longest_previous_factors():
    r = random.Random(5)
    for _ in range(200):
        w = texts(r)[:40]
        sa, rank, _ = ranked(w)
        lpf, source = longest_previous(sa, lcp_of(w, sa, rank))
        for i in range(len(w)):
            common = [next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i) for j in range(i)]
            assert lpf[i] == max(common, default=0)
            assert not lpf[i] or common[source[i]] == lpf[i]


def documents():
    r = random.Random(1)
    docs = [(i, " ".join(f"w{x}" for x in texts(r)) + r.choice(["", "\n", " \t é"])) for i in range(150)]
    natural = [(i, " ".join(r.choices([f"word{k}" for k in range(40)], k=r.randint(30, 300)))) for i in range(200, 260)]
    return [*docs, *natural, (300, None), (301, ""), (302, " \n\t"), (None, "a b " * 9), (5, "a b " * 9), (5, "a b " * 9), (303, "one " * 4_000), (304, " ".join(f"x{i % 397}" for i in range(3_000))), (305, "z " * 3 + "y " * 3)]


@pytest.mark.parametrize(("repeated", "step"), [(True, 1 << 12), (False, 8 << 20), (True, 8 << 20)])
def test_documents_match_brute_force(spark, monkeypatch, repeated, step):
    import verdictlake.llm.common as common

    monkeypatch.setattr(common.steps, "__defaults__", (step,))
    docs = documents()
    frame = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, start int").repartition(4)
    frame = frame.withColumn("number", frame.start)
    got = {r.number: (r.doc_id, *(r[k] for k in NAMES)) for r in periodic_runs(frame, repeated=repeated).collect()}
    assert got == {n: (i, *periodic(i, t, repeated)) for n, (i, t) in enumerate(docs)}


def test_empty_table(spark):
    out = periodic_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0
    assert out.columns == ["doc_id", *NAMES]


def test_a_long_uniform_document_takes_linear_time():
    w = [0] * 120_000
    sa, rank, _ = ranked(w)
    assert runs_of(w, sa, rank) == [(0, 120_000, 1)]
