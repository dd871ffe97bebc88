import numpy as np
from pyspark.sql import functions as F

from verdictlake.llm.ann import fit, nearest


def brute(rows, k):
    clean = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8}
    ids = np.array([i for i, _ in clean])
    vectors = np.array([v for _, v in clean], dtype=np.float32).astype(np.float64)
    out = {}
    for q in sorted(set(ids)):
        if q % 20:
            continue
        scores = vectors @ vectors[ids == q][0]
        order = [j for j in np.lexsort((ids, -np.round(scores, 12))) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def run(spark, rows, k):
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(v, s) for _, v, s in sorted(g)] for q, g in got.items()}


def test_small_tables_are_exact(spark):
    r = np.random.default_rng(11)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [1.0] * 7 + [None]), (504, [float("inf")] * 8), (505, [1.0] * 3), (None, rows[1][1]), (3, rows[3][1])]
    got, want = run(spark, rows, 20), brute(rows, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_recall_on_clusters(spark):
    r = np.random.default_rng(12)
    centres = r.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + 0.3 * r.normal(size=8)).astype(np.float32).tolist()) for i in range(4000)]
    got, want = run(spark, rows, 20), brute(rows, 20)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_tree_indexes_every_vector_and_orders_all_leaves():
    r = np.random.default_rng(13)
    x = r.normal(size=(3000, 8))
    tree = fit(x, 3000, float((x * x).sum(axis=1).max()))
    assert set(tree.assign(x)) <= set(range(tree.n_leaves)) and tree.n_leaves > 4
    assert sorted(tree.order(x[0], tree.n_leaves)) == list(range(tree.n_leaves))


def test_fewer_candidates_than_k_and_empty(spark):
    got = run(spark, [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [2.0, 0.0])], 20)
    assert got == {0: [(2, 2.0), (1, 0.5)]}
    assert run(spark, [], 20) == {} and run(spark, [(1, [1.0])], 20) == {}
    assert run(spark, [(0, [1.0])], 20) == {}


def test_ties_go_to_smaller_ids(spark):
    r = np.random.default_rng(14)
    for n in (400, 3000):
        rows = [(i, r.integers(-2, 3, size=8).astype(np.float32).tolist()) for i in r.permutation(n).tolist()]
        got, want = run(spark, rows, 20), brute(rows, 20)
        hits = sum(len(set(got[q]) & set(want[q])) for q in want)
        assert got.keys() == want.keys() and hits >= 0.95 * sum(map(len, want.values())), (n, hits)
        if n == 400:  # one leaf: everything is found
            assert got == want
