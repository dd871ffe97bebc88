import random

import numpy as np
import pytest
from brute import components, shingles

import verdictlake.llm.neardup as nd
from verdictlake.llm.components import connected_components


def corpus(seed=6, n=90):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            w = (r.choice(out)[1] or "").split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            out.append((i, " ".join(w)))
        else:
            out.append((i, " ".join(f"v{r.randrange(400)}" for _ in range(r.randint(1, 160)))))
    return [*out, (200, None), (201, ""), (202, "one"), (203, "ONE"), (204, "a b"), (205, "A  b\n"), (206, "a b c d"), (207, "w " * 30_000), (208, "W " * 29_000)]


@pytest.mark.parametrize(("k", "num", "symbols"), [(3, 85, 64), (5, 80, 96)])
def test_components_match_brute_force(spark, k, num, symbols):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, component_id long").repartition(5)
    got = {r.doc_id: r for r in nd.near_duplicates(frame, k=k, num=num, den=100, symbols=symbols).collect()}
    want = components(docs, k, num, 100)
    assert {i: g.component_id for i, g in got.items()} == want
    assert all(g.kept == (g.component_id == i) and g.n_shingles == len(shingles(dict(docs)[i], k)) for i, g in got.items())
    assert len(set(want.values())) < len(want) - 20


def test_blocks_of_a_large_family(spark, monkeypatch):
    """Families cut into many blocks lose no link across them."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    r = random.Random(7)
    base = [f"v{i}" for i in range(100)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            w[r.randrange(100)] = f"y{r.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == components(docs, 3, 85, 100)


def test_repeated_ids_null_ids_and_empty_table(spark):
    schema = "doc_id long, text string"
    rows = [(1, "a b c d e"), (1, "q r s t u"), (2, "q r s t u"), (None, "a b c d e"), (None, None)]
    got = nd.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert nd.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_every_pair_within_the_distance_shares_a_key():
    r = np.random.default_rng(8)
    bound = nd.distance_bound(64, 0.85)
    parts = nd.chunks(64, bound)
    a = r.integers(0, 1 << 16, (200, 64)).astype(np.uint16)
    b = a.copy()
    for i in range(200):
        b[i, r.choice(64, bound, replace=False)] ^= 1
    ka, kb = nd.index_keys(a, parts), nd.index_keys(b, parts)
    assert all(set(x.tolist()) & set(y.tolist()) for x, y in zip(ka, kb, strict=True))


def test_signatures_estimate_similarity():
    r = np.random.default_rng(9)
    common = r.integers(0, 2**63, 800).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, r.integers(0, 2**63, 100).astype(np.uint64)])) for _ in range(2)]
    s = nd.signatures(sets, 512)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.08


def test_connected_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
