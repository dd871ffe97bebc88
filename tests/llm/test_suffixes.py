import hashlib
import random

import numpy as np
import pytest
from brute import repeated_bytes as plain

import verdictlake.llm.suffixes as suffixes
from verdictlake.llm.suffixes import Often, Prefixes, anchors, repeated_bytes, suffix_order


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdé ", k=r.randint(1, 6)))
    passages = ["".join(word() for _ in range(r.randint(4, 30))) for _ in range(12)]
    docs = ["".join(r.choice([word(), word(), word(), r.choice(passages), r.choice(passages)[5:]]) for _ in range(r.randint(0, 12))) for _ in range(120)]
    hot = "a common line of every second document\n"
    docs = [hot + d if i % 2 else d for i, d in enumerate(docs)]
    docs += [docs[3], docs[3], docs[5], None, "", "x" * 90, "ab" * 60, "the same words again, " * 9]
    docs += [hot[:-1] + chr(97 + i % 26) + str(i) * 3 for i in range(60)]  # many contexts of one line
    return docs + [passages[1] * 3 + "".join(word() for _ in range(3000)) + passages[1]]


@pytest.mark.parametrize(("seed", "least", "gram", "most_group", "often", "gathered"), [(1, 20, 6, 1024, 16, 1 << 17), (2, 20, 6, 3, 10_000, 64), (3, 33, 12, 2, 10_000, 1 << 17), (4, 20, 20, 1024, 4, 256), (5, 64, 16, 2, 3, 200)])
def test_matches_brute_force(spark, monkeypatch, seed, least, gram, most_group, often, gathered):
    monkeypatch.setattr(suffixes, "GATHERED", gathered)
    docs = corpus(seed)
    rows = [(None if n % 50 == 7 else n // 2, t, n) for n, t in enumerate(docs)]  # two documents an id
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_spans int").withColumn("number", suffixes.F.col("n_spans")).repartition(6)
    got = {x.number: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept), x.kept_sha256) for x in repeated_bytes(frame, least=least, gram=gram, most_group=most_group, often=often, keep_bytes=True).collect()}
    assert got == {n: (*w, hashlib.sha256(w[3]).hexdigest()) for n, w in enumerate(plain(docs, least))}


def test_empty_table_and_short_texts(spark):
    assert repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = repeated_bytes(spark.createDataFrame([("b", "short"), ("a", "short"), ("c", None)], "doc_id string, text string")).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans) for x in got) == [("a", 5, 0, 0), ("b", 5, 0, 0), ("c", 0, 0, 0)]


@pytest.mark.parametrize("seed", range(5))
def test_suffixes_are_sorted(seed):
    r = np.random.default_rng(seed)
    text = np.concatenate([r.integers(97, 99, 300), np.tile([97, 98, 98], 60), r.integers(97, 99, 300)]).astype(np.uint8)
    least = int(r.integers(5, 40))
    at = r.permutation(len(text) - least + 1)[: r.integers(2, 600)]
    groups = r.integers(0, 4, len(at))
    order, same = suffix_order(text, Prefixes(text), at, groups, least)
    keys = [(groups[i], text[at[i] : at[i] + least].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert same.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_equal_strings_have_equal_anchors():
    r = np.random.default_rng(3)
    text = r.integers(97, 99, 4000).astype(np.uint8)
    first = np.array([0, 700, 700, 712, 2500, 4000])
    at = {}
    row, a, p0, p1, key = anchors(text, first, Often(np.zeros(0, np.uint64)), 16, 5)
    for i in range(len(a)):
        assert first[row[i]] <= p0[i] and p1[i] + 16 <= first[row[i] + 1]
        for p in range(p0[i], p1[i] + 1):
            assert p <= a[i] <= p + 11
            assert at.setdefault(text[p : p + 16].tobytes(), (a[i] - p, key[i])) == (a[i] - p, key[i])
    assert (p1 - p0 + 1).sum() == sum(max(0, n - 15) for n in np.diff(first))
