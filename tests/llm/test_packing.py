import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdictlake.llm.packing import WordTokenizer, combinations, nnls_counts, pack, plan
from verdictlake.llm.queries import vocabulary


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "a", " a", "a ", "a  b", "a \n b", "a  b", "it's 12's\n\n  x", "日本 語", "<|endoftext|> a", "a <|endoftext|>b c", "x<|endoftext|><|endoftext|>", "<|endoftext| >", "a\x1cb \x85 c", "x\ty z", "é" * 50, "퟿ é", "one two\nthree four", "!!! ... ,,,"]


def test_word_tokenizer_gives_the_ids_of_the_vocabulary(exact):
    r = random.Random(3)
    texts = ODD + ["".join(r.choices([*"ab c\n'sé1 .　\t", "<|endoftext|>"], k=r.randint(0, 60))) for _ in range(300)]
    flat, counts = WordTokenizer(vocabulary()).batch(pa.array(texts, pa.large_string()))
    at = 0
    for t, n in zip(texts, counts, strict=True):
        assert flat[at : at + n].tolist() == exact(t), repr(t)
        at += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_word_tokenizer_on_any_text(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    flat, counts = WordTokenizer(vocabulary()).batch(pa.array(texts, pa.large_string()))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert counts.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])


def test_combinations_fill_the_window():
    c = combinations(64)
    assert (c.sum(axis=1) == 64).all() and len(c) < 64 * 64


def test_nnls_finds_counts_that_explain_a_histogram():
    patterns = np.array([[1, 7, 0], [2, 6, 0], [2, 2, 4]])
    histogram = np.zeros(9)
    for p, n in zip(patterns, (10, 5, 20), strict=True):
        for x in p[p > 0]:
            histogram[x] += n
    assert np.allclose(nnls_counts(patterns, histogram, 2000), [10, 5, 20], atol=0.1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=65, max_size=65))
def test_plan_places_every_piece_once_inside_the_window(counts):
    histogram = np.array([0, *counts[1:]])
    ranks, sequences = defaultdict(list), defaultdict(list)
    for n, first, count, sequence, offset in plan(histogram, 64):
        ranks[n].append((first, first + count))
        for i in range(count):
            sequences[sequence + i].append((offset, n))
    for n, ranges in ranks.items():
        ends = [0, *(e for _, e in sorted(ranges))]
        assert [s for s, _ in sorted(ranges)] == ends[:-1] and ends[-1] == histogram[n]
    assert sum(histogram > 0) == len(ranks)
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64


def test_round_trip(spark, exact):
    r = random.Random(4)
    texts = [None, *ODD] + [" ".join(r.choices(["alpha", "beta", "gamma", "delta\n"], k=r.randint(1, 900))) for _ in range(60)] + ["word " * 9000]
    rows = [(i // 2 if i < 10 else i, t, i) for i, t in enumerate(texts)] + [(None, "no id", 0)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3), vocabulary=vocabulary()).collect()
    want = sorted((d if d is not None else -1, tuple([*exact(t or ""), 0])) for d, t, _ in rows)
    pieces = defaultdict(list)
    for p in out:
        pieces[p.sequence_id].append((p.offset, p.length))
        assert p.length == len(p.ids) // 4 and p.length <= 1024
    for s in pieces.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    # documents with equal ids can be told apart by their token counts and the order of starts
    docs = defaultdict(list)
    for p in out:
        docs[p.doc_id if p.doc_id is not None else -1].append((p.start, np.frombuffer(p.ids, np.uint32).tolist(), p.doc_tokens))
    assert sum(len(x) for _, x in want) == sum(p.length for p in out)
    for d in docs:
        own = [list(x) for i, x in want if i == d]
        assert sorted(zlib.crc32(np.array(x[s : s + 1024], "<u4").tobytes()) for x in own for s in range(0, len(x), 1024)) == sorted(zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids, _ in docs[d])


def test_little_padding(spark):
    r = random.Random(5)
    rows = [(i, "tok " * r.randint(1, 1500)) for i in range(400)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary=vocabulary()).collect()
    total = sum(p.length for p in out)
    assert 1024 * len({p.sequence_id for p in out}) < 1.03 * total + 1024


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary=vocabulary()).count() == 0
