"""Operator 3: packing token sequences with a non-negative least-squares plan over the length histogram."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, split_flat, steps, texts_of

#: Words that a worker keeps tokenised.
KEPT_WORDS = 400_000
#: The plan's offsets are broadcast up to this many rows and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


class WordTokenizer:
    """ids of whole texts, word by word.

    No pre-token of the byte-level pattern goes on past a space that stands between two other characters, so a text that
    has only such spaces is the concatenation of its words' ids.  Any other text is tokenised in one piece.  Texts that hold
    an added token of the file go through the file's own tokenizer, which cuts them at those tokens first.
    """

    def __init__(self, path: str):
        """path: the vocabulary as a tokenizers file; its ranks beside it serve the same ids faster."""
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def one(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        return np.array(self.encoding.encode_ordinary(text), np.uint32).tobytes()

    def words(self, values: list[str]) -> list[bytes]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known, out = self.known, []
        for v in values:
            ids = known.get(v)
            if ids is None:
                ids = self.one(v)
                if len(v) < 40:
                    known[v] = ids
            out.append(ids)
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and the count of each text."""
        n = len(texts)
        words, rows = split_flat(pc.split_pattern(texts, " "))
        d = words.dictionary_encode()
        values = d.dictionary.to_pylist()
        odd = np.fromiter((not v or v[0].isspace() or v[-1].isspace() for v in values), bool, len(values))
        at = d.indices.to_numpy(zero_copy_only=False)
        first = np.ones(len(at), bool)
        first[1:] = rows[1:] != rows[:-1]
        whole = np.zeros(n, bool)
        whole[rows[odd[at]]] = True
        for t in self.added:
            whole |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        pool = self.words([" " + v for v in values])
        heads = np.flatnonzero(first)
        places = at.astype(np.int64).copy()
        places[heads] = len(pool) + np.arange(len(heads))  # a text's first word has no space before it
        texts_list = {int(r): texts[int(r)].as_py() for r in np.flatnonzero(whole)}
        pool += [self.one(texts_list[r]) if whole[r] else self.one(values[at[h]]) for r, h in zip(rows[heads], heads, strict=True)]
        used = first | ~whole[rows]
        places, rows = places[used], rows[used]
        lengths = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        starts = np.cumsum(lengths) - lengths
        ids = np.frombuffer(b"".join(pool), np.uint32)
        n_each = lengths[places]
        ends = np.cumsum(n_each)
        total = int(ends[-1]) if len(ends) else 0
        gather = np.arange(total) + np.repeat(starts[places] - (ends - n_each), n_each)
        return ids[gather], np.bincount(rows, weights=n_each, minlength=n).astype(np.int64)


def combinations(window: int) -> np.ndarray:
    """Rows of up to three lengths, zeros for none, that fill the window: all pairs, and triples with a part of few forms."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([a, window - a, np.zeros_like(a)], axis=1)
    small = np.unique(np.concatenate([2 ** np.arange(0, int(np.log2(window))), 3 * 2 ** np.arange(0, int(np.log2(window)) - 1)]))
    triples = [(s, b, window - s - b) for s in small for b in range(s, (window - s) // 2 + 1) if window - s - b >= b]
    return np.unique(np.concatenate([pairs, np.array(triples, np.int64).reshape(-1, 3)]), axis=0)


def nnls_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, where A counts each length in each pattern.

    Accelerated projected gradient steps; A is never built, its products are gathers and weighted counts.
    """
    used = patterns > 0
    size = len(histogram)
    scale = max(1.0, float(histogram.max()))
    target = histogram / scale

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns[used], weights=np.repeat(x, used.sum(axis=1)), minlength=size)

    def back(r: np.ndarray) -> np.ndarray:
        return np.where(used, r[patterns], 0.0).sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(times(y) - target) / (norm * 1.01))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(histogram: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): where the pieces of each length go, by their rank.

    histogram[n] counts the pieces of n tokens.  Rounded least-squares counts are placed first; what they leave is packed
    greedily, largest first, many equal sequences at a time.  Pieces of the whole window, or alone at a power of two that
    nothing completes, need no padding.  The plan depends on the histogram alone, not on the number of documents.
    """
    left = histogram.astype(np.int64).copy()
    taken = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def place(parts: list[int], count: int) -> None:
        nonlocal sequence
        offset = 0
        for n in parts:
            rows.append((n, int(taken[n]), count, sequence, offset))
            taken[n] += count
            left[n] -= count
            offset += n
        sequence += count

    if left[window]:
        place([window], int(left[window]))
    patterns = combinations(window)
    patterns = patterns[((left[patterns] > 0) | (patterns == 0)).all(axis=1)]
    if len(patterns) and left.any():
        counts = nnls_counts(patterns, left)
        for i in np.argsort(-counts, kind="stable"):
            want = int(counts[i])
            if not want:
                break
            parts = [int(n) for n in patterns[i] if n]
            fits = min(left[n] // parts.count(n) for n in set(parts))
            if count := int(min(want, fits)):
                place(parts, count)
    while left.any():
        room, parts = window, []
        free = left.copy()
        while room and (fit := np.flatnonzero(free[: room + 1])).size:
            n = int(fit[-1])
            take = int(min(free[n], room // n))
            parts += [n] * take
            free[n] -= take
            room -= n * take
        place(parts, int(min(left[n] // parts.count(n) for n in set(parts))))
    return rows


def pieces_of(docs: DataFrame, *, text: str, doc_id: str, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """A row for each piece of each document: window tokens, or what is left at the end; rank numbers equal lengths in a task."""
    kind = docs.schema[doc_id].dataType

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(vocabulary)
        task = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            for step in steps(batch, text):
                flat, counts = tokenizer.batch(texts_of(step, text))
                counts = counts + 1
                ends = np.cumsum(counts)
                ids = np.full(int(ends[-1]), end_id, np.uint32)
                inner = np.ones(len(ids), bool)
                inner[ends - 1] = False
                ids[inner] = flat
                n_pieces = -(-counts // window)
                row = np.repeat(np.arange(len(counts)), n_pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * window
                length = np.minimum(window, counts[row] - start)
                order = np.argsort(length, kind="stable")
                by = length[order]
                run = np.arange(len(by)) - np.searchsorted(by, by)
                rank = np.empty(len(by), np.int64)
                rank[order] = run + seen[by]
                seen += np.bincount(length, minlength=window + 1)
                cuts = np.concatenate([[0], np.cumsum(length)]) * 4
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [step.column(doc_id).take(pa.array(row)), pa.array(start), pa.array(length), blobs, pa.array(counts[row]), pa.array(np.full(len(row), task)), pa.array(rank)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "task", "rank"],
                )

    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", long), T.StructField("length", long), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", long), T.StructField("task", long), T.StructField("rank", long)])
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias(text)).mapInArrow(tokenize, schema)


def pack(docs: DataFrame, *, vocabulary: str, text: str = "text", doc_id: str = "doc_id", window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    A document's ids and end_id are cut every `window` tokens; each id lies in one piece.  A null text is empty and gives
    the end alone.  Every row is a document of its own, whatever its id; a null id stays null.  An empty table gives none.
    Only the histogram of lengths, `window` numbers, comes to the driver; the plan made of it is bounded by the window.
    """
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, text=text, doc_id=doc_id, vocabulary=vocabulary, window=window, end_id=end_id), "pieces")
    each = materialize(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(window + 1, np.int64)
    for row in each.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if each.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    schema = "length long, lo long, hi long, seq long, offset long"
    places = spark.createDataFrame([(n, lo, lo + count, seq, off) for n, lo, count, seq, off in plan(histogram, window)], schema)
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the plan has a bounded number of rows, set by the window alone
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"]))
    return placed.select("doc_id", "start", ranked["length"], "ids", "doc_tokens", (F.col("seq") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


__all__ = ["WordTokenizer", "combinations", "nnls_counts", "pack", "plan"]
