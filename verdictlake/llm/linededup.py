"""Operator 9: line deduplication with two Bloom filters and an exact check of the suspects."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, append, free_name, materialize, scratch_path, split_flat, steps, texts_of

#: Filter size: bits for each line, and the bounds of one filter.  Beyond the bound keys are cut into ranges with filters of their own.
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
HASHES = 4
SLICE_BYTES = 1 << 14
#: Filters that are built at once; each is as large as the whole.
MOST_FILTERS = 1024


def line_keys(texts: pa.Array, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines, the row of each, the 16-byte digest of its key and whether the key is long enough."""
    lines, rows = split_flat(pc.split_pattern(texts, "\n"))
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=SPACE))
    long = pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False).astype(bool)
    digests = np.zeros((len(keys), 2), np.uint64)
    if long.any():
        d = keys.filter(pa.array(long)).dictionary_encode()
        each = b"".join(hashlib.md5(k).digest() for k in d.dictionary.cast(pa.large_binary()).to_pylist())
        digests[long] = np.frombuffer(each, np.uint64).reshape(-1, 2)[d.indices.to_numpy(zero_copy_only=False)]
    return lines, rows, digests, long


def _places(digests: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((digests[:, :1] + np.arange(HASHES, dtype=np.uint64) * (digests[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def _has(filter_: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((filter_[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)


def _add(filter_: np.ndarray, places: np.ndarray) -> None:
    at = places.ravel()
    np.bitwise_or.at(filter_, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _once_each(digests: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs."""
    order = np.lexsort((digests[:, 0], digests[:, 1], rows))
    d, r = digests[order], rows[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1]).any(axis=1)
    return d[new], r[new]


def written_keys(docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """id, a, b: the halves of the digest of each long enough key of each document, once a row, sorted inside each file.

    Nothing is shuffled; a range of keys is a few pages of each file, as the reader skips pages by their bounds.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, text):
                _, rows, digests, long = line_keys(texts_of(step, text), least)
                d, r = _once_each(digests[long], rows[long])
                if len(d):
                    a, b = (np.ascontiguousarray(d[:, j]).view(np.int64) for j in (0, 1))
                    yield pa.RecordBatch.from_arrays([step.column(doc_id).take(pa.array(r)), pa.array(a), pa.array(b)], ["id", "a", "b"])

    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return materialize(docs.filter(F.col(doc_id).isNotNull()).select(doc_id, text).mapInArrow(keys, schema).sortWithinPartitions("a"), "line-keys", "lz4")


def _digests(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("a", "b")])


def repeated_filter(keys: DataFrame, bits: int) -> bytes:
    """The twice-seen filter: it holds every key that two rows have, and some others.

    Each task fills its own pair of filters over the rows it reads; pairs are merged slice by slice, and what one pair
    has seen once and another has seen once counts as seen twice.  Only filters of fixed size are moved, no lines.
    """
    spark = keys.sparkSession

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            digests = _digests(batch)
            # np.unique on pairs is slow; the first half of the digest stands for the whole, which can only add suspects
            _, at, n = np.unique(digests[:, 0], return_index=True, return_counts=True)
            places = _places(digests[at], bits)
            again = _has(once, places) | (n > 1)
            _add(twice, places[again])
            _add(once, places)
        part = TaskContext.get().partitionId()
        for lo in range(0, bits // 8, SLICE_BYTES):
            o, t = once[lo : lo + SLICE_BYTES], twice[lo : lo + SLICE_BYTES]
            if o.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([lo // SLICE_BYTES], pa.int32()), "part": pa.array([part], pa.int32()), "once": pa.array([o.tobytes()], pa.binary()), "twice": pa.array([t.tobytes()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(SLICE_BYTES, np.uint8), np.zeros(SLICE_BYTES, np.uint8)
        for o, t in zip(table["once"], table["twice"], strict=True):
            o, t = np.frombuffer(o.as_py(), np.uint8), np.frombuffer(t.as_py(), np.uint8)
            n = len(o)
            twice[:n] |= t | (once[:n] & o)
            once[:n] |= o
        size = min(SLICE_BYTES, bits // 8)
        return pa.table({"slice": table["slice"].slice(0, 1), "part": pa.array([0], pa.int32()), "once": pa.array([once[:size].tobytes()], pa.binary()), "twice": pa.array([twice[:size].tobytes()], pa.binary())})

    schema = "slice int, part int, once binary, twice binary"
    few = min(MOST_FILTERS, max(1, spark.sparkContext.defaultParallelism))
    filled = keys.select("a", "b").coalesce(few).mapInArrow(fill, schema)
    merged = filled.groupBy("slice").applyInArrow(merge, schema).select("slice", "twice")
    whole = bytearray(bits // 8)  # bounded by MOST_BITS, whatever the corpus
    for row in merged.toLocalIterator():
        whole[row["slice"] * SLICE_BYTES : row["slice"] * SLICE_BYTES + len(row["twice"])] = row["twice"]
    return bytes(whole)


def suspected(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least: int = 10, most_bits: int = MOST_BITS) -> DataFrame:
    """id, key: the documents' keys that the twice-seen filters hold; every key of two documents is among them.

    Keys are written once.  Where a filter of `most_bits` is too small for all of them, they are cut into ranges of the
    digest, each with a pair of filters of its own: filters, what a task holds and what is broadcast stay within the
    bound, and bits follow the lines.
    """
    spark = docs.sparkSession
    keys = written_keys(docs, text, doc_id, least)
    n = keys.count()
    ranges = max(1, -(-n * BITS_PER_LINE // most_bits))
    bits = LEAST_BITS
    while bits < most_bits and bits < BITS_PER_LINE * n / ranges:
        bits *= 2
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("key", T.BinaryType())])
    path = scratch_path(spark, "line-suspects")
    for r in range(ranges):
        low, high = (-(1 << 63) + (i << 64) // ranges for i in (r, r + 1))
        part = keys if ranges == 1 else keys.filter(F.col("a").between(low, high - 1))
        shared = spark.sparkContext.broadcast(repeated_filter(part, bits))

        def suspect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            twice = np.frombuffer(shared.value, np.uint8)
            for batch in batches:
                digests = _digests(batch)
                hit = _has(twice, _places(digests, bits))
                if hit.any():
                    raw = np.ascontiguousarray(digests[hit]).tobytes()
                    yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(hit)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(raw) // 16, [None, pa.py_buffer(raw)]).cast(pa.binary())], ["id", "key"])

        append(part.mapInArrow(suspect, schema), path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


def line_dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least: int = 10, most_bits: int = MOST_BITS) -> DataFrame:
    """Drop lines that an earlier document has, and give the documents with n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case.  A key of `least` code
    points or more that two documents hold loses all its lines except in the smallest id holding it.  A null text counts
    as one empty line and stays null if nothing else is to be said of it: it becomes the empty text.  Rows with equal ids
    are one document; rows with a null id take no part and keep all lines.  Columns named n_lines or n_dropped are
    replaced; the others stay.
    """
    key = free_name(docs, "__line_keys")
    suspects = suspected(docs, text=text, doc_id=doc_id, least=least, most_bits=most_bits)
    # exact: the first holder of each key that two documents have
    winners = materialize(suspects.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("key", "first"), "line-winners")
    drops = suspects.join(winners, "key").filter("id > first").groupBy(F.col("id").alias(free_name(docs, "__id"))).agg(F.collect_set("key").alias(key))
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    joined = base.join(drops, base[doc_id] == drops[free_name(docs, "__id")], "left").drop(free_name(docs, "__id"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, text):
                texts = texts_of(step, text)
                dropped = np.zeros(step.num_rows, np.int64)
                gone = step.column(key)
                out = texts.to_pylist()
                n_lines = pc.add(pc.count_substring(texts, "\n"), 1)
                hit = np.flatnonzero(pc.is_valid(gone).to_numpy(zero_copy_only=False))
                if len(hit):
                    lines, rows, digests, long = line_keys(texts.take(pa.array(hit)), least)
                    values = lines.to_pylist()
                    raw = digests.tobytes()
                    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(hit)))])
                    for j, r in enumerate(hit):
                        bad = set(gone[int(r)].as_py())
                        keep = [i for i in range(ends[j], ends[j + 1]) if not (long[i] and raw[16 * i : 16 * i + 16] in bad)]
                        dropped[r] = ends[j + 1] - ends[j] - len(keep)
                        out[r] = "\n".join([values[i] for i in keep])
                columns = {c: step.column(c) for c in step.schema.names if c != key}
                columns[text] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_pydict(columns | {"n_lines": n_lines.cast(pa.int64()), "n_dropped": pa.array(dropped)})

    result = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(rewrite, result)
