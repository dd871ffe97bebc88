"""Helpers shared by the corpus operators: scratch tables, native text functions and Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts define it: space and 09 to 0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Text handled by one NumPy step inside an Arrow batch; a single longer text makes a step of its own.
STEP_BYTES = 8 << 20
#: Rows that Spark hands to Python at once while a table is written: texts are long, so fewer than its default.
ARROW_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only where none is named and all runs on one machine, one beside the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what lies there is removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def append(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Add df's rows as Parquet files to a path of scratch_path."""
    spark = df.sparkSession
    former = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, ARROW_ROWS)
    try:
        df.write.mode("append").option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, former)


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends at files that outlive executors."""
    path = scratch_path(df.sparkSession, label)
    append(df, path, codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add under these names (any case)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def steps(batch: pa.RecordBatch, text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        pa.default_memory_pool().release_unused()
        lo = hi


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The texts of a step, nulls as empty ones, copied: some string kernels misread arrays that begin inside a buffer."""
    column = batch.column(name).take(pa.array(np.arange(batch.num_rows)))
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The flat values of a list array and the row of each."""
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.repeat(np.arange(len(lists)), counts)


def token_rows(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, flat, and the row of each word."""
    if lower:
        texts = pc.ascii_lower(texts)
    flat, rows = split_flat(pc.ascii_split_whitespace(texts))
    real = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(real).as_py() and len(flat):
        keep = real.to_numpy(zero_copy_only=False)
        flat, rows = flat.filter(real), rows[keep]
    return flat, rows


def hash_words(flat: pa.Array) -> np.ndarray:
    """64-bit hash of each word, computed once for each distinct word of the step."""
    import xxhash

    if not len(flat):
        return np.zeros(0, np.uint64)
    d = flat.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in d.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(d.dictionary))
    return each[d.indices.to_numpy(zero_copy_only=False)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hash: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word shingle and its row; a text of 1 to k-1 words is one shingle."""
    n = len(word_hash)
    counts = np.bincount(rows, minlength=n_rows)
    short = (counts > 0) & (counts < k)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    out_h, out_r = [], []
    with np.errstate(over="ignore"):
        if n >= k:
            acc = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                acc = mix64(acc + word_hash[j : n - k + 1 + j] + np.uint64(j + 1))
            ok = rows[: n - k + 1] == rows[k - 1 :]
            out_h.append(acc[ok])
            out_r.append(rows[: n - k + 1][ok])
        for r in np.flatnonzero(short):
            acc = np.uint64(0)
            for j in range(counts[r]):
                acc = mix64(acc + word_hash[first[r] + j] + np.uint64(j + 1))
            out_h.append(np.array([acc], np.uint64))
            out_r.append(np.array([r]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def long_lists(values: np.ndarray, rows: np.ndarray, n_rows: int) -> pa.Array:
    """list<int64> for each row from values that stand in row order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64()))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(f, schema)
