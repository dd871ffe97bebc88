"""Operator 7: near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_words, materialize, mix64, shingle_hashes, steps, texts_of, token_rows
from .components import connected_components

#: Bits of a signature's symbol.
SYMBOL_BITS = 16
#: Places of nodes in blocks are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_PAIRS = 100_000
#: Nodes, and shingles of all of them, that a block holds about.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
#: Text turned into shingles at once.
STEP = 2 << 20
#: Shingles hashed at once.
HASH_ROWS = 16384


def distance_bound(symbols: int, similarity: float) -> int:
    """Differing symbols that a pair at the similarity exceeds with a chance of about 1 in 30,000 (four deviations)."""
    return math.ceil(symbols * (1 - similarity) + 4 * math.sqrt(symbols * similarity * (1 - similarity)))


def chunks(symbols: int, bound: int) -> list[tuple[int, int]]:
    """Chunks such that two signatures with at most `bound` differences differ in one symbol at most in some chunk."""
    n = bound // 2 + 1
    ends = [round(symbols * i / n) for i in range(n + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def _coefficients(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        a = mix64(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        b = mix64(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return a, b


def signatures(sets: list[np.ndarray], symbols: int) -> np.ndarray:
    """One row of symbols for each set of 64-bit hashes; sets are not empty."""
    a, b = _coefficients(symbols)
    out = np.full((len(sets), symbols), np.uint32(0xFFFFFFFF))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    with np.errstate(over="ignore"):
        for lo in range(0, len(flat), HASH_ROWS):
            part, who = flat[lo : lo + HASH_ROWS], owner[lo : lo + HASH_ROWS]
            hashed = ((part[:, None] * a[None, :] + b[None, :]) >> np.uint64(32)).astype(np.uint32)
            cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            out[who[cut]] = np.minimum(out[who[cut]], np.minimum.reduceat(hashed, cut, axis=0))
        return (mix64(out.astype(np.uint64)) >> np.uint64(64 - SYMBOL_BITS)).astype(np.uint16)


def index_keys(sigs: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """Keys of each signature: every chunk with each one of its symbols left out, which is all errors a chunk may have."""
    keys = []
    with np.errstate(over="ignore"):
        for c, (lo, hi) in enumerate(parts):
            for gone in range(lo, hi):
                acc = np.full(len(sigs), np.uint64(1 + c * 1000 + gone - lo))
                for j in range(lo, hi):
                    if j != gone:
                        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + sigs[:, j].astype(np.uint64) + np.uint64(1))
                keys.append(mix64(acc))
    return np.stack(keys, axis=1)


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    flat, rows = token_rows(texts, lower=True)
    h, r = shingle_hashes(hash_words(flat), rows, len(texts), k)
    ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(texts)))])
    return [np.unique(h[ends[i] : ends[i + 1]]) for i in range(len(texts))]


def describe(docs: DataFrame, *, text: str, doc_id: str, k: int, symbols: int) -> DataFrame:
    """id, n, set_id, sig for each document; the set's digest tells equal sets."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, text, STEP):
                sets = sets_of(texts_of(step, text), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs: list[bytes | None] = [None] * len(sets)
                if full:
                    made = signatures([sets[i] for i in full], symbols)
                    for i, row in zip(full, made, strict=True):
                        sigs[i] = row.tobytes()
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([step.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["id", "n", "set_id", "sig"])

    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("sig", T.BinaryType())])
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias(text)).mapInArrow(run, schema)


def _keyed(classes: DataFrame, symbols: int, parts: list[tuple[int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, symbols)
            keys = index_keys(sigs, parts)
            node = np.repeat(np.arange(len(sigs)), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column("node").take(pa.array(node))], ["key", "node"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", classes.schema["node"].dataType)])
    return classes.select("node", "sig").mapInArrow(run, schema)


def _links(sets: list[np.ndarray], sigs: np.ndarray, labels: np.ndarray, first: int, bound: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join components: rows from `first` on are held against all rows before them and not in their component.

    Signatures pass only pairs within the distance bound; full sets decide.  A row that has joined a component isn't held
    against the rest of it, so the work shrinks as components grow, and fewer links than rows are given.
    """
    out: list[tuple[int, int]] = []
    sizes = np.array([len(s) for s in sets])
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    seen = np.zeros(len(vocabulary), bool)
    for i in range(max(first, 1), len(sets)):
        n = sizes[:i]
        other = np.flatnonzero((labels[:i] != labels[i]) & (np.minimum(n, sizes[i]) * den >= np.maximum(n, sizes[i]) * num))
        other = other[(sigs[other] != sigs[i]).sum(axis=1) <= bound]
        if not len(other):
            continue
        own = ids[ends[i] - sizes[i] : ends[i]]
        seen[own] = True
        flat = np.concatenate([ids[ends[j] - sizes[j] : ends[j]] for j in other])
        both = np.add.reduceat(seen[flat].astype(np.int64), np.cumsum(sizes[other]) - sizes[other])
        seen[own] = False
        for j in other[den * both >= num * (sizes[other] + sizes[i] - both)]:
            if labels[j] != labels[i]:
                out.append((int(j), i))
                labels[labels == labels[j]] = labels[i]
    return out


def family_links(rows: DataFrame, docs: DataFrame, *, text: str, doc_id: str, k: int, num: int, den: int, symbols: int, bound: int) -> DataFrame:
    """Links (a, b) inside blocks.  rows: centre, block, role, id, component, sig; a written table.

    Rows of role 0 are held against each other, unless there are rows of role 1; then only those are held against the
    former.  Texts are sent to their blocks; a block is bounded in rows and in shingles, and rows of role 1 pass through.
    """
    kind = docs.schema[doc_id].dataType
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    sent = source.join(F.broadcast(rows) if rows.count() <= BROADCAST_PAIRS else rows, "id")
    dealt = sent.repartition("centre", "block").sortWithinPartitions("centre", "block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        base: list[tuple] = []
        probes: list[tuple] = []
        probed = False
        found: list[tuple] = []
        like = None

        def compare() -> None:
            nonlocal probes, probed
            held = base + probes
            if base and len(held) > 1 and (probes or not probed):
                names = {c: i for i, c in enumerate(dict.fromkeys(h[3] for h in held))}
                labels = np.array([names[h[3]] for h in held])
                sigs = np.frombuffer(b"".join(h[2] for h in held), np.uint16).reshape(-1, symbols)
                for i, j in _links([h[1] for h in held], sigs, labels, len(base) if probes else 0, bound, num, den):
                    found.append((held[i][0], held[j][0]))
            probes = []

        for batch in batches:
            like = batch.schema.field("id").type
            for step in steps(batch, "text", STEP):
                sets = sets_of(texts_of(step, "text"), k)
                columns = (step.column(c).to_pylist() for c in ("centre", "block", "role", "id", "sig", "component"))
                for s, centre, block, role, who, sig, component in zip(sets, *columns, strict=True):
                    if (centre, block) != now:
                        compare()
                        now, base, probed = (centre, block), [], False
                    if not len(s):
                        continue
                    if role == 0:
                        base.append((who, s, sig, component))
                    else:
                        probed = True
                        probes.append((who, s, sig, component))
                        if len(probes) >= BLOCK:
                            compare()
                if len(found) > 10_000:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], like), "b": pa.array([f[1] for f in found], like)})
                    found = []
        compare()
        if found:
            yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], like), "b": pa.array([f[1] for f in found], like)})

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return dealt.select("centre", "block", "role", "id", "component", "sig", "text").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", k: int = 3, num: int = 85, den: int = 100, symbols: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row: documents linked where den * |A and B| >= num * |A or B|.

    A and B are sets of k-word shingles of the lower-cased texts.  Equal sets are one node, so copies are never paired.
    Nodes meet in buckets by the index keys of their signatures: every pair within the distance bound shares one.  Buckets
    with the same smallest node form its family.  Families are cut into blocks; inside a block every pair that isn't in one
    component yet is held together by signature and then by full sets.  Where a family has several blocks and components,
    the nodes outside its largest component are then held against its other blocks.  So every pair of a bucket is decided,
    and what is written is fewer links than nodes.  component_id is the smallest id reachable.
    Rows with equal ids are one document; a null id takes no part and is kept with a null component; empty texts are alone.
    """
    bound = distance_bound(symbols, num / den)
    parts = chunks(symbols, bound)
    described = materialize(describe(docs, text=text, doc_id=doc_id, k=k, symbols=symbols), "signatures")
    classes = described.filter("id IS NOT NULL AND n > 0").groupBy("set_id").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes, "classes")
    keyed = _keyed(classes, symbols, parts)
    centres = materialize(keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "centre"), "centres")
    pairs = keyed.join(centres, "key").select("centre", "node").distinct()
    members = materialize(pairs.join(classes.select("node", "n", "sig"), "node"), "members")
    sizes = members.groupBy("centre").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).filter("m > 1")
    sizes = materialize(sizes.select("centre", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("long").alias("blocks")), "families")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = materialize(members.join(sizes, "centre").select("centre", own.alias("block"), "blocks", F.col("node").alias("id"), "sig"), "placed")
    how = dict(text=text, doc_id=doc_id, k=k, num=num, den=den, symbols=symbols, bound=bound)
    first = materialize(placed.select("centre", "block", F.lit(0).alias("role"), "id", F.col("id").alias("component"), "sig"), "blocks")
    links = materialize(family_links(first, docs, **how), "links")
    components = materialize(connected_components(links), "components")
    wide = placed.filter("blocks > 1")
    if wide.limit(1).count():
        wide = materialize(wide.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "wide")
        largest = wide.groupBy("centre", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("centre").agg(F.max_by("component", F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
        largest = materialize(largest.select("centre", "most"), "largest")
        open_ = wide.join(largest, "centre")
        probes = open_.filter("component <> most").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("to <> block")
        columns = ["id", "component", "sig"]
        second = open_.select("centre", "block", F.lit(0).alias("role"), *columns).unionByName(probes.select("centre", F.col("to").alias("block"), F.lit(1).alias("role"), *columns))
        found = materialize(family_links(materialize(second, "blocks"), docs, **how), "links")
        if found.limit(1).count():
            components = materialize(connected_components(links.unionByName(found)), "components")
    of_set = classes.join(components, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    of_set = materialize(of_set, "set-components")
    out = described.select("id", "n", "set_id").join(of_set, "set_id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


__all__ = ["chunks", "distance_bound", "near_duplicates", "signatures"]
