"""Operator 13: bytes of repeated 200-byte strings, found by a hash-compared suffix sort of strings that share an anchor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import append, free_name, materialize, mix64, scratch_path, steps, texts_of, without

#: Bytes of a string that counts as repeated, and of a gram that may be an anchor.
LEAST, GRAM = 200, 40
#: Text hashed at once, anchors gathered before they are told apart, text sorted at once.
STEP, GATHERED, CHUNK = 2 << 20, 1 << 17, 2 << 20
#: Distinct contexts of one anchor that are sorted together; more are sorted in parts, and parts exchange hashes of strings.
MOST_GROUP = 1024
#: Documents sampled for grams that are anchors only where a string holds no other, and how many of them must hold such a gram.
SAMPLE, OFTEN = 2048, 16
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_ADDED = (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()))


class Prefixes:
    """Prefix polynomial hashes of a text modulo 2^64; strings of equal length are compared in constant time."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, text: np.ndarray, base: np.uint64 = BASES[0]) -> None:
        self.powers, self.inverse = self._grown(base, len(text) + 1)
        values = mix64(np.arange(1, 257, dtype=np.uint64) * base)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values[text] * self.powers[: len(text)], out=self.sums[1:])

    @classmethod
    def _grown(cls, base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
        known = cls._powers.get(int(base))
        if known is None or len(known[0]) < n:
            size = max(1 << 16, n + n // 4)
            known = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, np.uint64(pow(int(base), -1, 1 << 64))))
            cls._powers[int(base)] = known
        return known

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hash of the string of this length at each place."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[at + length] - self.sums[at]) * self.inverse[at])

    def common(self, x: np.ndarray, y: np.ndarray, least: int, most: int) -> np.ndarray:
        """Length of the common extension of x and y, known to be `least` and looked at up to `most`: a binary search."""
        lo, hi = np.full(len(x), least), np.full(len(x), most)
        a, b = np.minimum(x, y), np.maximum(x, y)
        shift, from_a, from_b = self.powers[b - a], self.sums[a], self.sums[b]
        with np.errstate(over="ignore"):
            for _ in range(int(most - least).bit_length()):
                mid = (lo + hi + 1) >> 1
                same = (self.sums[a + mid] - from_a) * shift == self.sums[b + mid] - from_b
                lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo


def suffix_order(text: np.ndarray, prefixes: Prefixes, at: np.ndarray, groups: np.ndarray, least: int, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `at` by group and first `least` bytes, and where one equals the one before it.

    A merge sort of all groups at once: runs double, and the place of a suffix in the run beside its own is found by
    binary search.  A comparison takes the common extension from the hashes and then one byte.  Suffixes of a group must
    agree on `head` bytes.  Pairs found equal are compared byte by byte.
    """
    order = np.argsort(groups, kind="stable")
    g = groups[order]
    begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(g)))
    base, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    width = 1
    while len(sizes) and width < sizes.max():
        slots = np.flatnonzero(size > width)
        b, m = base[slots], size[slots]
        k = slots - b
        run = k // width
        lo = np.minimum((run ^ 1) * width, m)
        hi = np.minimum(lo + width, m)
        right, mine, start = (run & 1).astype(bool), order[slots], lo.copy()
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) >> 1
            x, y = at[order[b[live] + mid]], at[mine[live]]
            n = prefixes.common(x, y, head, least)
            differ = n < least
            n = np.where(differ, n, 0)
            less = differ & (text[x + n] < text[y + n]) | ~differ & right[live]  # equal ones of the left run come first
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        moved = order.copy()
        moved[b + (run >> 1) * 2 * width + (k - run * width) + (lo - start)] = mine
        order, width = moved, 2 * width
    same = np.zeros(len(order), bool)
    pairs = np.flatnonzero(np.arange(len(order)) > base)
    if len(pairs):
        x, y = at[order[pairs - 1]], at[order[pairs]]
        equal = prefixes.common(x, y, head, least) >= least
        for part in np.array_split(np.flatnonzero(equal), 1 + int(equal.sum()) * least // STEP):
            equal[part] = (text[x[part, None] + np.arange(least)] == text[y[part, None] + np.arange(least)]).all(axis=1)
        same[pairs] = equal
    return order, same


class Often:
    """Hashes of grams that many documents hold."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, g: np.ndarray) -> np.ndarray:
        out = self.bits[(g & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.hashes, g[at]), len(self.hashes) - 1)
            out[at] = self.hashes[place] == g[at]
        return out


def anchors(text: np.ndarray, first: np.ndarray, often: Often, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last, key): each string of `least` bytes of a row has one anchor, and strings that follow each other often the same.

    The anchor is the place of the gram with the smallest hash in the string, the leftmost of equal ones; grams that many
    documents hold come after all others.  It depends on the string alone, so equal strings have equal anchors at
    equal offsets.
    """
    none = np.zeros(0, np.int64)
    n, w = len(text), least - gram + 1
    if n < least:
        return none, none, none, none, none.astype(np.uint64)
    g = Prefixes(text).of(np.arange(n - gram + 1), gram)
    v = (g >> np.uint64(33) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    if len(often.hashes):
        v[often(g)] |= np.uint64(1 << 63)
    padded = np.full(-(-len(v) // w) * w, np.uint64(2**64 - 1))
    padded[: len(v)] = v
    tiles = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(behind[: n - least + 1], ahead[w - 1 : n - least + w]) & np.uint64((1 << 32) - 1)).astype(np.int64)
    ends = np.repeat(first[1:], np.diff(first))[: n - least + 1]
    p = np.flatnonzero(np.arange(n - least + 1) + least <= ends)
    a = chosen[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    begin = np.flatnonzero(new)
    last = p[np.append(begin[1:], len(p)) - 1] if len(p) else none
    a = a[begin]
    return np.searchsorted(first, a, side="right") - 1, a, p[begin], last, g[a]


def _bytes_of(step: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts of a step, and where each begins."""
    texts = texts_of(step, text).cast(pa.large_binary())
    first = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return np.frombuffer(b"".join(texts.to_pylist()), np.uint8), first


def _told(text: str) -> Column:
    """31 bits of a text's hash: they tell rows of equal id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND((1 << 31) - 1)


def _often(docs: DataFrame, gram: int, sample: int, often: int) -> Often:
    """Grams of a bounded sample of documents that at least `often` of them hold; they steer anchors and change no result."""
    every = max(1, docs.count() // sample)
    drawn = docs.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).repartition(4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for step in steps(batch, "text", STEP):
                text, first = _bytes_of(step, "text")
                for lo, hi in zip(first, first[1:], strict=False):
                    if hi - lo >= gram:
                        held.append(np.unique(Prefixes(text[lo:hi]).of(np.arange(hi - lo - gram + 1), gram)))
        g, n = np.unique(np.concatenate(held), return_counts=True)
        g, n = g[n > 1], n[n > 1]
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["g", "n"])

    found = drawn.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= often).select("g")
    return Often(np.array([r.g for r in found.toLocalIterator()], np.int64).view(np.uint64))


#: Fields of an anchor's `info`: bytes of its strings together, bytes of them before the anchor, and the row's part.
BEFORE, PART = 31, 51
#: Parts of a row: a context met once, one that speaks for several, and a span of strings that are known to be repeated.
ONE, SEVERAL, SPAN = 1, 2, 3


def _places(docs: DataFrame, often, least: int, gram: int) -> DataFrame:
    """id, place, info, known, many, ship: spans that are known to be repeated, and places whose strings must be sorted.

    The strings of an anchor make its context.  A context met twice is repeated as a whole (`known`); where a gram has
    several contexts, one place of each is sorted against the others (`ship`), `many` if the context is met elsewhere.
    Contexts are told apart by the gram's hash and their own.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for step in steps(batch, "text", STEP):
                text, first = _bytes_of(step, "text")
                row, a, p0, p1, key = anchors(text, first, often.value, least, gram)
                size = p1 - p0 + least
                kind = mix64(Prefixes(text).of(p0, size) + ((a - p0) << 20 | size).astype(np.uint64))
                told = step.column("told").to_numpy(zero_copy_only=False)
                held.append((key, kind, step.column("id").take(pa.array(row)), told[row] << 32 | (p0 - first[row]), size, a - p0))
            if sum(len(h[0]) for h in held) >= GATHERED:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        """A row for each context; places of one met several times here are spans, joined where they overlap."""
        key, kind, _, place, size, before = (np.concatenate([h[i] for h in held]) if i != 2 else None for i in range(6))
        ids = pa.concat_arrays([h[2] for h in held])
        order = np.lexsort((kind, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (kind[order][1:] != kind[order][:-1])
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(order)))
        one, speaks = order[begin], np.where(n > 1, SEVERAL, ONE)
        met = np.ones(len(order), bool)
        met[one[n == 1]] = False
        at = np.flatnonzero(met)  # in the order of documents and places
        joins = np.zeros(len(at), bool)
        joins[1:] = (at[1:] == at[:-1] + 1) & (place[at][1:] > place[at][:-1]) & (place[at][1:] <= place[at][:-1] + size[at][:-1])
        heads = np.flatnonzero(~joins)
        tails = np.append(heads[1:], len(at)) - 1 if len(heads) else heads
        whole = (place + size)[at][tails] - place[at][heads]
        info = np.concatenate([size[one] | before[one] << BEFORE | speaks << PART, whole | SPAN << PART])
        take = np.concatenate([one, at[heads]])
        deal = np.concatenate([key[one], mix64(place[at[heads]].view(np.uint64))]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(deal), pa.array(np.concatenate([kind[one].view(np.int64), np.zeros(len(heads), np.int64)])), pa.array(info), ids.take(pa.array(take)), pa.array(place[take])], ["deal", "kind", "info", "id", "place"])

    schema = T.StructType([T.StructField("deal", T.LongType()), T.StructField("kind", T.LongType()), T.StructField("info", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("place", T.LongType())])
    part, gram_, context = F.shiftright("info", PART), Window.partitionBy("deal"), Window.partitionBy("deal", "kind")
    found = docs.mapInArrow(scan, schema).withColumn("part", part).withColumn("nth", F.row_number().over(context.orderBy("place", "id")))
    found = found.withColumn("met", F.sum(F.when(F.col("part") < SPAN, F.col("part")).otherwise(0)).over(context)).withColumn("kinds", F.min("kind").over(gram_) != F.max("kind").over(gram_))
    many, real = F.col("met") > 1, F.col("part") < SPAN
    out = found.select("id", "place", F.col("info").bitwiseAND((1 << BEFORE) - 1).cast("int").alias("length"), many.alias("many"), (~real | ((F.col("part") == ONE) & many)).alias("known"), (real & F.col("kinds") & (F.col("nth") == 1)).alias("ship"))
    return out.filter("known OR ship")


def _contexts(docs: DataFrame, places: DataFrame, often, least: int, gram: int) -> DataFrame:
    """deal, bytes, before, many, id, place of the contexts to be sorted: all strings of an anchor, and the bytes before it."""
    packed = F.col("place").bitwiseAND((1 << 32) - 1) * 2 + F.col("many").cast("int")
    asked = places.filter("ship").groupBy(F.col("id").alias("__id"), F.shiftright("place", 32).alias("__told")).agg(F.collect_list(packed).alias("places"))
    joined = docs.join(asked, docs["id"].eqNullSafe(F.col("__id")) & (docs["told"] == F.col("__told"))).select("id", "told", "text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text", STEP):
                text, first = _bytes_of(step, "text")
                row, a, p0, p1, key = anchors(text, first, often.value, least, gram)
                places = step.column("places")
                values = places.flatten().to_numpy(zero_copy_only=False)
                wanted = np.zeros(len(text) + 1, np.int8)
                wanted[(values >> 1) + np.repeat(first[:-1], pc.list_value_length(places).to_numpy(zero_copy_only=False))] = 1 + (values & 1)
                keep = np.flatnonzero(wanted[p0])
                raw, r, told = text.tobytes(), row[keep], step.column("told").to_numpy(zero_copy_only=False)
                strings = pa.array([raw[i:j] for i, j in zip(p0[keep].tolist(), (p1[keep] + least).tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), strings, pa.array((a - p0)[keep].astype(np.int32)), pa.array(wanted[p0[keep]] == 2), step.column("id").take(pa.array(r)), pa.array(told[r] << 32 | (p0[keep] - first[r]))], ["deal", "bytes", "before", "many", "id", "place"])

    schema = T.StructType([T.StructField("deal", T.LongType()), T.StructField("bytes", T.BinaryType()), T.StructField("before", T.IntegerType()), T.StructField("many", T.BooleanType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("place", T.LongType())])
    return joined.mapInArrow(cut, schema)


class _Group:
    """Distinct contexts of one gram: (bytes, bytes before the anchor, whether it is met elsewhere, id, place)."""

    def __init__(self, key: int, parts: bool) -> None:
        self.key, self.parts, self.size = key, parts, 0
        self.kinds: list[tuple] = []


def _sorted_spans(groups: list[_Group], least: int, schema: pa.Schema) -> pa.RecordBatch:
    """Spans of the strings that two contexts of a group have in common; parts of a group also give their strings' hashes."""
    spans, kinds, whole = [], [], []
    for n, group in enumerate(groups):
        if len(group.kinds) > 1 or group.parts:
            kinds += group.kinds
            whole += [(n, group.parts)] * len(group.kinds)
    if kinds:
        text = np.frombuffer(b"".join(k[0] for k in kinds), np.uint8)
        sizes = np.array([len(k[0]) for k in kinds])
        counts, starts = sizes - least + 1, np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(kinds)), counts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        at, before = starts[of] + nth, np.array([k[1] for k in kinds])[of] - nth
        number = np.array([w[0] for w in whole])[of]
        # equal strings lie in one group, as far before the anchor, and begin alike
        head = min(8, least)
        begin = np.zeros(len(at), np.uint64)
        for j in range(head):
            begin = begin << np.uint64(8) | text[at + j].astype(np.uint64)
        order = np.lexsort((begin, before, number))
        differ = np.zeros(len(order), bool)
        for c in (begin, before, number):
            differ[1:] |= c[order][1:] != c[order][:-1]
        alike = np.empty(len(order), np.int64)
        alike[order] = np.cumsum(differ)
        _, back, n = np.unique(alike, return_inverse=True, return_counts=True)
        among = np.flatnonzero(n[back] > 1)
        prefixes = Prefixes(text)
        again = np.zeros(len(at), bool)
        first = np.ones(len(at), bool)  # of equal strings, the one that speaks for them
        if len(among):
            sub, same = suffix_order(text, prefixes, at[among], alike[among], least, head)
            again[among[sub[same]]] = True
            again[among[sub[np.flatnonzero(same) - 1]]] = True
            first[among[sub[same]]] = False
        many = np.array([k[2] for k in kinds])[of]
        found = np.flatnonzero(again & ~many)
        if len(found):  # strings that follow each other in one context are one span
            joins = np.zeros(len(found), bool)
            joins[1:] = (of[found][1:] == of[found][:-1]) & (nth[found][1:] == nth[found][:-1] + 1)
            begins = np.flatnonzero(~joins)
            for lo, hi in zip(begins, np.append(begins[1:], len(found)), strict=True):
                i, j = found[lo], found[hi - 1]
                id_, place = kinds[of[i]][3:]
                spans.append((id_, place + int(nth[i]), int(nth[j] - nth[i]) + least, None, None, None))
        told = np.flatnonzero(first & np.array([w[1] for w in whole])[of])
        if len(told):
            one, two = prefixes.of(at[told], least).view(np.int64), Prefixes(text, BASES[1]).of(at[told], least).view(np.int64)
            # equal strings of which one stands in many places are in many places
            heavy = again | many
            for i, h1, h2 in zip(told, one, two, strict=True):
                id_, place = kinds[of[i]][3:]
                spans.append((id_, place + int(nth[i]), least, int(h1), int(h2), 2 if heavy[i] else 1))
    return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], f.type) for i, f in enumerate(schema)], schema=schema)


def repeated_spans(docs: DataFrame, *, least: int = LEAST, gram: int = GRAM, most_group: int = MOST_GROUP, sample: int = SAMPLE, often: int = OFTEN) -> DataFrame:
    """id, told, spans: where strings of `least` bytes lie in a document of docs (id, told, text) that also stand elsewhere."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(_often(docs, gram, sample, often))  # bounded by the sample
    places = materialize(_places(docs, common, least, gram), "suffix-places")
    contexts = _contexts(docs, places, common, least, gram)
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("place", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("weight", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[_Group] = []
        group = None
        for batch in batches:
            for key, *kind in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if group is None or key != group.key or len(group.kinds) >= most_group:
                    parts = group is not None and key == group.key
                    if group:
                        group.parts |= parts
                        ready.append(group)
                    group = _Group(key, parts)
                group.kinds.append(tuple(kind))
                group.size += len(kind[0])
            if sum(g.size for g in ready) >= CHUNK:
                yield _sorted_spans(ready, least, arrow)
                ready = []
        if group:
            yield _sorted_spans([*ready, group], least, arrow)

    path = scratch_path(spark, "suffix-spans")
    append(contexts.repartition("deal").sortWithinPartitions("deal").mapInArrow(sort, schema), path)
    found = spark.read.schema(schema).parquet(path)
    asks = found.filter(F.col("h1").isNotNull()).withColumn("n", F.sum("weight").over(Window.partitionBy("h1", "h2")))
    spans = places.filter("known").select("id", "place", "length").unionByName(found.filter(F.col("h1").isNull()).select("id", "place", "length")).unionByName(asks.filter((F.col("n") > 1) & F.col("place").isNotNull()).select("id", "place", "length"))
    return spans.groupBy("id", F.shiftright("place", 32).alias("told")).agg(F.collect_set(F.struct(F.col("place").bitwiseAND((1 << 32) - 1).alias("start"), F.col("length").cast("long").alias("length"))).alias("spans"))


def repeated_bytes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep_bytes: bool = False, **settings) -> DataFrame:
    """docs without text, with n_bytes, n_removed, n_spans and kept_sha256: every byte of a string that stands twice is removed.

    A string is `least` bytes (200) of one document's UTF-8 text; it stands twice if it also starts at any other place of
    any document, the same one included.  All bytes of such strings go, judged on the texts as given.  n_spans counts
    the longest runs of removed bytes; the hash is of the bytes that stay.  `keep_bytes` adds these as `kept`.  A
    null text is empty.  Every row is a document of its own: repeated rows lose each other's strings, whatever their
    ids, and a null id is kept.  Other columns stay; those that the operator adds replace columns of the same name.

    Every string has an anchor, a gram chosen by its content alone.  The strings of an anchor lie in one context; equal
    contexts, which their hashes tell, are repeated as a whole and stand once for all.  Different contexts of a gram are
    brought together and their strings sorted as suffixes; neighbours that agree on `least` bytes are repeated.
    """
    told, spans = free_name(docs, "__told"), free_name(docs, "__spans")
    plain = docs.select(F.col(f"`{doc_id}`").alias("id"), _told(text).alias("told"), F.col(f"`{text}`").alias("text"))
    found = repeated_spans(plain, **settings).select(F.col("id").alias("__id"), F.col("told").alias("__told2"), F.col("spans").alias(spans))
    base = without(docs, *[n for n, _ in _ADDED], *(["kept"] if keep_bytes else []))
    joined = base.withColumn(told, _told(text)).join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col(told) == F.col("__told2")), "left").drop("__id", "__told2", told)
    stays = [c for c in base.columns if c != text]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, text):
                raws = texts_of(step, text).cast(pa.large_binary()).to_pylist()
                removed, counts, digests, kepts = [], [], [], []
                for raw, own in zip(raws, step.column(spans).to_pylist(), strict=True):
                    gone = n = end = 0
                    kept = []
                    for start, stop in sorted((s["start"], s["start"] + s["length"]) for s in own or ()):
                        if start > end or not n:
                            kept.append(raw[end:start])
                            n += 1
                            gone += stop - start
                            end = stop
                        elif stop > end:
                            gone += stop - end
                            end = stop
                    kept.append(raw[end:])
                    removed.append(gone)
                    counts.append(n)
                    kepts.append(b"".join(kept))
                    digests.append(hashlib.sha256(kepts[-1]).hexdigest())
                columns = {c: step.column(c) for c in stays} | {"n_bytes": pa.array([len(r) for r in raws], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(counts, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
                yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kepts, pa.binary())} if keep_bytes else {}))

    out = T.StructType([*[base.schema[c] for c in stays], *[T.StructField(n, t) for n, t in _ADDED], *([T.StructField("kept", T.BinaryType())] if keep_bytes else [])])
    return joined.mapInArrow(remove, out)
