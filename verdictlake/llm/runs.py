"""Operator 11: periodic runs of words, from longest previous factors, their blocks and extensions at block boundaries."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import steps, texts_of, token_rows, without

#: A run spans LEAST_WORDS words and LEAST_TIMES periods at least.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: A run agrees with itself, a period on, on five words at least; doubling tells which rows repeat this many.
COMMON = 4
RESULT = (("n_runs", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("period", T.LongType()), ("exponent_milli", T.LongType()), ("runs_sha256", T.StringType()), ("collapsed_sha256", T.StringType()))


def suffix_ranks(ids: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each suffix among all suffixes of its row (rows in order), and which rows repeat COMMON words.

    Prefix doubling over all rows at once; suffixes that are alone with their first words leave it.  A row in which no
    COMMON words stand twice has no run.
    """
    n = len(ids)
    first = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))])
    ends = first[rows + 1] if n else np.zeros(0, np.int64)
    order = np.lexsort((ids, rows))
    new = np.ones(n, bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    alone = np.zeros(n, bool)
    alone[order[starts[np.diff(np.append(starts, n)) == 1]]] = True
    open_, width, deep = np.flatnonzero(~alone), 1, np.zeros(n_rows, bool)
    while len(open_):
        if width == COMMON:
            deep[rows[open_]] = True
        after = open_ + width
        inside = after < ends[open_]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[open_]))
        at, r, s = open_[order], rank[open_][order], second[order]
        group = np.ones(len(at), bool)
        group[1:] = r[1:] != r[:-1]
        part = group.copy()
        part[1:] |= s[1:] != s[:-1]
        where = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(part, where, 0))
        rank[at] = r + begin - np.maximum.accumulate(np.where(group, where, 0))
        starts = np.flatnonzero(part)
        single = np.diff(np.append(starts, len(at))) == 1
        keep = np.ones(len(at), bool)
        keep[starts[single]] = False
        open_, width = at[keep], 2 * width
    return rank - first[rows], deep


def lcp_of(w: list[int], sa: list[int], rank: list[int]) -> list[int]:
    """Words that each suffix, in sorted order, has in common with the one before it."""
    n, out, h = len(w), [0] * len(w), 0
    for i in range(n):
        r = rank[i]
        if not r:
            h = 0
            continue
        j = sa[r - 1]
        most = n - (i if i > j else j)
        while h < most and w[i + h] == w[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out


def longest_previous(sa: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """For each position the longest factor that also starts before it, and where: one pass over suffix array and LCP."""
    n = len(sa)
    longest, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # (position, common with the one below), positions growing
    for r in range(n + 1):
        here, common = (sa[r], lcp[r]) if r < n else (-1, 0)
        while stack:
            top, below = stack[-1]
            if here < top:
                if below >= common:
                    longest[top], source[top] = below, stack[-2][0] if len(stack) > 1 else -1
                else:
                    longest[top], source[top] = common, here
                common = min(common, below)
            elif common <= below:
                longest[top], source[top] = below, stack[-2][0] if len(stack) > 1 else -1
            else:
                break
            stack.pop()
        stack.append((here, common))
    return longest, source


def blocks(longest: list[int]) -> list[int]:
    """Where the blocks of the Lempel-Ziv factorisation start."""
    out, i = [], 0
    while i < len(longest):
        out.append(i)
        i += longest[i] or 1
    return out


def z_values(w: list[int]) -> list[int]:
    """Words that each suffix of w has in common with w."""
    n = len(w)
    z = [n] + [0] * (n - 1) if n else []
    lo = hi = 0
    for i in range(1, n):
        k = min(z[i - lo], hi - i) if i < hi else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def at_boundary(w: list[int], former: int, x: int, following: int, found: dict[tuple[int, int], int]) -> None:
    """Add the runs that hold or touch the boundary x between two blocks, by Main's extensions to both sides.

    A run whose last block start is x reaches back less than a period beyond the block before (from there its factor
    would have reached on), and ends by the next block's start; so periods are under a third of the two blocks together.
    """
    n = len(w)
    most = (following - former + 2) // 3
    tried = []
    for q in range(1, most + 1):  # all but a few fall here: the ends of the period before or behind x differ
        right = x + 2 * q <= n and w[x] == w[x + q] and w[x + q - 1] == w[x + 2 * q - 1]
        left = x - 2 * q >= 0 and w[x - 1] == w[x - 1 - q] and w[x - q] == w[x - 2 * q]
        if right or left:
            tried.append(q)
    if not tried:
        return
    low, high = max(0, former - most - 1), min(n, following + 1)
    ahead, behind, whole = w[x:high], w[low:x][::-1], w[low:high]
    z_ahead, z_behind = z_values(ahead), z_values(behind)
    on = z_values([*ahead, -1, *whole])[len(ahead) + 1 :]  # common of w[x:] and each suffix of the window
    back = z_values([*behind, -1, *whole[::-1]])[len(behind) + 1 :]  # the same backwards
    for q in tried:
        ways = []
        if x + q < high:
            ways.append((x - back[high - x - q], x + q + z_ahead[q]))
        if x - q >= low:
            ways.append((x - q - (z_behind[q] if q < len(behind) else 0), x + (on[x - q - low] if x < high else 0)))
        for start, end in ways:
            cut = (start == low and low > 0) or (end == high and high < n)
            if not cut and end - start >= max(LEAST_WORDS, LEAST_TIMES * q):
                found.setdefault((start, end), q)  # periods grow, so the smallest stays
                found[start, end] = min(found[start, end], q)


def runs_of(w: list[int], sa: list[int], rank: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, in order."""
    n = len(w)
    longest, source = longest_previous(sa, lcp_of(w, sa, rank))
    starts = [*blocks(longest), n]
    found: dict[tuple[int, int], int] = {}
    for former, x, following in zip(starts, starts[1:], [*starts[2:], n], strict=False):
        at_boundary(w, former, x, following, found)
    if found:  # runs strictly inside a block are copies of runs of the factor it repeats
        by_start = defaultdict(list)
        for (start, end), q in found.items():
            by_start[start].append((end, q))
        for x, y in zip(starts, starts[1:], strict=False):
            if longest[x] > LEAST_WORDS:
                back = x - source[x]
                for start in range(source[x] + 1, y - back - LEAST_WORDS):
                    for end, q in by_start.get(start, ()):
                        if end < y - back and (start + back, end + back) not in found:
                            found[start + back, end + back] = q
                            by_start[start + back].append((end + back, q))
    return sorted((start, end, q) for (start, end), q in found.items())


def repeated_words(ids: np.ndarray, first: np.ndarray, keys: list[int | None]) -> np.ndarray:
    """For each word the word that stands there after a tenth of the documents were made periodic."""
    source = np.arange(len(ids))
    for row, key in enumerate(keys):
        lo, n = int(first[row]), int(first[row + 1] - first[row])
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[lo + a : lo + n] = lo + a + np.arange(n - a) % p
    return source


def periodic_runs(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", repeated: bool = False) -> DataFrame:
    """doc_id with n_runs, the longest run (start, length, period, exponent_milli), runs_sha256 and collapsed_sha256.

    A run is a longest stretch of words with a smallest period q that has max(6, 4 q) words at least; start counts words
    from 0.  runs_sha256 hashes `start,length,period` and LF of every run, collapsed_sha256 the words that stay when each
    run keeps its first period, joined by one space.  Null and empty texts have no words.  Rows are taken one by one:
    repeated rows give repeated results and a null id is kept.  With `repeated`, documents whose crc32(doc_id) is
    divisible by 10 are made periodic first (not those with a null id).  Other columns stay; those that the operator
    adds replace columns of the same name.

    Nothing is shuffled: a document is whole in its row, and a step holds about eight million bytes of text or one document.
    """
    out = T.StructType([*[f for f in without(docs, text, *[n for n, _ in RESULT]).schema.fields], *[T.StructField(n, t) for n, t in RESULT]])
    kept = [f.name for f in out.fields[: -len(RESULT)]]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, text):
                yield _searched(step, text, doc_id, kept, repeated)

    return docs.mapInArrow(search, out)


def _searched(step: pa.RecordBatch, text: str, doc_id: str, kept: list[str], repeated: bool) -> pa.RecordBatch:
    n = step.num_rows
    flat, rows = token_rows(texts_of(step, text), lower=False)
    first = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    source = repeated_words(ids, first, step.column(doc_id).to_pylist()) if repeated else np.arange(len(ids))
    ids = ids[source]
    rank, deep = suffix_ranks(ids, rows, n)
    stays = np.ones(len(ids), bool)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for row in np.flatnonzero(deep):
        lo, hi = first[row], first[row + 1]
        place = rank[lo:hi]
        sa = np.empty(hi - lo, np.int64)
        sa[place] = np.arange(hi - lo)
        found[row] = runs_of(ids[lo:hi].tolist(), sa.tolist(), place.tolist())
        for start, end, q in found[row]:
            stays[lo + start + q : lo + end] = False
    words = flat.cast(pa.large_binary()).take(pa.array(source[stays]))
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows[stays], minlength=n))])
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words), pa.scalar(b" ", pa.large_binary()))
    best = [max(r, key=lambda x: (x[1] - x[0], -x[0], -x[2]), default=None) for r in found]
    columns = {c: step.column(c) for c in kept}
    columns["n_runs"] = pa.array([len(r) for r in found], pa.int64())
    columns["start"] = pa.array([b and b[0] for b in best], pa.int64())
    columns["length"] = pa.array([b and b[1] - b[0] for b in best], pa.int64())
    columns["period"] = pa.array([b and b[2] for b in best], pa.int64())
    columns["exponent_milli"] = pa.array([b and 1000 * (b[1] - b[0]) // b[2] for b in best], pa.int64())
    columns["runs_sha256"] = pa.array([hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in r).encode()).hexdigest() for r in found], pa.string())
    columns["collapsed_sha256"] = pa.array([hashlib.sha256(v.as_py()).hexdigest() for v in joined], pa.string())
    return pa.RecordBatch.from_pydict(columns)
