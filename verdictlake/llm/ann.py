"""Operator 2: approximate nearest neighbours with a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The tree is fitted on this many distinct vectors at most; every vector is indexed.
FIT_ROWS = 20_000
#: Queries whose neighbours are found by brute force, to calibrate how many leaves a search visits.
CALIBRATION_QUERIES = 200
BRANCHES = 8
#: Vectors wanted in a leaf, and the most leaves; larger leaves are searched in blocks.
LEAF_ROWS, MOST_LEAVES = 256, 4096
BLOCK = 4096
#: Neighbours a task holds before it keeps the best of each query only.
HELD_ROWS = 1_000_000
#: Queries held against a block at once, and pairs scored at once.
QUERY_ROWS, SCORED_ROWS = 256, 1 << 15


@dataclass
class Tree:
    """Nodes of the tree: a centre each, children as index ranges, and leaf numbers (-1 inside)."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    longest: float

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with one more component, so that all have the longest norm and the nearest by distance has the largest product."""
        rest = np.maximum(0.0, self.longest - (x * x).sum(axis=1))
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down to the nearest child at every node."""
        lifted, at = self.lift(x), np.zeros(len(x), np.int64)
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            at = _nearest(lifted[rows], self.centres[kids])
            todo += [(int(kids[k]), rows[at == k]) for k in range(len(kids)) if (at == k).any()]
        return out

    def order(self, q: np.ndarray, most: int) -> list[int]:
        """Up to `most` leaves, nearest bin first: the queue holds every node that is open, whatever its depth."""
        lifted = np.concatenate([q, [0.0]])
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                continue
            kids = self.children[node]
            far = ((self.centres[kids] - lifted) ** 2).sum(axis=1)
            for d, kid in zip(far.tolist(), kids, strict=True):
                heapq.heappush(queue, (d, kid))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        for j in range(k):
            if (at == j).any():
                centres[j] = x[at == j].mean(axis=0)
    return centres, _nearest(x, centres)


def fit(sample: np.ndarray, n: int, longest: float, seed: int = 0) -> Tree:
    """A tree over the sample with about n / LEAF_ROWS leaves, each with a sample row or more."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((0, sample.shape[1] + 1)), [], np.zeros(0, np.int64), longest)
    lifted = tree.lift(sample)
    leaves = max(1, min(MOST_LEAVES, n // LEAF_ROWS, len(sample) // 4))
    small = max(4, len(sample) // leaves)
    centres, children, leaf = [lifted.mean(axis=0)], [[]], [-1]
    todo = [(0, np.arange(len(lifted)))]
    number = 0
    while todo:
        node, rows = todo.pop()
        k = min(BRANCHES, max(2, -(-len(rows) // small)))
        if len(rows) > 1.5 * small:
            made, at = _kmeans(lifted[rows], k, rng)
            parts = [rows[at == j] for j in range(k)]
            if sum(len(p) > 0 for p in parts) > 1:
                for c, p in zip(made, parts, strict=True):
                    if len(p):
                        children[node].append(len(centres))
                        centres.append(c)
                        children.append([])
                        leaf.append(-1)
                        todo.append((len(centres) - 1, p))
                continue
        leaf[node] = number
        number += 1
    return Tree(np.array(centres), children, np.array(leaf), longest)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, summed from the first component to the last."""
    return np.cumsum(q * c, axis=1)[:, -1]


def _best(rows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, id, score) rows of each query."""
    q, i, s = rows
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], i[keep], s[keep]


def best_of_block(who: np.ndarray, x: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, id, score) rows of each query among a block's points, ties to smaller ids.

    Matrix products only sift: every point whose product may reach the k-th largest, given their rounding error, is scored
    again by _products, in slices, so a block of ties costs time but no memory.
    """
    near = x @ points.T
    top = min(k, near.shape[1])
    error = 1e-12 * np.sqrt((x * x).sum(axis=1) * (points * points).sum(axis=1).max())
    q, c = np.nonzero(near >= (np.partition(near, near.shape[1] - top, axis=1)[:, near.shape[1] - top] - error)[:, None])
    score = np.concatenate([_products(x[q[i : i + SCORED_ROWS]], points[c[i : i + SCORED_ROWS]]) for i in range(0, len(q), SCORED_ROWS)])
    return _best((who[q], ids[c], score), k)


def _usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product for each query row, its own id left out.

    Equal vectors are one point of the index that keeps its k + 1 smallest ids: more can't be among k neighbours, as ties
    go to the smaller id.  Queries with equal vectors are searched once.  A search visits as many leaves as brute force on
    a sample of queries shows to be needed for the recall.  Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do null ids and lengths other than the most common one.  Repeated rows count once.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter(F.col("id").isNotNull()).filter(_usable("v"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return empty
    rows = rows.filter(F.size("v") == sizes[0]["d"])
    smallest = Window.partitionBy("v").orderBy("id")
    few = rows.select("v", "id").distinct().withColumn("r", F.row_number().over(smallest)).filter(F.col("r") <= k + 1)
    points = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("point", F.col("ids")[0]), "points")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest = points.agg(F.count(F.lit(1)), F.max(square)).first()
    sample = points.select("v").sample(min(1.0, 1.1 * FIT_ROWS / n), seed=3).limit(FIT_ROWS).toArrow()
    if not sample.num_rows:
        sample = points.select("v").limit(FIT_ROWS).toArrow()
    tree = fit(_matrix(sample["v"].combine_chunks()), n, longest)
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(_matrix(b.column("v")))), b.column("point"), b.column("v")], ["leaf", "point", "v"])

    kind = points.schema["v"].dataType.simpleString()
    indexed = materialize(points.select("point", "v").mapInArrow(assign, f"leaf long, point long, v {kind}"), "indexed")
    asked = materialize(rows.filter("is_query").groupBy("v").agg(F.min("id").alias("q")), "asked")
    n_asked = asked.count()
    if not n_asked:
        return empty
    visits = _calibrate(indexed, asked, n_asked, tree, k + 1, recall)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                x = _matrix(part.column("v"))
                leaves = [shared.value.order(q, visits) for q in x]
                who = np.repeat(np.arange(len(x)), [len(o) for o in leaves])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(leaves).astype(np.int64)), part.column("q").take(pa.array(who)), part.column("v").take(pa.array(who))], ["leaf", "id", "v"])

    probes = asked.mapInArrow(probe, f"leaf long, id long, v {kind}")
    sizes = indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    sizes = F.broadcast(sizes)  # a row for each leaf: MOST_LEAVES at most
    inside = indexed.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("point"), "blocks").alias("block"), F.lit(0).alias("role"), F.col("point").alias("id"), "v")
    outside = probes.join(sizes, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "v")
    dealt = inside.unionByName(outside).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "role")
    want = k + 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, points_ = None, [], []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def out(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a) for a in rows], ["q", "point", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            leaf, block, role, who = (b.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "block", "role", "id"))
            x = _matrix(b.column("v"))
            new = (leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1]) | (role[1:] != role[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1), len(leaf)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if (leaf[lo], block[lo]) != now:
                    now, ids, points_ = (leaf[lo], block[lo]), [], []
                if role[lo] == 0:
                    ids.append(who[lo:hi])
                    points_.append(x[lo:hi])
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, points_ = [np.concatenate(ids)], [np.concatenate(points_)]
                for some in range(lo, hi, QUERY_ROWS):
                    here = slice(some, min(hi, some + QUERY_ROWS))
                    best = best_of_block(who[here], x[here], ids[0], points_[0], want)
                    held.append(best)
                    count += len(best[0])
                    if count > HELD_ROWS:
                        best = _best(tuple(np.concatenate(a) for a in zip(*held, strict=True)), want)
                        held, count = [best], len(best[0])
                        if 2 * count > HELD_ROWS:
                            yield out(best)
                            held, count = [], 0
        if held:
            yield out(_best(tuple(np.concatenate(a) for a in zip(*held, strict=True)), want))

    found = dealt.mapInArrow(search, "q long, point long, score double")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "point")
    top = found.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= want)
    spread = top.join(points.select("point", "ids"), "point").select("q", "score", F.explode("ids").alias("id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    answers = materialize(spread.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= want).select("q", "score", "id"), "answers")
    members = materialize(rows.filter("is_query").select("id", "v").distinct().join(asked, "v").select(F.col("id").alias("query_id"), "q"), "members")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = members.join(answers, "q").filter(F.col("id") != F.col("query_id")).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")


def _calibrate(indexed: DataFrame, asked: DataFrame, n_asked: int, tree: Tree, k: int, recall: float) -> int:
    """Leaves a search must visit so that on sampled queries the true neighbours' share in them reaches the recall."""
    spark = indexed.sparkSession
    sample = asked.select("v").sample(min(1.0, 1.5 * CALIBRATION_QUERIES / n_asked), seed=5).limit(CALIBRATION_QUERIES).toArrow()
    if not sample.num_rows:
        sample = asked.select("v").limit(CALIBRATION_QUERIES).toArrow()
    queries = _matrix(sample["v"].combine_chunks())
    shared = spark.sparkContext.broadcast(queries)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            if not b.num_rows:
                continue
            near = shared.value @ _matrix(b.column("v")).T
            top = min(k, near.shape[1])
            at = np.argpartition(-near, top - 1, axis=1)[:, :top]
            q = np.repeat(np.arange(len(near)), top)
            leaf = b.column("leaf").to_numpy(zero_copy_only=False)[at.ravel()]
            new = (q, leaf, near[q, at.ravel()])
            best = new if best is None else tuple(np.concatenate(a) for a in zip(best, new, strict=True))
            best = _best(best, k)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in best], ["q", "leaf", "score"])

    truth = indexed.select("leaf", "v").mapInArrow(brute, "q long, leaf long, score double")
    by = Window.partitionBy("q").orderBy(F.desc("score"))
    truth = truth.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k).select("q", "leaf").collect()  # CALIBRATION_QUERIES * k rows
    place = [{leaf: i for i, leaf in enumerate(tree.order(q, tree.n_leaves))} for q in queries]
    needed = np.sort([place[r["q"]][r["leaf"]] + 1 for r in truth])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
