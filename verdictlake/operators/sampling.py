"""Sampling, allocation and splits.  Random draws are hashes of a salt and the row's key, so they don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import hash_order, hash_uniform
from ..sources.scratch import written

#: Rows in order that a greedy selection looks at for each that it wants; so many times more while they don't suffice.
AHEAD = 8


def allocate(counts: DataFrame, key: str, weight: Column, total: int) -> DataFrame:
    """M1, M2: largest remainders; equal remainders go to the greater key.  counts has a row for each bucket."""
    whole = F.sum(weight).over(Window.partitionBy(F.lit(1)))
    raw = F.when(whole > 0, total * weight / whole).otherwise(0.0)
    base = counts.withColumn("_raw", F.round(raw, 9)).withColumn("_floor", F.floor("_raw").cast("long"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("_raw") - F.col("_floor")), F.desc(key)))
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy(F.lit(1)))
    return base.withColumn("_rank", rank).withColumn("_left", left).withColumn("allocated", F.col("_floor") + F.when((F.col("_rank") <= F.col("_left")) & (F.col("_raw") > 0), 1).otherwise(0)).drop("_raw", "_floor", "_rank", "_left")


def split_evenly(buckets: DataFrame, key: str, total: int) -> DataFrame:
    """M3: equal shares; what is left goes to the first buckets."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key))
    return buckets.withColumn("allocated", F.floor(F.lit(total) / n).cast("long") + F.when(rank <= F.lit(total) % n, 1).otherwise(0))


def weighted_key(weight: Column, salt: str, *keys: Column) -> Column:
    """M4: sort key of a weighted random order (Efraimidis and Spirakis): -ln(u) / weight."""
    return -F.log(F.greatest(hash_uniform(salt, *keys), F.lit(1e-12))) / F.greatest(weight, F.lit(1e-9))


def weighted_sample(rows: DataFrame, weight: Column, n: int, salt: str, *keys: str) -> DataFrame:
    """M4: the first n rows of the weighted order; a top-n, no full sort."""
    return rows.withColumn("_k", weighted_key(weight, salt, *[F.col(k) for k in keys])).orderBy("_k", *keys).limit(n).drop("_k")


def _decided(rows: DataFrame, order: Sequence[str], caps: dict[str, int], key: str) -> tuple[DataFrame, int, int]:
    """The rows that a greedy pass in order takes under caps, their number, and the number of all rows.

    Rounds: a row is taken once the rows before it that are taken or undecided leave room under each of its caps, and
    refused once those taken fill one.  Every round decides the first undecided row and, as a row depends only on rows
    that share a capped value with it, mostly all but a few.  `_used_<column>` counts what was taken before.
    """

    def judged(state: DataFrame) -> DataFrame:
        free, full = F.lit(True), F.lit(False)
        for c, cap in caps.items():
            w = Window.partitionBy(c).orderBy(*order, key).rowsBetween(Window.unboundedPreceding, -1)
            free &= F.count(F.lit(1)).over(w) + F.col(f"_used_{c}") < cap
            full |= F.count_if(F.col("_taken")).over(w) + F.col(f"_used_{c}") >= cap
        told = state.withColumn("_free", free).withColumn("_full", full).filter(F.col("_taken") | ~F.col("_full"))
        return told.withColumn("_taken", F.col("_taken") | F.col("_free")).drop("_free", "_full")

    seen = Observation()
    state = rows.withColumn("_taken", F.lit(False)).observe(seen, F.count(F.lit(1)).alias("rows"))
    while True:
        counted = Observation()
        state = written(judged(state).observe(counted, F.count_if(F.col("_taken")).alias("taken"), F.count_if(~F.col("_taken")).alias("open")), "greedy")
        if not counted.get["open"]:
            return state, counted.get["taken"], seen.get["rows"]


def _greedy(candidates: DataFrame, order: Sequence[Column], caps: dict[str, int], target: int, key: str, used: dict[str, DataFrame] | None = None) -> tuple[DataFrame, int]:
    """(key, capped columns, pick) taken in order under caps, and their number; `used` has (column, _used) of what was taken before.

    Rows that agree in all capped columns are alike to the caps, and counts only grow: once one of them is refused, all
    later ones are.  So of each combination no more rows than the least cap are looked at.  What is taken of the first
    rows doesn't depend on later ones: they are decided first, and more of them while the target isn't reached.
    """
    o = [f"_o{i}" for i in range(len(order))]
    thin = candidates.select(key, *caps, *[c.alias(n) for c, n in zip(order, o, strict=True)])
    for c in caps:
        if used and c in used:
            before = used[c].withColumnRenamed(c, "_v")
            thin = thin.join(F.broadcast(before), F.col(c).eqNullSafe(F.col("_v")), "left").drop("_v").withColumn(f"_used_{c}", F.coalesce("_used", F.lit(0))).drop("_used")  # as many rows as were taken
        else:
            thin = thin.withColumn(f"_used_{c}", F.lit(0))
    w = Window.partitionBy(*caps).orderBy(*o, key)
    thin = thin.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= min(target, *caps.values())).drop("_r")
    size = AHEAD * max(1, target)
    while True:
        taken, n, all_ = _decided(thin.orderBy(*o, key).limit(size), o, caps, key)
        if n >= target or all_ < size:
            break
        size *= AHEAD
    first = taken.orderBy(*o, key).limit(target)
    return first.select(key, *caps, F.row_number().over(Window.orderBy(*o, key)).cast("long").alias("pick")), min(n, target)


def select_capped(candidates: DataFrame, order: Sequence[Column], caps: dict[str, int], target: int, key: str) -> DataFrame:
    """Greedy selection in order under caps by column, with the number of each pick."""
    picked, _ = _greedy(candidates, order, caps, target, key)
    return candidates.join(F.broadcast(picked.select(key, "pick")), key)  # target rows at most


@dataclass(frozen=True)
class Stage:
    """A step of a staged sample: rows `where`, in weighted order, up to `target`.

    frame_size stands for the rows of the frame in weights where the frame isn't what is left at that step.
    """

    stratum: str
    component: str
    where: Column
    weight: Column
    target: int
    frame_size: int | None = None


def staged_sample(rows: DataFrame, stages: Sequence[Stage], *, key: str, question: str, model: str, question_cap: int = 4, model_fraction: float = 0.02, relax: bool = True) -> DataFrame:
    """Stages draw one after another from what is left; with stratum, component, frame and sampling_weight.

    The question cap counts over all strata, the model cap over a stratum: its share of the stratum's target, raised to
    the least cap with which all models together reach it (M6).  A stage that falls short is filled once more without the
    model cap.  Weights are frame over rows selected, by component (M8).
    """
    targets: dict[str, int] = {}
    for s in stages:
        targets[s.stratum] = targets.get(s.stratum, 0) + s.target
    caps: dict[str, int] = {}
    chosen: DataFrame | None = None  # as many rows as the sample has

    def left() -> DataFrame:
        return rows if chosen is None else rows.join(F.broadcast(chosen.select(key)), key, "left_anti")

    def draw(s: Stage, salt: str, model_cap: int, target: int, size: int) -> tuple[DataFrame, int]:
        count = lambda frame, c: frame.groupBy(c).agg(F.count(F.lit(1)).alias("_used"))
        used = None if chosen is None else {question: count(chosen, question), model: count(chosen.filter(F.col("stratum") == s.stratum), model)}
        taken, n = _greedy(left().filter(s.where), [weighted_key(s.weight, salt, F.col(key))], {question: question_cap, model: model_cap}, target, key, used)
        named = taken.drop("pick").select("*", F.lit(s.stratum).alias("stratum"), F.lit(s.component).alias("component"), F.lit(size).cast("long").alias("frame"))
        return named if chosen is None else chosen.unionByName(named), n

    for s in stages:
        if s.stratum not in caps:
            nominal = max(1, int(targets[s.stratum] * model_fraction)) if model_fraction > 0 else targets[s.stratum]
            if relax and nominal < targets[s.stratum]:
                counts = left().groupBy(model).agg(F.count_distinct(key).alias("n"))
                nominal = relaxed_cap(counts, "n", targets[s.stratum], nominal).first()["cap"]
            caps[s.stratum] = nominal
        size = s.frame_size if s.frame_size is not None else left().filter(s.where).count()
        chosen, n = draw(s, f"{s.stratum}|{s.component}", caps[s.stratum], s.target, size)
        if relax and n < s.target:
            chosen, _ = draw(s, f"{s.stratum}|{s.component}|relaxed", targets[s.stratum], s.target - n, size)
    picked = chosen.drop(question, model)
    return design_weights(rows.join(F.broadcast(picked), key), ["stratum", "component"], "frame")


def relaxed_cap(counts: DataFrame, n: str, target: int, nominal: int) -> DataFrame:
    """M6: the least cap from the nominal one on with which all groups together reach the target; else the target."""
    caps = counts.sparkSession.range(nominal, max(nominal, target) + 1).withColumnRenamed("id", "cap")
    reach = caps.join(counts.groupBy(n).agg(F.count(F.lit(1)).alias("_m"))).groupBy("cap").agg(F.sum(F.least(F.col(n), F.col("cap")) * F.col("_m")).alias("_s"))
    return reach.agg(F.coalesce(F.min(F.when(F.col("_s") >= target, F.col("cap"))), F.lit(max(nominal, target))).alias("cap"))


def boundary_weight(contention: Column, entropy: Column, label: Column, majority: Column) -> Column:
    """M7: weight of a row near a decision boundary."""
    band = F.when(contention >= 0.45, 4.0).when(contention >= 0.33, 3.0).when(contention >= 0.20, 2.0).otherwise(1.0)
    return 1.0 + band + 4.0 * contention + 3.0 * entropy + F.when(label != majority, 3.0).otherwise(0.0)


def boundary_fill_weight(weight: Column, label: Column) -> Column:
    """M9: the boundary weight for filling up, by label."""
    return weight * F.when(label.isin("COMPLETE", "EVASIVE"), 1.35).otherwise(0.85)


def design_weights(selected: DataFrame, cell: Sequence[str], frame: str) -> DataFrame:
    """M8: Horvitz-Thompson weight: frame size over rows selected of the cell."""
    return selected.withColumn("sampling_weight", F.col(frame) / F.count(F.lit(1)).over(Window.partitionBy(*cell, frame)))


def stratified_sample(rows: DataFrame, fields: Sequence[str], n: int, salt: str, key: str) -> DataFrame:
    """N rows taken from the strata in turn."""
    r = F.row_number().over(Window.partitionBy(*fields).orderBy(hash_order(salt, F.col(key)), key))
    return rows.withColumn("round", r).filter(F.col("round") <= n).orderBy("round", *fields, key).limit(n)


def disjoint_splits(rows: DataFrame, bucket: Sequence[str], sizes: dict[str, int], salt: str, key: str) -> DataFrame:
    """The first rows of each bucket's hashed order go to the first split, the next to the second, and so on."""
    r = F.row_number().over(Window.partitionBy(*bucket).orderBy(hash_order(salt, F.col(key)), key))
    split, upto = None, 0
    for name, size in sizes.items():
        upto += size
        split = F.when(F.col("_r") <= upto, name) if split is None else split.when(F.col("_r") <= upto, name)
    return rows.withColumn("_r", r).withColumn("split", split).filter(F.col("split").isNotNull()).drop("_r")


def overlap_report(splits: DataFrame, split: str, key: str) -> DataFrame:
    """Keys that stand in two splits, by pair of splits."""
    s = splits.select(F.col(split).alias("s"), key).distinct()
    many = s.groupBy(key).agg(F.array_sort(F.collect_set("s")).alias("in")).filter(F.size("in") > 1)  # as many values as splits
    return many.groupBy("in").agg(F.count(F.lit(1)).alias("keys"))


def balanced(rows: DataFrame, bucket: Sequence[str], salt: str, key: str, most: int | None = None) -> DataFrame:
    """As many rows of each bucket as the smallest has, or `most`, by hashed order."""
    r = F.row_number().over(Window.partitionBy(*bucket).orderBy(hash_order(salt, F.col(key)), key))
    floor = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("_floor"))
    limit = F.col("_floor") if most is None else F.least(F.col("_floor"), F.lit(most))
    return rows.withColumn("_r", r).crossJoin(F.broadcast(floor)).filter(F.col("_r") <= limit).drop("_floor").withColumnRenamed("_r", "round")


def shortfalls(rows: DataFrame, targets: DataFrame, bucket: Sequence[str]) -> DataFrame:
    """What each bucket lacks of its target."""
    have = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    return targets.join(have, list(bucket), "left").fillna(0, ["n"]).withColumn("shortfall", F.greatest(F.col("target") - F.col("n"), F.lit(0)))


def mix_by_ratio(rows: DataFrame, label: str, ratio: dict[str, int], salt: str, key: str, group: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Rounds that hold `ratio` rows of each label; as many rounds as every label allows."""
    size = F.lit(None).cast("int")
    for name, k in ratio.items():
        size = F.when(F.col(label) == name, F.lit(k)).otherwise(size)
    known = rows.withColumn("_k", size).filter("_k > 0")
    r = F.row_number().over(Window.partitionBy(label, *group).orderBy(hash_order(salt, F.col(key)), key))
    numbered = known.withColumn("round", F.floor((r - 1) / F.col("_k")).cast("long"))
    full = known.groupBy(label, *group, "_k").agg(F.floor(F.count(F.lit(1)) / F.first("_k")).alias("_rounds"))
    need = len(ratio)
    rounds = full.agg(F.min("_rounds").alias("_rounds"), F.count_distinct(label).alias("_labels"))
    limit = F.when(F.col("_labels") == need, F.col("_rounds")).otherwise(0)
    if most is not None:
        limit = F.least(limit, F.lit(most))
    return numbered.crossJoin(F.broadcast(rounds)).filter(F.col("round") < limit).drop("_k", "_rounds", "_labels")


def select_pairs(pairs: DataFrame, bucket: Sequence[str], boundary: str, prompt: str, target: int, per_prompt: int, salt: str, key: str) -> DataFrame:
    """Pairs of each bucket, boundaries in turn, at most per_prompt of a prompt."""
    own = hash_order(salt, F.col(key))
    capped = pairs.withColumn("_p", F.row_number().over(Window.partitionBy(*bucket, prompt).orderBy(own, key))).filter(F.col("_p") <= per_prompt)
    turn = capped.withColumn("_t", F.row_number().over(Window.partitionBy(*bucket, boundary).orderBy(own, key)))
    return turn.withColumn("bucket_index", F.row_number().over(Window.partitionBy(*bucket).orderBy("_t", boundary)) - 1).filter(F.col("bucket_index") < target).drop("_p", "_t")


def vote_priority(correct: Column, rollouts: Column) -> Column:
    """M23, X10's counterpart: distance of the right votes from half."""
    return F.abs(correct - rollouts / 2)


def select_with_leftovers(rows: DataFrame, bucket: Sequence[str], n: int, salt: str, key: str) -> DataFrame:
    """An even share of each bucket, then what is missing from the rest."""
    r = F.row_number().over(Window.partitionBy(*bucket).orderBy(hash_order(salt, F.col(key)), key))
    buckets = rows.select(*bucket).distinct().agg(F.count(F.lit(1)).alias("_b"))
    return rows.withColumn("_r", r).crossJoin(F.broadcast(buckets)).withColumn("_first", F.col("_r") <= F.floor(F.lit(n) / F.greatest("_b", F.lit(1)))).orderBy(F.desc("_first"), "_r", *bucket).limit(n).drop("_r", "_b", "_first")


def choose_wrong_label(counts: DataFrame, key: str, adjudicated: str, label: str, n: str) -> DataFrame:
    """The most frequent wrong label; ties by the COMPLETE boundary, then alphabetically; with the reason."""
    tie = F.when((F.col(adjudicated) != "COMPLETE") & (F.col(label) == "COMPLETE"), 0).when((F.col(adjudicated) == "COMPLETE") & (F.col(label) == "EVASIVE"), 0).otherwise(1)
    ties = F.count_if(F.col(n) == F.col("_top")).over(Window.partitionBy(key))
    topped = counts.withColumn("_top", F.max(n).over(Window.partitionBy(key))).withColumn("_ties", ties).withColumn("_t", tie)
    w = Window.partitionBy(key).orderBy(F.desc(n), "_t", label)
    reason = F.when(F.col("_ties") == 1, "policy_frequency").when((F.col("_t") == 0) & (F.col(label) == "COMPLETE"), "tie_prefer_complete_boundary").when(F.col("_t") == 0, "tie_complete_canonical_prefer_evasive_boundary").otherwise("tie_deterministic_fallback")
    return topped.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(key, adjudicated, F.col(label).alias("rejected_label"), reason.alias("reason"))


def common_questions(rows: DataFrame, question: str, model: str) -> DataFrame:
    """Questions that every model has answered."""
    models = rows.agg(F.count_distinct(model).alias("_m"))
    return rows.groupBy(question).agg(F.count_distinct(model).alias("_n")).crossJoin(F.broadcast(models)).filter("_n = _m").select(question)


def shuffled(items: Column, salt: Column) -> Column:
    """An array in a hashed order of its own."""
    keyed = F.transform(items, lambda x: F.struct(F.md5(F.concat_ws("|", salt, x.cast("string"))).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def next_bucket(counts: DataFrame, bucket: str, done: str, in_flight: str, target: int, weight: float) -> DataFrame:
    """The bucket that is furthest under target, rows in flight counting by weight."""
    effective = F.col(done) + weight * F.col(in_flight)
    return counts.filter(F.col(done) < target).orderBy(effective, bucket).limit(1)


def padded_batches(rows: DataFrame, partition: Sequence[str], order: Sequence[Column], tokens: str, size: int, most_tokens: int) -> DataFrame:
    """Batch numbers such that rows times the longest row stay under the budget; the fold runs inside each partition value."""
    state = "struct<batch:int,n:int,longest:bigint,out:array<int>>"
    items = rows.groupBy(*partition).agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(tokens).cast("long").alias("t"), F.struct(*rows.columns).alias("row")))).alias("items"))

    def step(a: Column, x: Column) -> Column:
        longest = F.greatest(a["longest"], x["t"])
        new = (a["n"] > 0) & ((a["n"] + 1 > size) | (longest * (a["n"] + 1) > most_tokens))
        batch = a["batch"] + F.when(new, 1).otherwise(0)
        return F.struct(batch.cast("int").alias("batch"), F.when(new, 1).otherwise(a["n"] + 1).cast("int").alias("n"), F.when(new, x["t"]).otherwise(longest).alias("longest"), F.array_append(a["out"], batch.cast("int")).alias("out"))

    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("longest"), F.array().cast("array<int>").alias("out")).cast(state)
    folded = items.withColumn("b", F.aggregate("items", zero, step)["out"])
    return folded.select(F.explode(F.arrays_zip("items", "b")).alias("z")).select("z.items.row.*", F.col("z.b").alias("batch"))
