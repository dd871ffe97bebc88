"""Votes over rollouts or judges: counts, plurality, entropy and consensus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import LABELS, is_label
from ..functions.text import entropy_bits
from .metrics import grouping_report, pct


def votes(rollouts: DataFrame, key: str = "id", expected: str = "expected", observed: str = "observed", labels: Sequence[str] = LABELS, positive: str = "COMPLETE") -> DataFrame:
    """One row for each id; a tie has no plurality.  Counts combine before the shuffle."""
    o, e = F.col(observed), F.col(expected)
    known = F.coalesce(o.isin(*labels), F.lit(False))
    each = [F.count_if(o == x).alias(f"n_{i}") for i, x in enumerate(labels)]
    truncated = F.count_if(F.coalesce("is_truncated", F.lit(False))) if "is_truncated" in rollouts.columns else F.lit(0)
    out = rollouts.groupBy(key).agg(
        F.first(expected).alias(expected), F.count(F.lit(1)).alias("rollouts"), F.count_if(known).alias("parseable"), F.count_if(o == e).alias("correct_votes"),
        F.count_if(known & ((o == positive) == (e == positive))).alias("binary_correct_votes"), truncated.alias("truncated_rollouts"), *each,
    )
    counts = [F.col(f"n_{i}") for i in range(len(labels))]
    top = F.greatest(*counts) if len(counts) > 1 else counts[0]
    winners = F.array_compact(F.array(*[F.when((c == top) & (top > 0), F.lit(x)) for c, x in zip(counts, labels, strict=True)]))
    entries = F.array_compact(F.array(*[F.when(c > 0, F.struct(F.lit(x).alias("key"), c.alias("value"))) for c, x in zip(counts, labels, strict=True)]))
    out = out.withColumn("votes", F.map_from_entries(entries)).withColumn("top_count", top).withColumn("winners", winners)
    out = out.withColumn("plurality", F.when(F.size("winners") == 1, F.col("winners")[0])).withColumn("entropy", F.round(entropy_bits(F.array(*[c.cast("double") for c in counts])), 6))
    c, b, n = F.col("correct_votes"), F.col("binary_correct_votes"), F.col("rollouts")
    out = out.withColumn("mixed_reward", (c > 0) & (c < n)).withColumn("mixed_binary_reward", (b > 0) & (b < n)).withColumn("all_wrong_reward", c == 0).withColumn("all_binary_wrong_reward", b == 0)
    return out.withColumn("plurality_correct", F.coalesce(F.col("plurality") == e, F.lit(False))).withColumn("category", F.when(c == 0, "all_wrong").when(c == n, "all_correct").otherwise("mixed")).drop(*[f"n_{i}" for i in range(len(labels))])


def countable(signal: str, mode: str = "strict", allow_truncated: bool = False, expected: str = "expected") -> Column:
    """Is a vote row usable for a training signal?"""
    whole = F.col("parseable") == F.col("rollouts")
    clean = F.lit(True) if allow_truncated else F.col("truncated_rollouts") == 0
    right = F.coalesce(F.try_element_at("votes", F.col(expected)), F.lit(0))
    total = F.aggregate(F.map_values("votes"), F.lit(0).cast("long"), lambda a, x: a + x)
    mixed = F.col("mixed_reward") & whole & clean if mode == "strict" else is_label(F.col(expected)) & (right > 0) & (total > right)
    wrong, binary = F.col("all_wrong_reward") & whole & clean, F.col("all_binary_wrong_reward") & whole & clean
    return {"mixed": mixed, "all_wrong": wrong, "all_binary_wrong": binary, "mixed_or_all_wrong": mixed | wrong}[signal]


def whole_groups(rollouts: DataFrame, key: str, parseable: bool = True, untruncated: bool = True) -> DataFrame:
    """F8: rollouts of groups that are parseable and untruncated throughout."""
    rules = []
    if parseable:
        rules.append(F.bool_and(is_label(F.col("observed"))))
    if untruncated:
        rules.append(F.bool_and(~F.coalesce("is_truncated", F.lit(False))))
    ok = F.lit(True)
    for r in rules:
        ok = ok & r
    return rollouts.join(rollouts.groupBy(key).agg(ok.alias("_ok")).filter("_ok").select(key), key, "left_semi")


def rollout_summary(voted: DataFrame, majority: int | None = None) -> DataFrame:
    """Summary of vote rows; the strict majority is more than half unless a number is given."""
    need = F.lit(majority) if majority else F.floor(F.col("rollouts") / 2) + 1
    n = F.count(F.lit(1))
    top_right = F.col("plurality_correct")
    return voted.agg(
        n.alias("items"), F.count_if(top_right).alias("plurality_correct"), pct(F.count_if(top_right), n).alias("plurality_pct"),
        F.count_if(top_right & (F.col("top_count") >= need)).alias("majority_correct"), F.count_if(F.col("correct_votes") > 0).alias("any_correct"),
        F.count_if(F.col("correct_votes") == F.col("rollouts")).alias("all_correct"), F.count_if(F.col("top_count") == F.col("rollouts")).alias("unanimous"),
        F.count_if(F.size("winners") > 1).alias("ties"), F.round(F.avg("entropy"), 6).alias("mean_entropy"),
    )


def vote_histogram(voted: DataFrame) -> DataFrame:
    """Items by number of right votes."""
    return voted.groupBy("correct_votes").agg(F.count(F.lit(1)).alias("items"))


def consensus_against_gold(results: DataFrame, key: str, expected: str, observed: str, judge_order: str, threshold: int) -> DataFrame:
    """Keys where at least `threshold` judges share one wrong label; equal counts go to the label seen first."""
    wrong = results.filter((F.col(observed) != F.col(expected)) & is_label(F.col(observed)))
    counted = wrong.groupBy(key, expected, observed).agg(F.count(F.lit(1)).alias("judges"), F.min(judge_order).alias("_seen"))
    w = Window.partitionBy(key).orderBy(F.desc("judges"), "_seen")
    return counted.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") == 1) & (F.col("judges") >= threshold)).drop("_r", "_seen")


def unanimous(results: DataFrame, key: str, label: str, panel: int) -> DataFrame:
    """Keys on which a whole panel has given one label."""
    return results.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("d"), F.first(label).alias(label)).filter((F.col("n") == panel) & (F.col("d") == 1)).select(key, label)


def two_turn_flips(rows: DataFrame, expected: str, first: str, second: str) -> DataFrame:
    """Changes of mind toward and away from gold."""
    e, a, b = F.col(expected), F.col(first), F.col(second)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(a != b).alias("changed"), F.count_if((a != e) & (b == e)).alias("toward_gold"), F.count_if((a == e) & (b != e)).alias("away_from_gold"))


def judge_coverage(nested: DataFrame, judges: str, expected: str, key: str) -> DataFrame:
    """Coverage and agreement of each judge and regime in a map of maps."""
    rows = nested.select(key, expected, F.explode(judges).alias("judge", "regimes")).select(key, expected, "judge", F.explode("regimes").alias("regime", "label"))
    return rows.groupBy("judge", "regime").agg(F.count(F.lit(1)).alias("rows"), pct(F.count_if(F.col("label") == F.col(expected)), F.count(F.lit(1))).alias("agreement_pct"))


def coverage_range(nested: DataFrame, judges: str) -> DataFrame:
    """Least, mean and most labels that a row has over all judges and regimes."""
    n = F.aggregate(F.map_values(judges), F.lit(0), lambda a, regimes: a + F.size(regimes))
    return nested.agg(F.min(n).alias("least"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("most"))


def reward_batches(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Reward batches (with an array of groups) overall and by each dimension, rewards weighted by rollouts."""
    flat = rows.withColumn("g", F.explode("groups")).select(*[c for c in rows.columns if c != "groups"], "g.*")
    return grouping_report(flat, dims, [F.count(F.lit(1)).alias("groups"), F.sum("rollouts").alias("rollouts"), F.round(F.sum(F.col("reward") * F.col("rollouts")) / F.sum("rollouts"), 6).alias("mean_reward")])


def reward_spread(rollouts: DataFrame, group: str, reward: str) -> DataFrame:
    """Mean and population deviation of rewards, and groups whose rewards don't vary."""
    groups = rollouts.groupBy(group).agg(F.count_distinct(reward).alias("d"))
    flat = groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("d") <= 1).alias("zero_variance"))
    return rollouts.agg(F.round(F.avg(reward), 6).alias("mean"), F.round(F.stddev_pop(reward), 6).alias("std")).crossJoin(flat)


def stock(votes_rows: DataFrame, key: str, order: Column, bucket: Sequence[str], grid: DataFrame, keep: Column) -> DataFrame:
    """Strict-mixed votes by bucket, the first row of a key counts; all buckets of the grid, empty ones too."""
    w = Window.partitionBy(key).orderBy(order)
    kept = votes_rows.filter(keep).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    counts = kept.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, list(bucket), "left").fillna(0, ["n"]).withColumn("floor", F.min("n").over(Window.partitionBy(F.lit(1))))


def under_target(stock_rows: DataFrame, candidates: DataFrame, processed: DataFrame, bucket: Sequence[str], key: str, target: int) -> DataFrame:
    """buckets under target that still have candidates not processed."""
    fresh = candidates.join(processed.select(key), key, "left_anti").select(*bucket).distinct()
    return stock_rows.filter(F.col("n") < target).join(fresh, list(bucket), "left_semi")
