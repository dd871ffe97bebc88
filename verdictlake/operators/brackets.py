"""Best answers by single elimination: rounds of pairwise comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def seated(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with seat, their place in the order of their group from 0, without bringing a group together.

    Rows are sorted by ranges; a range counts its rows of each group, and the counts of the ranges before it are added.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "seats").withColumn("_range", F.shiftright("_at", 33))
    pieces = placed.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_first", before.alias("_before"))
    found = placed.join(starts, placed[group].eqNullSafe(starts["_g"]) & (F.col("_range") == F.col("_r")))
    return found.withColumn("seat", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_g", "_r", "_first", "_before")


def single_elimination(rows: DataFrame, question: str, order: list[str], left_wins: Callable[[Column, Column], Column]) -> DataFrame:
    """The champion of each question, with the matches it won, its byes and the question's candidates.

    Candidates sit in `order`; in a round seats 2k and 2k+1 meet, and one without an opponent goes on by a bye.
    left_wins compares two structs of a candidate's columns; null keeps the left one.  A round is one grouping by
    pair, half as large as the one before, so a question of any number of candidates takes log2 of it in rounds.
    """
    fields = [F.col(f"`{c}`") for c in rows.columns]
    whole = seated(rows, question, *order).select(F.col(question).alias("_q"), "seat", F.struct(*fields).alias("it"), F.lit(0).alias("won"), F.lit(0).alias("byes"))
    sizes = whole.groupBy("_q").agg(F.count(F.lit(1)).alias("candidates"))
    side = lambda bit: F.max(F.when(F.col("seat") % 2 == bit, F.struct("it", "won", "byes")))  # noqa: E731  (one row each)
    while True:
        top = Observation()
        whole = written(whole.observe(top, F.max("seat").alias("seat")), "bracket")
        if not top.get["seat"]:
            break
        pairs = whole.groupBy("_q", F.expr("seat div 2").alias("seat")).agg(side(0).alias("l"), side(1).alias("r"))
        keep = F.coalesce(left_wins(F.col("l.it"), F.col("r.it")), F.lit(True))
        alone = F.col("r").isNull()
        winner = F.when(alone | keep, F.col("l")).otherwise(F.col("r"))
        # a question that has its champion is at seat 0 without an opponent: no bye
        going_on = whole.groupBy("_q").agg((F.max("seat") > 0).alias("open"))
        joined = pairs.select("_q", "seat", winner.alias("w"), alone.alias("alone")).join(going_on.withColumnRenamed("_q", "_p"), F.col("_q").eqNullSafe(F.col("_p")))
        whole = joined.select("_q", "seat", "w.it", (F.col("w.won") + F.when(F.col("alone"), 0).otherwise(1)).alias("won"), (F.col("w.byes") + F.when(F.col("alone") & F.col("open"), 1).otherwise(0)).alias("byes"))
    out = whole.join(sizes.withColumnRenamed("_q", "_p"), F.col("_q").eqNullSafe(F.col("_p")))
    return out.select("it.*", F.col("won").alias("matches_won"), "byes", "candidates")
