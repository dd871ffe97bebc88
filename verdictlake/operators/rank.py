"""Ranks and percentiles over values, and orders that need no single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


#: Ranked values are broadcast up to this many; beyond, AQE splits the rows of a hot value.
BROADCAST_VALUES = 500_000


def midrank_percentiles(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(rows below + half of equal rows) / rows for every row, of each value column under the name given to it.

    Ranks are made on distinct values of all columns in one pass: counts of ranges of them are summed on the way, so no
    window holds all rows, and the input is read twice however many columns there are.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("_m"), F.col(value).cast("double").alias("_v")) for value, name in columns.items()]))
    counts = written(rows.select(each.alias("_s")).select("_s.*").groupBy("_m", "_v").agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    ranked = written(cumulative(counts, "_v", "_n", ("_m",)).select("_m", "_v", ((F.col("_before") + 0.5 * F.col("_n")) / F.col("_all")).alias("_p")), "value-ranks")
    few = ranked.count() <= BROADCAST_VALUES
    for value, name in columns.items():
        own = ranked.filter(F.col("_m") == name).select(F.col("_v").alias(f"_{name}"), F.col("_p").alias(name))
        rows = rows.join(F.broadcast(own) if few else own, F.col(value).cast("double").eqNullSafe(F.col(f"_{name}")), "left").drop(f"_{name}")
    return rows


def midrank_percentile(rows: DataFrame, value: str, alias: str) -> DataFrame:
    """W2 of one column."""
    return midrank_percentiles(rows, {value: alias})


def cumulative(counts: DataFrame, value: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """Running count before each distinct value (_before) and the whole (_all), for each group of `by`, of which there are few.

    Values are cut into ranges by approximate quantiles; a small table of range sums gives each range its start, and a
    window runs inside each range only.
    """
    by = list(by) or ["_one"]
    counts = counts.withColumn("_one", F.lit(0)) if by == ["_one"] else counts
    v = F.col(value).cast("double")
    cuts = counts.groupBy(*by).agg(F.percentile_approx(v, [i / 64 for i in range(1, 64)], 10_000).alias("_q"))
    ranged = counts.join(F.broadcast(cuts), by).withColumn("_range", F.size(F.filter(F.array_distinct(F.coalesce("_q", F.array().cast("array<double>"))), lambda c: c < v))).drop("_q")
    sums = ranged.groupBy(*by, "_range").agg(F.sum(n).alias("_s"))  # 64 rows of a group at most
    group = Window.partitionBy(*by)
    starts = sums.withColumn("_start", F.sum("_s").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_all", F.sum("_s").over(group)).select(*by, "_range", F.coalesce("_start", F.lit(0)).alias("_start"), "_all")
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), [*by, "_range"]).withColumn("_before", F.col("_start") + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("_start", "_range")
    return out.drop("_one") if by == ["_one"] else out


def question_stats(rows: DataFrame, question: str, label: str) -> DataFrame:
    """Label rates, majority (ties alphabetically), contention and entropy in units of three labels."""
    labels = ("COMPLETE", "DENIAL", "EVASIVE")
    n = {x: F.count_if(F.col(label) == x).alias(x) for x in labels}
    out = rows.groupBy(question).agg(F.count(F.lit(1)).alias("total"), *n.values())
    rate = {x: F.col(x) / F.col("total") for x in labels}
    top = F.greatest(*[F.col(x) for x in labels])
    majority = F.when(F.col("COMPLETE") == top, "COMPLETE").when(F.col("DENIAL") == top, "DENIAL").otherwise("EVASIVE")
    entropy = sum((F.when(rate[x] > 0, -rate[x] * F.log2(rate[x])).otherwise(0.0) for x in labels), F.lit(0.0)) / F.log2(F.lit(3.0))
    return out.select(question, "total", *[F.round(rate[x], 6).alias(f"{x.lower()}_rate") for x in labels], majority.alias("majority"), F.round(1 - top / F.col("total"), 6).alias("contention"), F.round(entropy, 6).alias("entropy"))


def hard_rank(stats: DataFrame, question: str, least: int = 10) -> DataFrame:
    """Questions by rising COMPLETE rate; those with few rows or no COMPLETE get -1.

    A rate's questions come after those of all lower rates, which are counted; a window runs inside each rate only.
    """
    ok = (F.col("total") >= least) & (F.col("complete_rate") > 0)
    counts = stats.filter(ok).groupBy("complete_rate").agg(F.count(F.lit(1)).alias("_n"))
    before = cumulative(counts, "complete_rate", "_n").select("complete_rate", "_before")
    order = Window.partitionBy("complete_rate").orderBy(F.desc("denial_rate"), F.desc("evasive_rate"), F.desc("total"), question)
    ranked = stats.filter(ok).withColumn("_r", F.row_number().over(order)).join(before, "complete_rate").withColumn("hard_rank", (F.col("_before") + F.col("_r")).cast("int"))
    return ranked.select(*stats.columns, "hard_rank").unionByName(stats.filter(~ok).withColumn("hard_rank", F.lit(-1)))


def weird_score(rows: DataFrame, chars: str, lines: str, markdown: str, repetition: str) -> DataFrame:
    """Weighted percentiles of size and form, with the reasons of the top two hundredths."""
    rows = midrank_percentiles(written(rows, "features"), {chars: "len_pct", lines: "line_pct", markdown: "md_pct", repetition: "rep_pct"})
    score = 0.45 * F.col("len_pct") + 0.2 * F.col("line_pct") + 0.15 * F.col("md_pct") + 0.2 * F.col("rep_pct")
    top = 0.98
    reasons = F.array_compact(F.array(
        F.when(F.col("len_pct") >= top, "very_long"), F.when(F.col("line_pct") >= top, "many_lines"),
        F.when((F.col("md_pct") >= top) & (F.col(markdown) > 0), "high_markdown_density"), F.when((F.col("rep_pct") >= top) & (F.col(repetition) > 0), "low_token_diversity"),
    ))
    return rows.withColumn("weird_score", F.round(score, 6)).withColumn("weird_reasons", reasons)


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def round_robin(rows: DataFrame, cell: Sequence[str], order: Sequence[Column], alias: str = "round") -> DataFrame:
    """Each row's number in its cell; ordering by (round, cell) takes one row from every cell in turn."""
    return rows.withColumn(alias, F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))


def deal(rows: DataFrame, key: Sequence[str], order: Sequence[Column], hands: int, alias: str = "fold") -> DataFrame:
    """Rows of a group dealt to `hands` in turn."""
    return rows.withColumn(alias, (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) % hands)


def step_blocks(rows: DataFrame, bucket: Sequence[str], order: Sequence[Column], salt: Column, steps: int | None = None) -> DataFrame:
    """One row of each bucket in every step; positions inside a step follow the salted hash."""
    out = rows.withColumn("step_index", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order)) - 1)
    if steps is not None:
        out = out.filter(F.col("step_index") < steps)
    return out.withColumn("step_position", F.row_number().over(Window.partitionBy("step_index").orderBy(salt)) - 1)


def margin(scores: Sequence[Column]) -> Column:
    """Best less second best score."""
    ordered = F.sort_array(F.array(*scores), asc=False)
    return ordered[0] - ordered[1]


def index_percentile(rows: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """The value at index int((n - 1) q) of the sorted values; no interpolation, 0 for no rows."""
    counts = cumulative(rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n")), value, "_n")
    at = lambda q: F.coalesce(F.max(F.when((F.floor((F.col("_all") - 1) * q) >= F.col("_before")) & (F.floor((F.col("_all") - 1) * q) < F.col("_before") + F.col("_n")), F.col(value).cast("double"))), F.lit(0.0))
    return counts.agg(*[at(q).alias(f"p{q * 100:g}".replace(".", "_")) for q in shares])


def diverse(rows: DataFrame, creator: str, order: Sequence[Column], count: int) -> DataFrame:
    """T5: first the best row of each creator, then any."""
    first = rows.withColumn("_again", F.row_number().over(Window.partitionBy(creator).orderBy(*order)) > 1)
    return first.orderBy("_again", *order).limit(count).drop("_again")


def runs_of(rows: DataFrame, key: Sequence[str], order: Sequence[Column], flag: Column) -> DataFrame:
    """Section 2.12: longest run of rows in a row with the flag, for each key (the error breaker's measure)."""
    w = Window.partitionBy(*key).orderBy(*order)
    islands = rows.withColumn("_f", flag).withColumn("_g", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*key, "_f").orderBy(*order)))
    return islands.filter("_f").groupBy(*key, "_g").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max("n").alias("longest_run"))


def rolling_count(rows: DataFrame, key: Sequence[str], ts: str, seconds: int, alias: str = "in_window") -> DataFrame:
    """Rows of a key in the `seconds` up to each row, itself included."""
    w = Window.partitionBy(*key).orderBy(F.col(ts).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return rows.withColumn(alias, F.count(F.lit(1)).over(w))
