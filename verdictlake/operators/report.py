"""Reports: totals, audits, queues and rows shaped for a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import LABELS
from .metrics import grouping_report, pct


def _n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def token_totals(rows: DataFrame, file: str, tokens: str) -> DataFrame:
    """Tokens of each file and of all."""
    return rows.rollup(file).agg(F.sum(tokens).alias("tokens")).select(F.coalesce(file, F.lit("TOTAL")).alias(file), "tokens")


def status_audit(rows: DataFrame, examples: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts by status, reason, both, and model with status; and the first examples of unknown metadata."""
    sets = [["status"], ["reason"], ["status", "reason"], ["model", "status"]]
    counts = rows.groupingSets([[F.col(c) for c in s] for s in sets], "status", "reason", "model").agg(_n())
    w = Window.partitionBy("status").orderBy("_file", "_line")
    shown = rows.filter("status = 'unknown_metadata'").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= examples).drop("_r")
    return counts, shown


def eval_errors(rows: DataFrame, examples: int = 5) -> tuple[DataFrame, DataFrame]:
    """Counters of responses with their analyses, over all and over retained errors; and question ids by error bucket.

    rows: question_id, status, reason, compliance (null without an analysis), finish, family, provider.
    """
    label = F.coalesce("compliance", F.lit("<missing_analysis>"))
    rows = rows.withColumn("label", label).withColumn("retained", (F.col("status") != "success") | ~label.isin(*LABELS))
    dims = ["status", "reason", "label", "finish", "family", "provider"]
    counts = grouping_report(rows, dims, [_n("rows"), F.count_if("retained").alias("retained"), F.count_if(F.col("compliance").isNull()).alias("missing_analysis")])
    bucket = F.concat_ws(" | ", "status", "label")
    w = Window.partitionBy("bucket").orderBy("question_id")
    shown = rows.filter("retained").withColumn("bucket", bucket).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= examples)
    return counts, shown.groupBy("bucket").agg(F.array_sort(F.collect_list("question_id")).alias("examples"))


def adjudications(rows: DataFrame) -> DataFrame:
    """Adjudication statuses overall and by boundary, type and bucket."""
    statuses = ("all_agree", "judge_confirms_pool", "judge_confirms_local", "judge_third_label", "unparseable")
    return grouping_report(rows, ["boundary", "question_type", "bucket"], [_n("rows"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses]])


def composition(rows: DataFrame, stratum: str) -> DataFrame:
    """Labels, types, domains and models of each stratum, and mean length."""
    return rows.groupBy(stratum).agg(_n("rows"), *[F.count_if(F.col("label") == x).alias(x.lower()) for x in LABELS], F.count_distinct("question_type").alias("types"), F.count_distinct("domain").alias("domains"), F.count_distinct("model").alias("models"), F.round(F.avg("response_chars"), 3).alias("mean_chars"))


def type_label_matrix(rows: DataFrame) -> DataFrame:
    """Question types by labels."""
    return rows.groupBy("question_type").pivot("label", list(LABELS)).count().fillna(0)


def source_balance(rows: DataFrame, model: str) -> DataFrame:
    """Least, lower median and most rows of a model."""
    counts = rows.groupBy(model).agg(_n())
    ordered = F.array_sort(F.collect_list("n"))  # a number for each model
    return counts.agg(F.count(F.lit(1)).alias("models"), F.min("n").alias("least"), F.element_at(ordered, F.floor((F.count(F.lit(1)) + 1) / 2).cast("int")).alias("median"), F.max("n").alias("most"))


def score_by_tier(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Plurality predictions by stratum and tier; ties count as wrong, and are left out of the decided share."""
    right, tie = F.col("observed") == F.col("expected"), F.col("observed").isNull()
    n = F.count(F.lit(1))
    return grouping_report(rows, dims, [n.alias("rows"), F.count_if(right).alias("correct"), F.count_if(tie).alias("ties"), pct(F.count_if(right), n).alias("accuracy_pct"), pct(F.count_if(right), F.count_if(~tie)).alias("decided_pct")])


def progress(queue: DataFrame, decisions: DataFrame, key: str, stratum: str) -> DataFrame:
    """Rows of the queue that are decided, by stratum, and by the latest decision."""
    w = Window.partitionBy(key).orderBy(F.desc("reviewed_at"))
    last = decisions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(key, "decision")
    return queue.join(last, key, "left").groupBy(stratum).agg(_n("rows"), F.count("decision").alias("decided"), F.count_if(F.col("decision") == "agree").alias("agree"), F.count_if(F.col("decision") == "reclassify").alias("reclassify"))


def model_stats(rows: DataFrame, file: str, model: str, label: str) -> DataFrame:
    """Label shares of each file's model, its dominant label and the spread between most and least."""
    known = rows.filter(F.col(label).isin(*LABELS))
    out = known.groupBy(file, model).agg(_n("total"), *[(F.count_if(F.col(label) == x) / F.count(F.lit(1))).alias(f"{x.lower()}_pct") for x in LABELS])
    shares = [F.col(f"{x.lower()}_pct") for x in LABELS]
    top = F.greatest(*shares)
    dominant = F.when(shares[0] == top, LABELS[0]).when(shares[1] == top, LABELS[1]).otherwise(LABELS[2])
    return out.withColumn("dominant", dominant).withColumn("balance", top - F.least(*shares)).withColumn("creator", F.substring_index(model, "/", 1))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Preference pairs by label, boundary and side, with their weights."""
    return grouping_report(pairs, ["expected_label", "boundary", "side"], [_n("pairs"), F.count_distinct("id").alias("prompts"), F.round(F.sum("weight"), 6).alias("weight"), F.round(F.avg("weight"), 6).alias("mean_weight")])


def bucket_scores(rows: DataFrame, bucket: Sequence[str], score: str) -> DataFrame:
    """Least and greatest score of a bucket."""
    return rows.groupBy(*bucket).agg(_n(), F.min(score).alias("least"), F.max(score).alias("greatest"))


def variant_counts(ids: DataFrame, column: str) -> DataFrame:
    """Variants of each base id; the digits at the end number them."""
    return ids.groupBy(F.regexp_replace(column, r"\d$", "").alias("base_id")).agg(_n())


def domains(rows: DataFrame, column: str = "domain") -> DataFrame:
    """Distinct domains, sorted."""
    return rows.select(F.trim(column).alias(column)).filter(F.col(column) != "").distinct().orderBy(column)


def local_agreement(rows: DataFrame, expected: str, observed: str, local: str) -> DataFrame:
    """Accuracy, and agreement with labels of a local judge where there are any."""
    n, both = F.count(F.lit(1)), F.col(local).isNotNull()
    return rows.agg(n.alias("rows"), F.count_if(F.col(observed) == F.col(expected)).alias("correct"), F.count_if(both).alias("with_local"), F.count_if(both & (F.col(observed) == F.col(local))).alias("agree_local"), pct(F.count_if(both & (F.col(observed) == F.col(local))), F.count_if(both)).alias("agree_pct"))


def whole_runs(rows: DataFrame, run: str, expected: str, observed: str, size: int) -> DataFrame:
    """Accuracy of runs with exactly `size` rows whose labels are known on both sides."""
    known = rows.filter(F.col(expected).isin(*LABELS) & F.col(observed).isin(*LABELS))
    return known.groupBy(run).agg(_n("rows"), F.count_if(F.col(expected) == F.col(observed)).alias("correct")).filter(F.col("rows") == size).withColumn("accuracy_pct", F.round(100.0 * F.col("correct") / F.col("rows"), 3))


def review_queue(gold: DataFrame, votes: DataFrame, key: str, label: str, least: int | None = None, limit: int | None = None) -> DataFrame:
    """Gold rows that judges disagree with (most of them, or `least`); EVASIVE first, then by disagreement.

    votes: key and a map of judge to label.
    """
    values = F.map_values("votes")
    disagree = F.size(F.filter(values, lambda v: v != F.col(label)))
    need = F.lit(least) if least is not None else F.floor(F.size(values) / 2) + 1
    out = gold.join(votes, key).withColumn("vote_count", F.size(values)).withColumn("disagree_count", disagree).filter(disagree >= need)
    out = out.orderBy(F.col(label) != "EVASIVE", F.desc("disagree_count"), key)
    return out.limit(limit) if limit else out


def most_common(rows: DataFrame, column: str, n: int) -> DataFrame:
    """T4: the n most frequent values; equal counts by value."""
    return rows.groupBy(column).agg(_n()).orderBy(F.desc("n"), column).limit(n)


def queue_order(rows: DataFrame, sample_id: str) -> DataFrame:
    """By rank, priority and margin, with defaults for nulls."""
    return rows.orderBy(F.coalesce("selection_rank", F.lit(10**9)), F.coalesce("priority_score", F.lit(0.0)).desc(), F.coalesce("margin", F.lit(0.0)).desc(), sample_id)


def scorecard(accuracy: DataFrame, key: str) -> DataFrame:
    """Judges by falling accuracy, then key."""
    return accuracy.orderBy(F.desc("accuracy_pct"), key)


def priority_order(rows: DataFrame, priority: str, salt: str, key: str) -> DataFrame:
    """By falling priority; equal ones in a hashed order."""
    return rows.orderBy(F.desc(priority), F.md5(F.concat_ws("|", F.lit(salt), F.col(key).cast("string"))), key)


def measured(rows: DataFrame, column: str, most: int = 100) -> list:
    """The values of a column in order, nulls left out; raises where there are over `most`."""
    found = [r[0] for r in rows.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has over {most} values")
    return sorted(found)


def cross_table(rows: DataFrame, row: str, column: str, value: Column, *, values: Sequence | None = None, most: int = 100, total: str = "total", none: str = "none") -> DataFrame:
    """Section 2.14: a value by two dimensions, a column for each value of the second, with totals of both.

    Totals are groups of a cube, told from null values (shown as `none`) by their grouping bits; so any aggregate has
    its own total, means as well.  Without `values` they are measured, `most` at most.
    """
    names = [str(v) for v in (values if values is not None else measured(rows, column, most))]
    cells = rows.cube(row, column).agg(value.alias("_v"), F.grouping_id().alias("_g"))
    shown = lambda c, bit: F.when(F.col("_g").bitwiseAND(bit) > 0, F.lit(total)).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(none)))
    return cells.select(shown(row, 2).alias(row), shown(column, 1).alias("_c"), "_v").groupBy(row).pivot("_c", [*names, none, total]).agg(F.first("_v"))


def agreement_matrix(labels: DataFrame, item: str, judge: str, label: str, *, most: int = 100) -> DataFrame:
    """Section 2.14: a row and a column for each judge: the percentage of shared items on which two agree.

    Each item's labels are paired within the item, whose judges are at most as many as the columns.
    """
    names = measured(labels, judge, most)
    known = labels.filter(F.col(label).isNotNull() & F.col(judge).isNotNull()).groupBy(item, judge).agg(F.min(label).alias("_l"))
    each = known.groupBy(item).agg(F.collect_list(F.struct(F.col(judge).alias("j"), "_l")).alias("_a"))
    pairs = each.select(F.explode("_a").alias("x"), "_a").select("x", F.explode("_a").alias("y"))
    counts = pairs.groupBy(F.col("x.j").alias(judge), F.col("y.j").alias("_o")).agg(F.round(100.0 * F.count_if(F.col("x._l") == F.col("y._l")) / F.count(F.lit(1)), 6).alias("_p"))
    return counts.groupBy(judge).pivot("_o", names).agg(F.first("_p"))


def markdown(rows: DataFrame, columns: Sequence[str], most: int = 10_000) -> str:
    """Section 2.14: a small table as Markdown; raises where it has over `most` rows."""
    found = rows.select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of over {most} rows")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in found]
    return "\n".join(lines)
