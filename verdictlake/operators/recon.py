"""Joins between responses, analyses, manifests and exclusion artifacts.

Broadcasts are left to Spark's size threshold and AQE: no hint is given for a side whose size isn't known.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def left_with_missing(manifest: DataFrame, observed: DataFrame, key: str, label: str, missing: str = "MISSING") -> DataFrame:
    """Every manifest row with the observed label, MISSING where there is none."""
    return manifest.join(observed.withColumn("_there", F.lit(True)), key, "left").withColumn(label, F.when(F.col("_there"), F.col(label)).otherwise(missing)).drop("_there")


def extras(manifest: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Observed rows that the manifest doesn't have."""
    return observed.join(manifest.select(key), key, "left_anti")


def overlap(base: DataFrame, other: DataFrame, key: str, label: str) -> DataFrame:
    """Labels of both sides on shared keys."""
    return base.select(key, F.col(label).alias("base")).join(other.select(key, F.col(label).alias("other")), key)


def reconcile(questions: DataFrame, responses: DataFrame, analyses: DataFrame, key: str) -> DataFrame:
    """A row for each key with its counts in the three tables and its state."""
    parts = [t.select(key).withColumn("t", F.lit(n)) for n, t in (("questions", questions), ("responses", responses), ("analyses", analyses))]
    counts = reduce(DataFrame.unionByName, parts).groupBy(key).agg(*[F.count_if(F.col("t") == n).alias(f"n_{n}") for n in ("questions", "responses", "analyses")])
    state = (
        F.when((F.col("n_responses") > 1) | (F.col("n_analyses") > 1), "duplicate")
        .when(F.col("n_questions") == 0, "extra")
        .when(F.col("n_responses") == 0, "missing_response")
        .when(F.col("n_analyses") == 0, "missing_analysis")
        .otherwise("complete")
    )
    return counts.withColumn("state", state)


def align_strictly(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """Inner join of tables that must have the same keys and labels; anything else raises."""
    both = first.withColumn("_a", F.lit(1)).join(second.select(key, F.col(label).alias("_label"), F.lit(1).alias("_b")), key, "full_outer")
    wrong = both.agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(label).eqNullSafe(F.col("_label"))).alias("mismatch")).first().asDict()
    if any(wrong.values()):
        raise ValueError(f"tables don't align: {wrong}")
    return first.join(second.drop(label), key)


def assert_same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    """Both tables have the same set of keys."""
    lost, extra = (x.join(y.select(key), key, "left_anti").limit(1).count() for x, y in ((a, b), (b, a)))
    if lost or extra:
        raise ValueError(f"key sets differ: missing {lost}, extra {extra}")


def join_with_reasons(source: DataFrame, sides: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Source with all sides on a key; `skip` names the first side that has no row for it, else null."""
    skip = None
    for name, side in sides:
        source = source.join(side.withColumn(f"_has_{name}", F.lit(True)), key, "left")
        gone = F.col(f"_has_{name}").isNull()
        skip = F.when(gone, f"missing_{name}") if skip is None else skip.when(gone, f"missing_{name}")
    return source.withColumn("skip", skip).drop(*[f"_has_{n}" for n, _ in sides])


def semi(source: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """J8."""
    return source.join(needed.select(key), key, "left_semi")


def exclude_by_alias(source: DataFrame, aliases: str, excluded: DataFrame, key: str, row_id: str) -> DataFrame:
    """Rows none of whose alias keys (an array column) is excluded."""
    hit = source.select(row_id, F.explode(aliases).alias(key)).join(excluded.select(key), key, "left_semi").select(row_id)
    return source.join(hit, row_id, "left_anti")


def exclude_by_text(source: DataFrame, excluded: DataFrame, *texts: str) -> DataFrame:
    """Rows whose texts, null-safe, don't stand together in the excluded table."""
    e = excluded.select(*[F.col(t).alias(f"_{t}") for t in texts])
    return source.join(e, reduce(lambda a, b: a & b, [F.col(t).eqNullSafe(F.col(f"_{t}")) for t in texts]), "left_anti")


def apply_exclusions(rows: DataFrame, gold_pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Rows with `excluded_by` (the first source that hits), and `contact`, the sorted tags of artifacts that touch them.

    rows: key, question_id, response_hash.  gold_pairs: question_id, response_hash; either column excludes.
    artifacts: question_id or response_hash, tag.
    """
    by_question = gold_pairs.select("question_id").filter("question_id IS NOT NULL").distinct().withColumn("_q", F.lit(True))
    by_hash = gold_pairs.select("response_hash").filter("response_hash IS NOT NULL").distinct().withColumn("_h", F.lit(True))
    tags = artifacts.filter("question_id IS NOT NULL").select("question_id", "tag")
    tags_hash = artifacts.filter("response_hash IS NOT NULL").select("response_hash", "tag")
    touched = rows.select("key", "question_id").join(tags, "question_id").select("key", "tag").unionByName(rows.select("key", "response_hash").join(tags_hash, "response_hash").select("key", "tag"))
    contact = touched.groupBy("key").agg(F.array_sort(F.collect_set("tag")).alias("contact"))
    out = rows.join(by_question, "question_id", "left").join(by_hash, "response_hash", "left").join(contact, "key", "left")
    reason = F.when(F.col("_q"), "question_id").when(F.col("_h"), "response_hash")
    return out.withColumn("excluded_by", reason).withColumn("contact", F.coalesce("contact", F.array().cast("array<string>"))).drop("_q", "_h")


def all_pairs(results: DataFrame, key: str, run: str, label: str, expected: str) -> DataFrame:
    """For every two runs, their agreement on shared keys.

    A run is a judge or rule: there are few, and each key's pairs are bounded by the number of runs.
    """
    a = results.select(key, expected, F.col(run).alias("left_run"), F.col(label).alias("l"))
    b = results.select(key, F.col(run).alias("right_run"), F.col(label).alias("r"))
    both = a.join(b, key).filter("left_run < right_run")
    is_c = lambda c: F.col(c) == "COMPLETE"
    return both.groupBy("left_run", "right_run").agg(
        one("rows"),
        F.count_if(F.col("l") == F.col("r")).alias("agree"),
        F.count_if(is_c("l") == is_c("r")).alias("binary_agree"),
        F.count_if((F.col("l") == F.col(expected)) & (F.col("r") != F.col(expected))).alias("left_only_correct"),
        F.count_if((F.col("l") != F.col(expected)) & (F.col("r") == F.col(expected))).alias("right_only_correct"),
        F.round(100.0 * F.count_if(F.col("l") == F.col("r")) / F.count(F.lit(1)), 3).alias("agree_pct"),
    )


def theta_best(offers: DataFrame, profiles: DataFrame, text: str, pattern: str, fits: Column, order: Sequence[Column], offer_id: str) -> DataFrame:
    """The best profile of each offer among those whose pattern its text matches and that fit.

    Distinct texts are matched with distinct patterns, which are few; offers and profiles then join by equality.
    """
    matched = offers.select(text).distinct().join(profiles.select(pattern).distinct(), F.rlike(text, F.col(pattern)))
    both = offers.join(matched, text).join(profiles, pattern).filter(fits)
    columns = both.columns
    best = both.groupBy(offer_id).agg(F.min_by(F.struct(*columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("b"))
    return best.select("b.*")


def theta_first(offers: DataFrame, profiles: DataFrame, text: str, pattern: str, need: Column, have: Column, same: Sequence[str], cost: Column, tie: str, offer_id: str) -> DataFrame:
    """J14 where a profile fits if what it has is at least what the offer needs: the cheapest, ties to the smallest `tie`.

    The cost depends on the offer and on the profile's columns `same` alone, so of the profiles that agree in these the
    smallest `tie` that fits is the best.  It is a running least over profiles and distinct needs sorted together, so
    no offer meets all of its profiles and work grows with the rows of both.
    """
    p, o = profiles.withColumn("_have", have), offers.withColumn("_need", need)
    matched = offers.select(text).distinct().join(profiles.select(pattern).distinct(), F.rlike(text, F.col(pattern)))
    asks = o.filter(F.col("_need").isNotNull()).select(text, "_need").distinct().join(matched, text)
    held = p.filter(F.col("_have").isNotNull()).groupBy(pattern, *same, F.col("_have").alias("_v")).agg(F.min(tie).alias("_tie"))
    asked = asks.join(p.select(pattern, *same).distinct(), pattern).withColumn("_v", F.col("_need"))
    both = held.withColumn("_ask", F.lit(False)).unionByName(asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True)
    upto = Window.partitionBy(pattern, *same).orderBy(F.desc("_v"), "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_first", F.min("_tie").over(upto)).filter(F.col("_ask") & F.col("_first").isNotNull()).select(text, "_need", *same, F.col("_first").alias(tie))
    best = o.join(found, [text, "_need"])
    columns = [c for c in best.columns if c != "_need"]
    return best.groupBy(offer_id).agg(F.min_by(F.struct(*columns), F.struct(cost.alias("cost"), F.col(tie).alias("tie"))).alias("b")).select("b.*")


def merge_recovered(primary: DataFrame, fallback: DataFrame, key: str, label: str, is_error: Column) -> DataFrame:
    """The fallback's label where the primary's is an error, and where it came from."""
    f = fallback.select(key, F.col(label).alias("_fallback"))
    taken = is_error & F.col("_fallback").isNotNull()
    out = primary.join(f, key, "left").withColumn("provenance", F.struct(F.when(taken, "fallback").otherwise("primary").alias("source"), F.when(taken, F.col(label)).alias("replaced")))
    return out.withColumn(label, F.when(taken, F.col("_fallback")).otherwise(F.col(label))).drop("_fallback")


def override_layers(layers: Sequence[tuple[str, DataFrame]], key: str, order: str | None = None) -> DataFrame:
    """Each key's row from the last layer that has it; inside a layer the latest by `order`."""
    tagged = [t.withColumn("layer", F.lit(n)).withColumn("_p", F.lit(i)) for i, (n, t) in enumerate(layers)]
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy(key).orderBy(F.desc("_p"), *([F.desc(order)] if order else []))
    return all_.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_p")


def fill(rows: DataFrame, lookup: DataFrame, key: str, column: str, absent: Column | None = None, default: Column | None = None) -> DataFrame:
    """A column filled from a lookup, then a default, where it is absent."""
    absent = F.col(column).isNull() if absent is None else absent
    found = lookup.select(key, F.col(column).alias("_found"))
    value = F.coalesce("_found", default) if default is not None else F.col("_found")
    return rows.join(found, key, "left").withColumn(column, F.when(absent, value).otherwise(F.col(column))).drop("_found")


def compare_versions(old: DataFrame, new: DataFrame, keys: Sequence[str], label: str, group: str) -> DataFrame:
    """How many labels changed for each group between two versions."""
    both = old.select(*keys, F.col(label).alias("_old")).join(new.select(*keys, F.col(label).alias("_new")), list(keys))
    return both.groupBy(group).agg(one("rows"), F.count_if(~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed"))


def content_mismatch(responses: DataFrame, analyses: DataFrame, keys: Sequence[str], signature: str) -> DataFrame:
    """Keys whose content differs between a response and what was analysed."""
    a = analyses.select(*keys, F.col(signature).alias("_analysed"))
    return responses.join(a, list(keys)).filter(~F.col(signature).eqNullSafe(F.col("_analysed"))).select(*keys)


def priority_by_alias(rows: DataFrame, aliases: str, scores: DataFrame, key: str, score: str, row_id: str) -> DataFrame:
    """The greatest score that any alias key of a row has."""
    best = rows.select(row_id, F.explode(aliases).alias(key)).join(scores, key).groupBy(row_id).agg(F.max(score).alias(score))
    return rows.join(best, row_id, "left")


def resolve_prompt(rows: DataFrame, lookup: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Own text, else own prompt, else the lookup's by the first of the candidate keys that is known."""
    found = []
    for c in candidates:
        rows = rows.join(lookup.select(F.col("lookup_key").alias(c), F.col("prompt").alias(f"_by_{c}")), c, "left")
        found.append(F.col(f"_by_{c}"))
    return rows.withColumn("resolved", F.coalesce("text", "prompt", *found)).drop(*[f"_by_{c}" for c in candidates])


def pivot_votes(results: DataFrame, key: str, judge: str, label: str) -> DataFrame:
    """Key to a map of judge to label."""
    return results.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(judge, label)))).alias("votes"))


def revise_gold(manifest: DataFrame, reviews: DataFrame, key: str, label: str) -> DataFrame:
    """The reviewed label only where the review finds gold likely wrong; keeps the old one."""
    r = reviews.select(key, "verdict", "new_label")
    changed = F.col("verdict") == "likely_gold_wrong"
    return manifest.join(r, key, "left").withColumn("former", F.col(label)).withColumn(label, F.when(changed & F.col("new_label").isNotNull(), F.col("new_label")).otherwise(F.col(label)))


def nest_judges(rows: DataFrame, key: str) -> DataFrame:
    """Key to map of judge to map of regime to label."""
    inner = rows.groupBy(key, "judge").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("regime", "label")))).alias("regimes"))
    return inner.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("judge", "regimes"))).alias("judges"))


def decision_trails(decisions: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """The decisions of each manifest key, in order."""
    return semi(decisions, manifest, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("reviewed_at", "decision", "new_label"))).alias("trail"))


def join_or_raise(runs: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Runs with their registry row; a run without one raises."""
    gone = runs.join(registry.select(key), key, "left_anti").select(key).limit(3).collect()
    if gone:
        raise ValueError(f"no registry row for {[r[0] for r in gone]}")
    return runs.join(registry, key).withColumn("cost", F.col("seconds") * F.col("rate") / 3600)


def preference_pairs(sources: DataFrame, rollouts: DataFrame, shortest: Column | None = None) -> DataFrame:
    """For each id with right and wrong rollouts, the shortest right one against the shortest of each wrong label."""
    order = shortest if shortest is not None else F.struct(F.coalesce("generated_tokens", F.lit(0)), F.coalesce("rollout_index", F.lit(0)), F.coalesce("raw_judge_response", F.lit("")))
    right = rollouts.filter(F.col("observed") == F.col("expected")).groupBy("id").agg(F.min_by("raw_judge_response", order).alias("chosen"), one("n_right"))
    wrong = rollouts.filter((F.col("observed") != F.col("expected")) & F.col("observed").isin("COMPLETE", "DENIAL", "EVASIVE")).groupBy("id", F.col("observed").alias("rejected_label")).agg(F.min_by("raw_judge_response", order).alias("rejected"), one("n_wrong"))
    out = sources.join(right, "id").join(wrong, "id")
    return out.withColumn("boundary", F.concat_ws("->", "expected", "rejected_label")).withColumn("pair_id", F.concat_ws("::", "id", "rejected_label"))
