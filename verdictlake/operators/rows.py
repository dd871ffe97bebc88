"""Row rewriting and row filters of responses, analyses and training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import LABELS, complete_side, is_label, last_label
from ..functions.status import Response, retry_candidate
from ..functions.text import cjk_hits
from ..sources.scratch import scratch_path


def nested_strings(df: DataFrame, json: str, key: str) -> DataFrame:
    """P5: key, path and every string inside a JSON document of any depth, level by level.

    A step explodes the objects and arrays of the level before; paths grow by `.name` or `[index]`.  Strings and what is
    still to be exploded are written at each level, so a task reads a split of a file, however large the table is.
    """
    spark = df.sparkSession
    out, kept = scratch_path(spark, "nested"), ""
    kind = F.schema_of_variant("v")
    level = df.select(F.col(key).alias("k"), F.lit("").alias("path"), F.expr(f"try_parse_json(`{json}`)").alias("v")).filter(F.col("v").isNotNull())
    found = level.select(F.col("k").alias(key), F.when(F.col("path") == "", "$").otherwise(F.col("path")).alias("path"), F.col("v").cast("string").alias("string")).schema
    while True:
        strings = level.filter(kind == "STRING").select(F.col("k").alias(key), F.when(F.col("path") == "", "$").otherwise(F.col("path")).alias("path"), F.col("v").cast("string").alias("string"))
        strings.write.mode("append").parquet(out)
        inner = scratch_path(spark, "nested-level")
        level.filter(kind.startswith("OBJECT<") | kind.startswith("ARRAY<")).write.parquet(inner)
        if kept:  # exploded in full
            where = spark._jvm.org.apache.hadoop.fs.Path(kept)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        kept = inner
        left = spark.read.schema(level.schema).parquet(inner)
        if left.isEmpty():
            return spark.read.schema(found).parquet(out)
        level = spark.sql("SELECT t.k, t.path || if(e.key IS NULL, '[' || e.pos || ']', if(t.path = '', '', '.') || e.key) AS path, e.value AS v FROM {t} t, LATERAL variant_explode(t.v) e", t=left)


def cjk_report(df: DataFrame, json: str, key: str) -> DataFrame:
    """a row for each run of CJK characters in any string of a JSON document, with its field path and surroundings."""
    each = nested_strings(df, json, key).select(key, F.col("path").alias("field_path"), F.explode(cjk_hits(F.col("string"))).alias("h"))
    return each.select(key, "field_path", F.col("h.start").alias("start"), F.col("h.match").alias("match_text"), F.col("h.snippet").alias("snippet"))


def normalize_results(df: DataFrame) -> DataFrame:
    """Key, observed, raw, generated_tokens, is_truncated from rows of three shapes.

    The columns of all three must be there, null where a row has another shape.
    """
    judge, local = F.col("compliance").isNotNull() & F.col("model").isNotNull() & F.col("question_id").isNotNull(), F.col("observed").isNotNull() & F.col("metadata").isNotNull()
    content = F.coalesce(F.get_json_object("completion", "$[0].content"), F.get_json_object("completion", "$[0].message.content"), F.lit(""))
    meta_key = F.coalesce(F.get_json_object("metadata", "$.key"), F.concat_ws("::", "model", "question_id"), F.regexp_replace("id", "^gold::", ""))
    up = lambda c: F.upper(F.coalesce(F.when(c != "", c), F.lit("UNPARSED")))
    return df.select(
        F.when(judge, F.concat_ws("::", "model", "question_id")).when(local, meta_key).otherwise(F.regexp_replace(F.get_json_object("info", "$.id"), "^gold::", "")).alias("key"),
        F.when(judge, up(F.col("compliance"))).when(local, up(F.col("observed"))).otherwise(last_label(content)).alias("observed"),
        F.when(judge | local, F.col("raw_judge_response")).otherwise(content).alias("raw"),
        F.when(judge, None).when(local, F.col("generated_tokens")).otherwise(F.get_json_object("token_usage", "$.output_tokens").cast("long")).alias("generated_tokens"),
        (~judge & F.coalesce("is_truncated", F.lit(False))).alias("is_truncated"),
    )


def set_field(df: DataFrame, name: str, value: str) -> DataFrame:
    """A constant column, added or written over."""
    return df.withColumn(name, F.lit(value))


def recode_moderated(df: DataFrame, reason: Column, at: str) -> DataFrame:
    """Rows with a moderation reason become ERROR_ORIGINAL_MODERATION; `former_label` keeps what they were."""
    new = "ERROR_ORIGINAL_MODERATION"
    hit = reason.isNotNull() & ~F.col("compliance").eqNullSafe(F.lit(new))
    old = F.coalesce(F.concat(F.lit("'"), F.col("compliance"), F.lit("'")), F.lit("None"))
    told = F.concat(F.lit("Post-processed: original response stopped by provider moderation/classifier ("), reason, F.lit("); changed compliance from "), old, F.lit(f" to {new}."))
    analysis = F.when(F.coalesce("judge_analysis", F.lit("")) != "", F.concat(told, F.lit(" Previous judge analysis: "), F.col("judge_analysis"))).otherwise(told)
    return df.withColumns({
        "former_label": F.when(hit, F.col("compliance")), "judge_analysis": F.when(hit, analysis).otherwise(F.col("judge_analysis")), "timestamp": F.when(hit, F.lit(at)).otherwise(F.col("timestamp")),
        "raw_judge_response": F.when(~hit, F.col("raw_judge_response")), "compliance": F.when(hit, F.lit(new)).otherwise(F.col("compliance")),
    })


def recode_failed(df: DataFrame, finish: Column) -> DataFrame:
    """Rows whose finish reason is error become ERROR_ORIGINAL_RESPONSE unless they are an error already."""
    hit = (finish == "error") & ~F.coalesce(F.col("compliance").startswith("ERROR_"), F.lit(False))
    return df.withColumn("compliance", F.when(hit, "ERROR_ORIGINAL_RESPONSE").otherwise(F.col("compliance")))


def training_rows(df: DataFrame, system: str, prompt: str = "prompt", completion: str = "completion", label: str = "label", meta: Sequence[str] = ()) -> DataFrame:
    """Chat messages, label and metadata of selected rows."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.select(
        "id", F.array(message("system", F.lit(system)), message("user", F.col(prompt)), message("assistant", F.col(completion))).alias("messages"), F.col(label).alias("label"),
        F.struct(*meta, F.length(prompt).alias("prompt_chars"), F.length(completion).alias("response_chars")).alias("metadata"),
    )


def clean_for_retry(df: DataFrame, order: str, *, retry: bool = True, metadata: bool = False, truncations: bool = False, subprovider: Column | None = None, subproviders: Sequence[str] = ()) -> DataFrame:
    """each response with `removed`: why it goes, or null.  df: question_id, model, response (JSON) and an order.

    A row is a duplicate if a row before it has been kept under its question; rows that go for other reasons don't count.
    """
    r = Response(F.col("response"), F.col("model"))
    tagged = df.withColumn("_s", r.status()["status"])
    status = F.col("_s")
    moderated = status == "moderation"
    named = F.coalesce(F.lower(subprovider).isin(*[s.lower() for s in subproviders]), F.lit(False)) if subprovider is not None and subproviders else F.lit(False)
    own = (
        F.when(F.lit(retry) & (status == "empty_response"), "empty_response")
        .when(moderated & named, "subprovider_moderation")
        .when(~moderated & F.lit(retry) & retry_candidate(status), "retryable_error")
        .when(F.lit(metadata) & (status == "metadata_error"), "metadata_error")
        .when(F.lit(truncations) & (status == "truncation"), "truncation")
    )
    before = Window.partitionBy("question_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    kept_before = F.coalesce(F.max(F.col("_own").isNull()).over(before), F.lit(False))
    out = tagged.withColumn("_own", own).withColumn("_again", kept_before)
    return out.withColumn("removed", F.when(F.col("_own") == "empty_response", "empty_response").when(F.col("_again"), "duplicate_question_id").otherwise(F.col("_own"))).drop("_own", "_again", "_s")


def analysis_fits(status: Column, label: Column, fallback: bool = False, tried: Column | None = None) -> Column:
    """is an analysis still right for its response's state?"""
    filtered = F.lit(True) if not fallback else F.coalesce(tried, F.lit(False))
    return (
        F.when(status == "moderation", label == "ERROR_ORIGINAL_MODERATION")
        .when(status == "truncation", label == "ERROR_ORIGINAL_TRUNCATION")
        .when((status == "success") & (label == "ERROR_JUDGE_CONTENT_FILTER"), filtered)
        .when(status == "success", ~label.isin("ERROR_ORIGINAL_RESPONSE", "ERROR_ORIGINAL_MODERATION", "ERROR_ORIGINAL_TRUNCATION"))
        .otherwise(label == "ERROR_ORIGINAL_RESPONSE")
    )


def matching(types: Sequence[str] = (), labels: Sequence[str] = (), type_column: str = "question_type", label_column: str = "label") -> Column:
    """rows of the wanted types and labels; unknown names raise."""
    wrong = set(labels) - set(LABELS)
    if wrong:
        raise ValueError(f"unknown labels {sorted(wrong)}")
    keep = F.lit(True)
    if types:
        keep = keep & F.col(type_column).isin(*types)
    if labels:
        keep = keep & F.col(label_column).isin(*labels)
    return keep


def models_with(df: DataFrame, model: str, least: int) -> DataFrame:
    """rows of models with enough rows; counts combine first, so that a large model isn't one window."""
    return df.join(df.groupBy(model).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(model), model, "left_semi")


def error_text(strings: Column, pattern: str) -> Column:
    """does any string tell of a quota or moderation error?"""
    return F.exists(strings, lambda s: s.rlike(pattern))


def normalized_gpu(name: Column) -> Column:
    """An offer's GPU type without a spot note, in capitals, white space collapsed."""
    return F.trim(F.regexp_replace(F.upper(F.regexp_replace(name, r"(?i)\s*\(spot\)\s*$", "")), r"\s+", " "))


def rank_offers(
    offers: DataFrame, profiles: DataFrame, rows: int, *, startup: str = "cold", spot: bool = True, spot_used: int = 0, spot_most: int = 2, estimated: bool = False,
    excluded: Sequence[str] = (), providers: Sequence[str] = (), most_cost: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Eligible offers by total cost, then time; and how many offers each rule left out.

    An offer's profile is the one that fits its type, memory and socket best: a named socket counts 10, its own provider 2,
    then the latest measured counts, then the first.  profiles has an `ordinal`; startup times are maps by mode, a
    provider's own ones first.  An offer whose profile has no time for the mode raises.
    """
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    wide = F.col("is_spot") & F.lit(not spot or spot_used >= spot_most)
    gone = F.lit(False)
    if excluded:
        gone = gone | F.col("id").isin(*excluded)
    if providers:
        gone = gone | text("provider").isin(*[p.lower() for p in providers])
    reason = (
        F.when(gone, "explicitly_excluded").when((F.coalesce("gpu_count", F.lit(0)) != 1) | (F.coalesce("gpu_memory", F.lit(0.0)) <= 0), "not_single")
        .when(~text("stock_status").isin("available", "low"), "ineligible_stock").when(F.coalesce(wide, F.lit(False)), "spot_policy_excluded")
    )
    tagged = offers.withColumn("_reason", reason).withColumn("_type", normalized_gpu(F.col("gpu_type")))
    p = profiles.filter(F.lit(estimated) | (F.coalesce("confidence", F.lit("measured")) == "measured")).withColumnsRenamed({"socket": "_socket"})
    # types and patterns are few: they are matched by themselves, and offers then join by their type
    types = tagged.filter("_reason IS NULL").select("_type").distinct().join(p.select("gpu_type_regex").distinct(), F.rlike("_type", F.concat(F.lit("(?i)"), F.col("gpu_type_regex"))))
    fits = F.col("minimum_gpu_memory_gb").isNull() | (F.col("gpu_memory") >= F.col("minimum_gpu_memory_gb"))
    socketed = text("_socket") != ""
    score = F.when(socketed, 10).otherwise(0) + F.when(text("source_provider") == text("provider"), 2).otherwise(0)
    matched = tagged.filter("_reason IS NULL").select("id", "_type", "gpu_memory", "provider", "socket").join(types, "_type").join(p, "gpu_type_regex").filter(fits & (~socketed | (text("_socket") == text("socket"))))
    chosen = [c for c in p.columns if c != "_socket"]
    best = matched.groupBy("id").agg(F.max_by(F.struct(*chosen), F.struct(score, F.coalesce("measured_at", F.lit("")), -F.col("ordinal"))).alias("p"))
    joined = tagged.filter("_reason IS NULL").join(best, "id", "left")
    own = F.try_element_at(F.try_element_at(F.col("p.provider_startup_seconds"), text("provider")), F.lit(startup))
    seconds = F.coalesce(own, F.try_element_at(F.col("p.startup_seconds"), F.lit(startup)))
    seconds = F.when(F.col("p").isNotNull() & seconds.isNull(), F.raise_error(F.lit(f"no startup estimate for {startup}")).cast("double")).otherwise(seconds)
    warned = own.isNull() & F.lit(startup != "none") & (F.lower(F.coalesce("p.source_provider", F.lit(""))) != "") & (F.lower("p.source_provider") != text("provider"))
    costed = joined.withColumns({"profile_id": F.col("p.profile_id"), "inference_seconds": rows / F.col("p.rows_per_second"), "startup_seconds": seconds, "startup_transferred": F.coalesce(warned, F.lit(False))})
    costed = costed.withColumn("total_cost", (F.col("inference_seconds") + F.col("startup_seconds")) * F.col("price_value") / 3600)
    late = F.when(F.col("p").isNull(), "missing_profile")
    if most_cost is not None:
        late = late.when(F.col("total_cost") > most_cost, "cost_threshold_excluded")
    costed = costed.withColumn("_reason", late)
    counts = tagged.filter("_reason IS NOT NULL").select("_reason").unionByName(costed.select("_reason"))
    counts = counts.groupBy(F.coalesce("_reason", F.lit("ranked_offers")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    ranked = costed.filter("_reason IS NULL").drop("_reason", "_type", "p").orderBy("total_cost", F.col("inference_seconds") + F.col("startup_seconds"), "id")
    return ranked, counts


def recovery_subset(rows: DataFrame, label: str, errors: Sequence[str], key: str, sample: DataFrame) -> DataFrame:
    """rows with an error label, which the sample must have too."""
    subset = rows.filter(F.col(label).isin(*errors))
    gone = subset.join(sample.select(key), key, "left_anti").limit(1).count()
    if gone:
        raise ValueError("an error row isn't in the sample")
    return subset


def usable_pairs(rows: DataFrame, evaluation: DataFrame, order: str) -> DataFrame:
    """the first row of each pair that isn't in the evaluation set and has a side of the COMPLETE boundary."""
    side = complete_side(F.col("expected_label"), F.col("rejected_label"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("pair_id").orderBy(order))).filter("_r = 1").drop("_r")
    return first.join(evaluation.select("id"), "id", "left_anti").withColumn("side", side).filter("side IS NOT NULL")


def survey_scores(answers: DataFrame, surveys: DataFrame) -> DataFrame:
    """Section 2.15: mean answer by survey, model and category; inverted items count from the other end of the scale."""
    items = surveys.select(F.col("name").alias("survey"), "scale.min", "scale.max", F.explode("items").alias("item")).select("survey", "min", "max", F.col("item.id").alias("item_id"), "item.category", "item.inversion")
    value = F.when(F.coalesce("inversion", F.lit(False)), F.col("min") + F.col("max") - F.col("value")).otherwise(F.col("value"))
    return answers.join(items, ["survey", "item_id"]).filter(F.col("value").between(F.col("min"), F.col("max"))).groupBy("survey", "model", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("score"))


def known_labels(df: DataFrame, label: str) -> DataFrame:
    return df.filter(is_label(F.col(label)))
