import json

import pytest
from pyspark.sql import functions as F

from verdictlake.operators import report, rows


def test_cleanup_counts_only_kept_rows_as_first(spark):
    ok = json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": "x"}}]})
    bad = json.dumps({"error": {"code": 500}})
    cut = json.dumps({"choices": [{"finish_reason": "length", "message": {"content": "x"}}]})
    data = [(1, "q1", bad), (2, "q1", ok), (3, "q1", ok), (4, "q2", "{}"), (5, "q3", cut), (6, "q3", ok)]
    frame = spark.createDataFrame([(n, q, "m", r) for n, q, r in data], "n int, question_id string, model string, response string")
    got = {r.n: r.removed for r in rows.clean_for_retry(frame, "n").collect()}
    assert got == {1: "retryable_error", 2: None, 3: "duplicate_question_id", 4: "empty_response", 5: None, 6: "duplicate_question_id"}
    got = {r.n: r.removed for r in rows.clean_for_retry(frame, "n", truncations=True).collect()}
    assert got[5] == "truncation" and got[6] is None


def test_analysis_state(spark):
    cases = [("success", "COMPLETE", True), ("success", "ERROR_ORIGINAL_RESPONSE", False), ("moderation", "DENIAL", False), ("truncation", "ERROR_ORIGINAL_TRUNCATION", True), ("provider_error", "ERROR_ORIGINAL_RESPONSE", True), ("success", "ERROR_JUDGE_CONTENT_FILTER", True)]
    frame = spark.createDataFrame(cases, "s string, l string, want boolean")
    assert frame.filter(rows.analysis_fits(F.col("s"), F.col("l")) != F.col("want")).count() == 0


def test_recoding(spark):
    frame = spark.createDataFrame([("DENIAL", "old", "t", "raw", "sensitive"), ("ERROR_ORIGINAL_MODERATION", "a", "t", "raw", "x"), ("COMPLETE", "a", "t", "raw", None)], "compliance string, judge_analysis string, timestamp string, raw_judge_response string, why string")
    a, b, c = rows.recode_moderated(frame, F.col("why"), "now").collect()
    assert (a.compliance, a.former_label, a.timestamp, a.raw_judge_response) == ("ERROR_ORIGINAL_MODERATION", "DENIAL", "now", None)
    assert a.judge_analysis.endswith("changed compliance from 'DENIAL' to ERROR_ORIGINAL_MODERATION. Previous judge analysis: old")
    assert (b.timestamp, b.former_label, c.compliance, c.raw_judge_response) == ("t", None, "COMPLETE", "raw")
    assert [r.compliance for r in rows.recode_failed(frame, F.lit("error")).collect()] == ["ERROR_ORIGINAL_RESPONSE", "ERROR_ORIGINAL_MODERATION", "ERROR_ORIGINAL_RESPONSE"]


def test_nested_strings(spark):
    doc = json.dumps({"a": "x", "b": [{"c": "y"}, 3, None, ["z"]], "d": True})
    got = rows.nested_strings(spark.createDataFrame([(1, doc), (2, "bad")], "k int, j string"), "j", "k").collect()
    assert sorted((r.path, r.string) for r in got) == [("a", "x"), ("b[0].c", "y"), ("b[3][0]", "z")]


def test_strings_of_any_depth(spark):
    doc = "end"
    for i in range(12):
        doc = {"a": doc, "b": f"s{i}"} if i % 2 else [doc]
    got = rows.nested_strings(spark.createDataFrame([(1, json.dumps(doc))], "k int, j string"), "j", "k").collect()
    assert sorted(r.string for r in got) == sorted(["end", *(f"s{i}" for i in range(1, 12, 2))])


def test_results_of_three_shapes(spark):
    schema = "compliance string, model string, question_id string, observed string, metadata string, id string, raw_judge_response string, generated_tokens long, is_truncated boolean, info string, completion string, token_usage string"
    data = [("denial", "m", "q", None, None, None, "raw", None, None, None, None, None), (None, None, None, "complete", '{"key":"m::q2"}', None, "r", 5, True, None, None, None), (None, None, None, None, None, None, None, None, None, '{"id":"gold::m::q3"}', '[{"content":"LABEL: EVASIVE"}]', '{"output_tokens":7}')]
    got = [tuple(r) for r in rows.normalize_results(spark.createDataFrame(data, schema)).collect()]
    assert got == [("m::q", "DENIAL", "raw", None, False), ("m::q2", "COMPLETE", "r", 5, True), ("m::q3", "EVASIVE", "LABEL: EVASIVE", 7, False)]


OFFER = "id string, gpu_type string, gpu_count int, gpu_memory double, provider string, socket string, stock_status string, is_spot boolean, price_value double"
PROFILE = "ordinal int, profile_id string, gpu_type_regex string, minimum_gpu_memory_gb double, socket string, source_provider string, rows_per_second double, startup_seconds map<string,double>, provider_startup_seconds map<string,map<string,double>>, confidence string, measured_at string"


def test_offers(spark):
    offers = spark.createDataFrame([
        ("a", "h100_80gb", 1, 80.0, "P", "PCIe", "Available", False, 2.0), ("b", "H100 80GB (Spot)", 1, 80.0, "q", "SXM5", "low", True, 1.0), ("c", "H100", 2, 80.0, "p", "PCIe", "low", False, 0.1),
        ("d", "X", 1, 80.0, "p", "PCIe", "low", False, 0.1), ("e", "H100", 1, 80.0, "p", "PCIe", "High", False, 0.1), ("f", "H100", 1, 80.0, "Z", "PCIe", "low", False, 0.1), ("g", "H100", 1, 40.0, "p", "SXM5", "low", False, 3.0),
    ], OFFER)
    cold = {"cold": 60.0, "none": 0.0}
    profiles = spark.createDataFrame([
        (0, "fast", "^h100", 60.0, "SXM5", "p", 2.0, cold, {"q": {"cold": 30.0}}, "measured", "2026-01-01"), (1, "old", "^h100", 60.0, None, "p", 1.0, cold, {}, "measured", "2025-01-01"),
        (2, "new", "^h100", None, "", "p", 4.0, cold, {}, None, "2026-02-01"), (3, "guess", "^", None, None, "p", 100.0, cold, {}, "estimated", "2027-01-01"),
    ], PROFILE)
    ranked, counts = rows.rank_offers(offers, profiles, 3600, providers=["z"])
    got = [(r.id, r.profile_id, r.inference_seconds, r.startup_seconds, r.startup_transferred) for r in ranked.collect()]
    assert got == [("b", "fast", 1800.0, 30.0, False), ("a", "new", 900.0, 60.0, False), ("g", "new", 900.0, 60.0, False)]
    assert {r.reason: r.n for r in counts.collect()} == {"explicitly_excluded": 1, "not_single": 1, "missing_profile": 1, "ineligible_stock": 1, "ranked_offers": 3}
    ranked, counts = rows.rank_offers(offers, profiles, 3600, startup="none", spot_used=2, estimated=True, excluded=["g"], most_cost=0.002)
    assert [(r.id, r.profile_id) for r in ranked.collect()] == [("d", "guess"), ("f", "guess")]
    assert {r.reason: r.n for r in counts.collect()} == {"explicitly_excluded": 1, "not_single": 1, "spot_policy_excluded": 1, "ineligible_stock": 1, "cost_threshold_excluded": 1, "ranked_offers": 2}


def test_cjk_report(spark):
    doc = json.dumps({"question_id": "q", "response": {"choices": [{"message": {"content": "aa 中文 bb 漢字 cc"}}]}, "n": 1})
    got = rows.cjk_report(spark.createDataFrame([(1, doc)], "line int, j string"), "j", "line").collect()
    assert sorted((r.field_path, r.match_text) for r in got) == [("response.choices[0].message.content", "中文"), ("response.choices[0].message.content", "漢字")]


def test_reports(spark):
    gold = spark.createDataFrame([("a", "EVASIVE"), ("b", "DENIAL"), ("c", "DENIAL")], "key string, label string")
    votes = spark.createDataFrame([("a", {"x": "DENIAL", "y": "DENIAL"}), ("b", {"x": "COMPLETE", "y": "COMPLETE", "z": "EVASIVE"}), ("c", {"x": "DENIAL"})], "key string, votes map<string,string>")
    assert [r.key for r in report.review_queue(gold, votes, "key", "label").collect()] == ["a", "b"]
    assert [tuple(r) for r in report.most_common(gold, "label", 1).collect()] == [("DENIAL", 2)]
    stats = report.model_stats(gold.select(F.lit("f").alias("file"), F.lit("v/m").alias("model"), "label"), "file", "model", "label").first()
    assert (stats.dominant, stats.creator, stats.total) == ("DENIAL", "v", 3)
    assert report.markdown(gold.filter("key = 'a'"), ["key", "label"]) == "| key | label |\n|---|---|\n| a | EVASIVE |"
    errors = spark.createDataFrame([("q1", "success", "r", "COMPLETE", "f", "x", "p"), ("q2", "success", "r", None, "f", "x", "p"), ("q3", "truncation", "r", "DENIAL", "f", "x", "p")], "question_id string, status string, reason string, compliance string, finish string, family string, provider string")
    counts, shown = report.eval_errors(errors)
    overall = counts.filter("dimension = 'overall'").first()
    assert (overall.rows, overall.retained, overall.missing_analysis) == (3, 2, 1)
    assert {r.bucket: r.examples for r in shown.collect()} == {"success | <missing_analysis>": ["q2"], "truncation | DENIAL": ["q3"]}


def test_survey_scores(spark):
    surveys = spark.createDataFrame([("s", (1, 5), [("i", "c", False), ("j", "c", True)])], "name string, scale struct<min:long,max:long>, items array<struct<id:string,category:string,inversion:boolean>>")
    answers = spark.createDataFrame([("s", "m", "i", 4), ("s", "m", "j", 2), ("s", "m", "i", 9)], "survey string, model string, item_id string, value long")
    r = rows.survey_scores(answers, surveys).first()
    assert (r.n, r.score) == (2, 4.0)


def test_nested_strings_leave_no_other_session(spark, monkeypatch):
    monkeypatch.setattr(type(spark), "newSession", lambda self: (_ for _ in ()).throw(AssertionError("the caller's settings would be lost")))
    docs = spark.createDataFrame([(1, '{"a":{"b":[["x"],{}]},"c":null,"d":2}'), (2, '"y"'), (3, "{"), (4, None), (5, "[]")], "line int, j string")
    assert sorted(map(tuple, rows.nested_strings(docs, "j", "line").collect())) == [(1, "a.b[0][0]", "x"), (2, "$", "y")]
