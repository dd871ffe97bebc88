import hashlib
import hmac
import json
import math
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdictlake.functions import labels as L
from verdictlake.functions import text as X
from verdictlake.functions.status import Response


def chat(finish="stop", content="Answer", native=None, **more):
    choice = {"finish_reason": finish, "message": {"content": content}}
    if native:
        choice["native_finish_reason"] = native
    return {"choices": [choice], **more}


SHAPES = [
    (chat(), "success", "finish_reason:stop"),
    (chat("content_filter", "", native="sensitive"), "moderation", "content_filter"),
    (chat("stop", "", native="sensitive"), "moderation", "sensitive"),
    (chat("length", "cut"), "truncation", "finish_reason:length"),
    ({"error": {"message": "overloaded", "code": 502}}, "provider_error", "top_error_code:502"),
    ({"error": {"type": "server"}}, "provider_error", "top_error:server"),
    ({"error": "broken"}, "provider_error", "top_error"),
    ({"choices": [{"finish_reason": "error", "error": {"code": 500, "message": "x"}, "message": {"content": ""}}]}, "provider_error", "choice_error_code:500"),
    ({"error": {"message": "Your input was flagged"}}, "moderation", "moderation_error_text"),
    ({"error": {"type": "content_filter", "message": "no"}}, "moderation", "content_filter"),
    ({"error": {"code": 500, "metadata": {"moderation": False}}}, "provider_error", "top_error_code:500"),
    ({"error": {"code": 403, "metadata": {"reasons": ["violent", "policy violation"]}}}, "moderation", "moderation_error_text"),
    ({"error": {"content_filter": {"recitation": 1}, "type": "server"}}, "provider_error", "top_error:server"),
    ({"_llm_client": {"standardized_response": {"finish_reason": "stop", "content": "ok"}}}, "success", "_llm_client.standardized_response.finish_reason:stop"),
    ({"_llm_client": {"error_info": {"status_code": 429}}}, "provider_error", "llm_client_error_status:429"),
    ({"stop_reason": "stop_sequence", "content": [{"type": "text", "text": "hi"}]}, "success", "stop_reason:stop_sequence"),
    ({"stop_reason": "end_turn", "content": [{"type": "thinking", "thinking": "hm"}]}, "missing_content", "missing_final_content"),
    (chat("stop", [{"type": "text", "text": "block"}]), "success", "finish_reason:stop"),
    (chat("stop", "x", native="RECITATION"), "moderation", "RECITATION"),
    (chat("stop", "", usage={"completion_tokens": 3}), "moderation", "empty_stop_content_suppressed"),
    (chat("stop", "", usage={"completion_tokens": 900}), "missing_content", "missing_final_content"),
    (chat("stop", "x", native="OTHER"), "metadata_error", "native_finish_reason:OTHER"),
    (chat(None, "x"), "metadata_error", "missing_finish_reason"),
    (chat("content_filter", "", native="MAX_TOKENS"), "truncation", "native_finish_reason:MAX_TOKENS"),
    (chat("strange", "x"), "unknown_metadata", "unknown_finish_reason:strange"),
    ({"choices": []}, "unknown_metadata", "malformed_choices"),
    ({"content": []}, "unknown_metadata", "missing_stop_reason"),
    ({"id": "x"}, "unknown_metadata", "unrecognized_response_shape"),
    ({}, "empty_response", "empty_response"),
]


def test_response_status(spark):
    rows = [(i, json.dumps(s[0])) for i, s in enumerate(SHAPES)] + [(len(SHAPES), None)]
    frame = spark.createDataFrame(rows, "i int, response string")
    got = {r.i: r.s for r in frame.select("i", Response(F.col("response"), F.lit("vendor/m")).status().alias("s")).collect()}
    for i, (shape, status, reason) in enumerate(SHAPES):
        assert (got[i].status, got[i].reason) == (status, reason), shape
    assert got[len(SHAPES)].status == "empty_response"


def test_anthropic_empty_stop_is_suppressed(spark):
    frame = spark.createDataFrame([(json.dumps(chat("stop", "")),)], "r string")
    row = frame.select(Response(F.col("r"), F.lit("anthropic/m")).status().alias("a"), Response(F.col("r"), F.lit("other/m")).status().alias("b")).first()
    assert (row.a.status, row.b.status) == ("moderation", "missing_content")


def one(spark, expr, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return frame.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [
    ("Compliance: COMPLETE\nFinal label: [denial]", "DENIAL"), ("<think>LABEL: COMPLETE</think> verdict: evasive", "EVASIVE"), ("<think> LABEL: COMPLETE", "UNPARSED"),
    ("so\n **Evasive**.\n", "EVASIVE"), ("nothing", "UNPARSED"), ("label: COMPLETED", "UNPARSED"), ("", "UNPARSED"),
])
def test_last_label(spark, text, want):
    assert one(spark, L.last_label(F.col("t")), t=text) == want


def test_judge_fields_and_first_label(spark):
    r = one(spark, L.judge_fields(F.col("t")), t="ANALYSIS: it\nrefused \nCOMPLIANCE: [denial]")
    assert (r.analysis, r.label) == ("it\nrefused", "DENIAL")
    r = one(spark, L.judge_fields(F.col("t")), t="none")
    assert (r.analysis, r.label) == ("<missing>", "ERROR_JUDGE_FORMAT")
    assert one(spark, L.first_label(F.col("t")), t="LABEL: evasive then LABEL: complete") == "EVASIVE"
    assert one(spark, L.prefix_to_label(F.col("t")), t="a LABEL: DENIAL b LABEL: 'COMPLETE'") is None
    thought = "<|channel>thought COMPLIANCE: COMPLETE<channel|>"
    cases = {f"a COMPLIANCE: DENIAL b {thought} compliance:  [evasive] c": f"a COMPLIANCE: DENIAL b {thought} compliance:  [", f"{thought} x": None, "Verdict: COMPLETE": None, f"COMPLIANCE: EVASIVE {thought}": "COMPLIANCE: "}
    for text, want in cases.items():
        assert one(spark, L.prefix_to_label(F.col("t")), t=text) == want


@pytest.mark.parametrize(("q", "want"), [("a1", "type1"), ("a12", "other"), ("2", "type2"), ("x5", "other"), ("é4", "type4")])
def test_question_type(spark, q, want):
    assert one(spark, L.question_type(F.col("q")), q=q) == want


def test_rules_over_labels(spark):
    f = lambda e, **v: one(spark, e, **v)
    p, l_, j = F.col("p"), F.col("l"), F.col("j")
    for values, want in ((("COMPLETE", "COMPLETE", "COMPLETE"), "all_agree"), (("COMPLETE", "DENIAL", "COMPLETE"), "judge_confirms_pool"), (("COMPLETE", "DENIAL", "DENIAL"), "judge_confirms_local"), (("COMPLETE", "DENIAL", "EVASIVE"), "judge_third_label"), (("COMPLETE", "DENIAL", "X"), "unparseable")):
        assert f(L.adjudication_status(p, l_, j), p=values[0], l=values[1], j=values[2]) == want
    assert f(L.complete_side(p, l_), p="complete", l="DENIAL") == "true_complete_recovery"
    assert f(L.complete_side(p, l_), p="DENIAL", l="COMPLETE") == "false_complete_suppression"
    assert f(L.preference_weight(p, l_), p="DENIAL", l="COMPLETE") == 2.0
    assert f(L.to_binary(p), p=" denied ") == "REFUSE" and f(L.to_binary(p), p="ERROR_X") is None
    assert f(L.shaped_reward(p, l_), p="EVASIVE", l="DENIAL") == -1.0


def test_text_functions(spark):
    t = F.col("t")
    f = lambda e, text="": one(spark, e, t=text)
    assert f(X.excerpt(t, 8), "a  b\n cdefgh") == "a b c..."
    assert f(X.text_hash(t), " a\n b ") == hashlib.sha256(b"a b").hexdigest()
    assert f(X.hmac_sha256("secret", t), "é") == hmac.new(b"secret", "é".encode(), "sha256").hexdigest()
    assert f(X.uuid5(str(uuid.NAMESPACE_URL), t), "key") == str(uuid.uuid5(uuid.NAMESPACE_URL, "key"))
    assert f(X.tag_body(t, "new_label"), "x <NEW_label> a\nb </new_label>") == "a\nb" and f(X.tag_body(t, "q"), "x") is None
    assert f(X.single_character(t), "aaaa") and not f(X.single_character(t), "ab") and not f(X.single_character(t), "")
    assert f(X.cjk_spans(t), "a中文b漢") == ["中文", "漢"]
    assert [tuple(h) for h in f(X.cjk_hits(t), "aa 中文 bb 漢字、cc")] == [(3, 5, "中文", "aa 中文 bb 漢字、cc"), (9, 12, "漢字、", "aa 中文 bb 漢字、cc")]
    assert [h.snippet for h in f(X.cjk_hits(t, 2), "abcd中efgh")] == ["…cd中ef…"] and f(X.cjk_hits(t), "none") == []
    assert f(X.rendered("Q: {t}!", t=t), "x") == "Q: x!"
    assert f(X.truncate_model(t, 20), "vendor/a-very-long-model-name") == "vendor/a-very-lon..."
    assert f(X.subproviders(t), "A, b,a,") == ["a", "b"]
    assert f(X.error_family("top_error", F.lit(500), F.lit(None), F.lit("x"), t), " a  b ") == "top_error;status_code=500;type=x;message=a b"
    assert f(X.alias_keys(F.lit("m"), F.lit("q"), F.lit(None), t), "id") == ["id", "m::q", "us_hard::m::q", "gold::m::q"]
    pairs = f(X.pair_ids(F.array(F.lit("q")), F.array(F.lit("m"), F.lit(None)), F.array(t, F.lit("bad"))), "gold::m2::q2")
    assert [(p.question_id, p.model) for p in pairs] == [("q", "m"), ("q2", "m2")]
    assert f(X.stale(t, F.lit("2024-01-01T00:00:00Z")), "2024-01-01T01:00:00+00:00") and not f(X.stale(t, F.lit("")), "2024")
    assert f(X.missing_category(t), " Undefined ") and not f(X.missing_category(t), "x")
    assert 0 < f(X.hash_uniform("s", t), "k") < 1


def test_diversity(spark):
    w = "a b c a b".split()
    frame = spark.createDataFrame([(w,)], "w array<string>")
    r = frame.select(X.root_ttr(F.size("w"), F.lit(3)).alias("a"), X.maas(F.size("w"), F.lit(3)).alias("b"), X.entropy_bits(F.array(*[F.lit(float(n)) for n in Counter(w).values()])).alias("c")).first()
    assert math.isclose(r.a, 3 / math.sqrt(5)) and math.isclose(r.b, (math.log(5) - math.log(3)) / math.log(5) ** 2)
    assert math.isclose(r.c, -sum(n / 5 * math.log2(n / 5) for n in (2, 2, 1)))


def test_reasoning_summary(spark):
    from verdictlake.functions.status import reasoning_summary

    shapes = [
        {"provider": "p", "choices": [{"finish_reason": "stop", "message": {"content": "abc", "reasoning": "hm", "reasoning_details": [{"a": 1}, {"b": 2}]}}], "usage": {"completion_tokens_details": {"reasoning_tokens": 7}}},
        {"stop_reason": "end_turn", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "redacted_thinking", "data": "x"}, {"type": "text", "text": "abcd"}]},
        {"choices": [{"finish_reason": "stop", "message": {"content": ""}}]},
    ]
    frame = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(shapes)], "i int, r string")
    a, b, c = [x.s for x in frame.orderBy("i").select(reasoning_summary(Response(F.col("r"), F.lit("m"))).alias("s")).collect()]
    assert (a.content_chars, a.reasoning_detail_count, a.reasoning_tokens, a.has_reasoning_text, a.reasoning_present) == (3, 2, 7, True, True)
    assert (b.finish_reason, b.content_chars, b.reasoning_detail_count, b.has_reasoning_text, b.has_reasoning_details) == ("end_turn", 4, 2, True, True)
    assert (c.has_content, c.reasoning_present, c.reasoning_detail_count) == (False, False, 0)
