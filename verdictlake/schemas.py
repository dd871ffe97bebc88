"""Schemas of the evaluation relations; unknown fields are dropped by reading with them."""

from __future__ import annotations

QUESTION = "id string, question string, category string, domain string, _source_label string, _generated_at string, _variation_of string"
#: The response stays a JSON string: its content is polymorphic and is read by path.
RESPONSE = "question_id string, question string, model string, timestamp string, response string, api_provider string, api_model string, raw_response string, request_format string, raw_response_format string, category string, domain string, model_requested string, response_status string, response_status_reason string"
ANALYSIS = "question_id string, question string, model string, response string, judge_model string, compliance string, judge_analysis string, timestamp string, original_api_provider string, raw_judge_response string, category string, domain string, api_model string, judge_api_provider string, failed_primary_judge string"
MANIFEST = "key string, expected_compliance string, bucket string, bucket_subtype string, question_id string, model string, gold_v2_provenance string, gold_v2_confidence_tier string, stratum string, contact array<string>"
ROLLOUT = "id string, example_index long, rollout_index long, expected string, observed string, raw_judge_response string, raw_reasoning_response string, generated_tokens long, is_truncated boolean, metadata struct<question_id:string,question_type:string,response_model:string,domain:string>"
SCORES = "id string, expected string, observed string, scores struct<COMPLETE:double,DENIAL:double,EVASIVE:double>, metadata struct<question_id:string,domain:string>"
PAIR = "pair_id string, id string, prompt string, chosen string, rejected string, expected_label string, rejected_label string, boundary string, question_type string, weight double, preference struct<rollouts:long,correct_votes:long,rollout_observed_counts:map<string,long>>"
DECISION = "key string, model string, question_id string, decision string, gold_label string, new_label string, note string, reviewed_at string, resolution_kind string"
SURVEY = "name string, title string, initial_prompt string, scale struct<min:long,max:long,labels:map<string,string>>, items array<struct<id:string,text:string,category:string,inversion:boolean>>"
CATALOG = "canonical_name string, providers array<struct<provider_name:string,provider_model_id:string,priority:int>>, release_date string, description string, parameters long, context_window long, metadata map<string,string>, request_overrides map<string,string>"
OFFER = "id string, gpu_type string, gpu_count int, gpu_memory double, provider string, socket string, stock_status string, is_spot boolean, price_value double"
PROFILE = "profile_id string, gpu_type_regex string, minimum_gpu_memory_gb double, socket string, source_provider string, rows_per_second double, startup_seconds map<string,double>, provider_startup_seconds map<string,map<string,double>>, confidence string, measured_at string"

#: Fields that a row must have to be read at all.
REQUIRED = {"question": ("id", "question"), "response": ("question_id", "question", "model", "timestamp", "response"), "analysis": ("question_id", "model", "judge_model", "compliance")}
