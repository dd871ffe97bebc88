"""More queries of the evaluation operators: sources, response and training rows, joins, reports, sampling and scores.

As in the catalogue, the driver's tables stand in for judge data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..functions.status import Response, finish_status, reasoning_summary, retry_candidate
from ..operators import metrics, rank, recon, report, rows, sampling, scores, votes
from ..sources import jsonl
from ..sources.scratch import scratch_path, written
from ..streaming.follow import work_list
from .catalog import JOINED, JUDGES, MD5, gold, joined, judged
from .registry import query, table


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select(*columns)


def _three(spark: SparkSession, d: str) -> DataFrame:
    """A row for each labelled document and judge: doc_id, expected, judge, label."""
    j = joined(spark, d)
    return j.select("doc_id", "expected", F.expr("stack(3, 'a', a, 'b', b, 'c', c) AS (judge, label)"))


THREE = JOINED + ", three AS (SELECT doc_id, expected, 'a' AS judge, a AS label FROM joined UNION ALL SELECT doc_id, expected, 'b', b FROM joined UNION ALL SELECT doc_id, expected, 'c', c FROM joined)"

# the one workload with a measured rate: pool scan with reasons, exclusions, contact, staged sample
POOL = f"""WITH {JUDGES}, pool AS (SELECT doc_id, lang, source, n_chars, c AS label, doc_id // 3 AS question_id, text FROM judged JOIN (SELECT doc_id, text FROM documents) USING (doc_id)),
scanned AS (SELECT *, CASE WHEN n_chars = 0 THEN 'empty_response' WHEN label IS NULL THEN 'missing_label' WHEN starts_with(label, 'ERROR') THEN 'error_label' WHEN length(trim(text)) < 20 THEN 'short_response' END AS reason FROM pool)"""


def _pool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pool = judged(spark, d).withColumnRenamed("c", "label").withColumn("question_id", F.expr("doc_id div 3")).drop("a", "b").join(_docs(spark, d, "doc_id", "text"), "doc_id")
    rules = [("empty_response", F.col("n_chars") == 0), ("missing_label", F.col("label").isNull()), ("error_label", F.col("label").startswith("ERROR")), ("short_response", F.length(F.trim("text")) < 20)]
    return jsonl.scan_with_reasons(pool, rules)


@query(f"{POOL} SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n FROM scanned GROUP BY 1")
def pool_scan(spark: SparkSession, d: str) -> DataFrame:
    """S7, F6."""
    eligible, counts = _pool(spark, d)
    return counts.unionByName(eligible.agg(recon.one()).filter("n > 0").select(F.lit("eligible").alias("reason"), "n"))


def _es(salt: str) -> str:
    u = f"((CAST(CAST('0x' || substr(md5('{salt}|' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"
    return f"-ln(greatest({u}, 1e-12)) / greatest(w, 1e-9)"


@query(f"""{POOL}, e AS (SELECT *, sha256(text) AS h FROM scanned WHERE reason IS NULL), g AS (SELECT question_id, h FROM e WHERE doc_id % 41 = 0),
kept AS (SELECT *, (1 + n_chars % 7)::DOUBLE AS w FROM e WHERE question_id NOT IN (SELECT question_id FROM g) AND h NOT IN (SELECT h FROM g)),
tags AS (SELECT doc_id, CASE WHEN question_id IN (SELECT question_id FROM e WHERE doc_id % 29 = 0) THEN 'touched' ELSE '' END AS contact FROM kept),
s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE label WHEN 'COMPLETE' THEN {_es('complete|random')} WHEN 'DENIAL' THEN {_es('denial|random')} ELSE {_es('evasive|random')} END, doc_id) AS r, count(*) OVER (PARTITION BY label) AS frame FROM kept)
SELECT doc_id, lower(label) AS stratum, contact, round(frame / least(frame, 40), 9) AS sampling_weight FROM s JOIN tags USING (doc_id) WHERE r <= 40""")
def gold_build(spark: SparkSession, d: str) -> DataFrame:
    """From the pool to a staged sample with design weights."""
    eligible, _ = _pool(spark, d)
    pool = eligible.select(F.col("doc_id").alias("key"), "question_id", "source", "label", (1.0 + F.col("n_chars") % 7).alias("w"), F.sha2("text", 256).alias("response_hash"))
    gold_pairs = pool.filter("key % 41 = 0").select("question_id", "response_hash")
    artifacts = pool.filter("key % 29 = 0").select("question_id", F.lit(None).cast("string").alias("response_hash"), F.lit("touched").alias("tag"))
    kept = recon.apply_exclusions(pool, gold_pairs, artifacts).filter("excluded_by IS NULL")
    frame = written(kept.withColumnRenamed("key", "doc_id").drop("response_hash", "excluded_by"), "frame")  # every stage reads it
    sizes = {r["label"]: r["n"] for r in frame.groupBy("label").agg(recon.one()).collect()}  # a row for each label
    stages = [sampling.Stage(x.lower(), "random", F.col("label") == x, F.col("w"), min(40, sizes[x]), sizes[x]) for x in L.LABELS if x in sizes]
    sample = sampling.staged_sample(frame, stages, key="doc_id", question="question_id", model="source", model_fraction=1.0)
    return sample.select("doc_id", "stratum", F.array_join("contact", ",").alias("contact"), F.round("sampling_weight", 9).alias("sampling_weight"))


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'reports/' WHEN 1 THEN 'gold/' WHEN 2 THEN 'cache/' ELSE 'runs/' END || source || '/' || lang || '.jsonl' AS path FROM documents)
SELECT path, count(*) AS files, CASE WHEN starts_with(path, 'cache/') THEN 'skip' WHEN starts_with(path, 'gold/') THEN 'exclude' WHEN path LIKE '%/de.jsonl' THEN 'contact' ELSE 'include' END AS decision,
CASE WHEN starts_with(path, 'cache/') THEN 'cache' WHEN starts_with(path, 'gold/') THEN 'gold' WHEN path LIKE '%/de.jsonl' THEN 'german' END AS tag FROM f GROUP BY path""")
def artifact_policies(spark: SparkSession, d: str) -> DataFrame:
    """S12."""
    top = F.element_at(F.array(*[F.lit(x) for x in ("reports/", "gold/", "cache/", "runs/")]), (F.col("doc_id") % 4 + 1).cast("int"))
    files = _docs(spark, d, F.concat(top, "source", F.lit("/"), "lang", F.lit(".jsonl")).alias("path")).groupBy("path").agg(recon.one("files"))
    rules = spark.createDataFrame([(0, "^cache/", "skip", "cache"), (1, "^gold/", "exclude", "gold"), (2, "/de\\.jsonl$", "contact", "german"), (3, "^gold/.*", "skip", "late")], "ordinal int, pattern string, decision string, tag string")
    return jsonl.artifact_policy(files, rules)


@query(f"WITH {JUDGES} SELECT doc_id AS question_id, lang AS model, a AS compliance, (doc_id % 10 = 0) AS fetched FROM judged WHERE lang IS NOT NULL")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Analyses written as JSON lines, with lines that must be left out, read again with their places."""
    path, broken = scratch_path(spark, "lines"), scratch_path(spark, "broken")
    out = judged(spark, d).select(F.col("doc_id").alias("question_id"), F.col("lang").alias("model"), F.col("a").alias("compliance"), F.lit(1).alias("unknown"))
    jsonl.write_jsonl(out, path)
    spark.createDataFrame([("{bad",), ("",), ('{"question_id": 1, "compliance": "X"}',)], "value string").coalesce(1).write.text(broken)
    schema = "question_id long, model string, compliance string"
    read = jsonl.read_jsonl(spark, [path, broken, path + "-missing"], schema, ["question_id", "model"], with_position=True)
    wanted = read.filter("question_id % 10 = 0")
    lost = jsonl.round_trip(out.drop("unknown").filter("model IS NOT NULL"), read.select("question_id", "model", "compliance")).filter("lost = 0 AND gained = 0")
    fetched = jsonl.fetch(read, wanted).select("question_id", F.lit(True).alias("fetched"))
    both = read.join(fetched, "question_id", "left").crossJoin(F.broadcast(lost.select("unknown_fields")))  # no row if anything was lost
    return both.select("question_id", "model", "compliance", F.coalesce("fetched", F.lit(False)).alias("fetched"))


@query("SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'cut' ELSE 'open string' END AS fault FROM documents WHERE doc_id % 17 = 0 OR doc_id % 17 = 1")
def malformed_report(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as JSON lines among blank ones; two in seventeen are broken, and found by file and line."""
    path = scratch_path(spark, "malformed")
    line = F.to_json(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    broken = F.when(F.col("doc_id") % 17 == 0, F.left(line, F.length(line) - 1)).when(F.col("doc_id") % 17 == 1, F.concat(F.left(line, F.length(line) - 2), F.lit("}"))).otherwise(line)
    _docs(spark, d, "doc_id", "text").select(F.explode(F.array(F.lit(""), broken, F.lit("  "))).alias("value")).write.text(path)
    lines = jsonl.read_lines(spark, [path])
    found = lines.join(jsonl.malformed_lines(spark, path), ["_file", "_line"])
    return found.select(F.regexp_extract("value", r"^\{\"doc_id\":(\d+)", 1).cast("long").alias("doc_id"), F.when(F.col("value").endswith('"'), "cut").otherwise("open string").alias("fault"))


@query("""SELECT source, lang, CASE WHEN starts_with(source || '_' || lang, source || '_e') THEN source || '_e' ELSE source END AS stem FROM (SELECT DISTINCT source, lang FROM documents) WHERE lang <> 'de' AND source IS NOT NULL""")
def question_sets(spark: SparkSession, d: str) -> DataFrame:
    """Response files, quarantine sidecars left out, with the longest question set their names start with."""
    each = _docs(spark, d, "source", "lang").distinct().filter("source IS NOT NULL AND lang IS NOT NULL")
    files = each.withColumn("name", F.concat("source", F.lit("_"), "lang", F.when(F.col("lang") == "de", ".Quarantine").otherwise(""), F.lit(".jsonl"))).withColumn("file", F.col("name"))
    sets = each.select(F.col("source").alias("stem")).distinct()
    sets = sets.unionByName(sets.select(F.concat("stem", F.lit("_e")).alias("stem")))
    return jsonl.infer_question_set(jsonl.response_files(files), sets).select("source", "lang", "stem")


@query(f"""WITH {JUDGES}, f AS (SELECT source || '.quarantine.jsonl' AS file, b FROM judged WHERE lang = 'de' UNION ALL SELECT source || '.jsonl', b FROM judged WHERE lang <> 'de') SELECT file, b AS status, count(*) AS n FROM f WHERE contains(file, 'quarantine') GROUP BY 1, 2""")
def quarantine_report(spark: SparkSession, d: str) -> DataFrame:
    """S11."""
    j = judged(spark, d).filter("lang IS NOT NULL").withColumn("_file", F.concat("source", F.when(F.col("lang") == "de", ".quarantine").otherwise(""), F.lit(".jsonl"))).withColumnRenamed("b", "response_status")
    return jsonl.quarantine_counts(j).select(F.col("_file").alias("file"), F.col("response_status").alias("status"), "n")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) = 4 AND count(*) FILTER (l_returnflag = 'A') = 0")
def good_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files of lines; whole ones without an error."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("_file"), F.when(F.col("l_returnflag") == "A", "ERROR").otherwise("ok").alias("compliance"))
    return jsonl.good_files(li, 4).groupBy(F.col("_file").alias("l_orderkey")).agg(recon.one())


@query("""SELECT p_name AS name, problem FROM (SELECT p_name, p_partkey, unnest([CASE WHEN p_size % 4 >= 2 THEN 'empty range' END, CASE WHEN p_size % 4 >= 2 OR p_partkey % 3 = 0 THEN 'label outside range' END, CASE WHEN p_partkey % 5 = 0 THEN 'repeated item id' END]) AS problem FROM part) WHERE problem IS NOT NULL""")
def survey_checks(spark: SparkSession, d: str) -> DataFrame:
    """Parts as surveys, with faults planted by their keys."""
    p = table(spark, d, "part")
    scale = F.struct((F.col("p_size") % 4).cast("long").alias("min"), F.lit(2).cast("long").alias("max"), F.map_from_arrays(F.array(F.when(F.col("p_partkey") % 3 == 0, "9").otherwise(F.lit("2"))), F.array(F.lit("x"))).alias("labels"))
    scale = F.when(F.col("p_size") % 4 >= 2, F.struct(F.lit(2).cast("long").alias("min"), F.lit(2).cast("long").alias("max"), F.map_from_arrays(F.array(F.lit("9")), F.array(F.lit("x"))).alias("labels"))).otherwise(scale)
    items = F.array(*[F.struct(x.alias("id")) for x in (F.lit("i"), F.when(F.col("p_partkey") % 5 == 0, "i").otherwise(F.lit("j")))])
    return jsonl.survey_problems(p.select(F.col("p_name").alias("name"), scale.alias("scale"), items.alias("items")))


@query("""WITH c AS (SELECT p_brand AS canonical_name, p_type AS provider_name, max(p_size) AS priority FROM part GROUP BY 1, 2)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY canonical_name ORDER BY priority DESC, provider_name DESC) = 1""")
def model_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Brands as models, types as providers."""
    p = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.max("p_size").alias("priority"))
    catalog = p.groupBy(F.col("p_brand").alias("canonical_name")).agg(F.collect_list(F.struct(F.col("p_type").alias("provider_name"), "priority")).alias("providers"))
    return jsonl.resolve_model(catalog, F.col("canonical_name")).select("canonical_name", "provider_name", "priority")


@query("SELECT conv_id, turn, md5(conv_id || ':' || turn || ':' || role) AS cache_key FROM conversations WHERE turn % 2 = 1")
def uncached_work(spark: SparkSession, d: str) -> DataFrame:
    """Turns that no earlier run has left in its cache."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    keys = ["conv_id", "turn", "role"]
    cache = c.filter("turn % 2 = 0").select(F.md5(F.concat_ws(":", *keys)).alias("cache_key"))
    return jsonl.uncached(c, cache, keys).select("conv_id", "turn", "cache_key")


@query("""SELECT doc_id FROM documents LEFT JOIN (SELECT doc_id, 100000000 - doc_id AS former FROM documents WHERE doc_id % 3 = 0) USING (doc_id) ORDER BY former NULLS LAST, doc_id LIMIT 100""")
def former_order(spark: SparkSession, d: str) -> DataFrame:
    """The first rows in the order of an earlier file."""
    docs = _docs(spark, d, "doc_id").withColumn("n", F.col("doc_id"))
    former = docs.filter("doc_id % 3 = 0").withColumn("n", 100000000 - F.col("doc_id"))
    return jsonl.in_former_order(docs, former, "doc_id", "n").select("doc_id").limit(100)


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'restored' ELSE 'current' END AS origin FROM documents")
def restored_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows lost by an in-place edit come back from the original."""
    docs = _docs(spark, d, "doc_id")
    now = docs.filter("doc_id % 4 <> 0").withColumn("origin", F.lit("current"))
    lost = recon.extras(now, docs, "doc_id").withColumn("origin", F.lit("restored"))
    return jsonl.restored(now, lost, "doc_id")


@query("SELECT event_type AS name, round(sum(value), 6) AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def metric_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples in the text format of a metrics endpoint."""
    e = table(spark, d, "events")
    lines = e.select(F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "_total").otherwise(""), F.lit('{user="'), "user_id", F.lit('"} '), F.col("value").cast("string"), F.when(F.col("event_id") % 3 == 0, " 1700000000").otherwise("")).alias("value"))
    lines = lines.unionByName(spark.createDataFrame([("# HELP click all",)], "value string"))
    return jsonl.metric_total(lines, ["click_total", "view"]).select("name", F.round("total", 6).alias("total"))


@query("""WITH s AS (SELECT l_orderkey AS run, CASE l_linenumber WHEN 1 THEN 'gate' WHEN 2 THEN 'continuation' ELSE 'resumed' END AS segment, l_quantity AS rows, l_extendedprice AS seconds, l_suppkey AS gpu FROM lineitem),
t AS (SELECT run, round(sum(rows) FILTER (segment <> 'resumed'), 6) AS rows, round(sum(seconds) FILTER (segment <> 'resumed'), 6) AS seconds FROM s GROUP BY run HAVING count(*) FILTER (segment <> 'resumed') > 0)
SELECT run, rows, seconds, round(seconds * o_totalprice / 3600, 4) AS cost FROM t JOIN orders ON o_orderkey = run""")
def run_timing(spark: SparkSession, d: str) -> DataFrame:
    """Lines as segments of runs, orders as their registry."""
    segment = F.when(F.col("l_linenumber") == 1, "gate").when(F.col("l_linenumber") == 2, "continuation").otherwise("resumed")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), segment.alias("segment"), F.col("l_quantity").alias("rows"), F.col("l_extendedprice").alias("seconds"))
    runs = scores.effective_timing(jsonl.timing_segments(li))
    registry = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("rate"))
    out = recon.join_or_raise(runs, registry, "run")
    return out.select("run", F.round("rows", 6).alias("rows"), F.round("seconds", 6).alias("seconds"), F.round("cost", 4).alias("cost"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'provider_error' WHEN 'click' THEN 'success' WHEN 'view' THEN 'truncation' WHEN 'signup' THEN 'moderation' ELSE 'unknown_metadata' END AS status,
event_type IN ('error') AS retry, 'finish=' || CASE WHEN user_id % 2 = 0 THEN '''' || event_type || '''' ELSE 'None' END || ';native=''' || user_id || '''' AS pair FROM events""")
def finish_statuses(spark: SparkSession, d: str) -> DataFrame:
    """P9, P11, P25."""
    reason = F.element_at(F.create_map(*[F.lit(x) for x in ("error", "engine_overloaded", "click", "stop", "view", "max_tokens", "signup", "refusal", "purchase", "strange")]), F.col("event_type"))
    status = finish_status(reason)
    pair = X.finish_pair(F.when(F.col("user_id") % 2 == 0, F.col("event_type")), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", status.alias("status"), retry_candidate(status).alias("retry"), pair.alias("pair"))


# whole texts, one in 31 empty, inside every shape of response
PLANTED = "(SELECT * REPLACE (CASE WHEN doc_id % 31 = 0 THEN '' ELSE text END AS text) FROM documents)"


def _responses(spark: SparkSession, d: str) -> DataFrame:
    kind, text = F.col("doc_id") % 12, F.col("text")
    chat = lambda finish, content, **more: F.to_json(F.struct(F.array(F.struct(F.lit(finish).alias("finish_reason"), F.struct(content.alias("content")).alias("message"))).alias("choices"), *[v.alias(k) for k, v in more.items()]))
    error = lambda **fields: F.to_json(F.struct(F.struct(*[v.alias(k) for k, v in fields.items()]).alias("error")))
    blocks = F.array(F.struct(F.lit("thinking").alias("type"), F.lit("").alias("text")), F.struct(F.lit("text").alias("type"), text.alias("text")))
    shapes = [
        chat("stop", text), chat("length", text), chat("content_filter", text), error(code=F.lit(500), message=F.lit("overloaded")), error(code=F.lit(403), message=F.lit("Your input was flagged")),
        error(code=F.lit(500), moderation=F.lit(False), policy_violation=F.lit(1)), error(type=F.lit("server")), F.to_json(F.struct(F.lit("end_turn").alias("stop_reason"), blocks.alias("content"))),
        F.to_json(F.struct(F.struct(F.struct(F.lit("stop").alias("finish_reason"), text.alias("content")).alias("standardized_response")).alias("_llm_client"))), chat("strange", text),
        F.to_json(F.struct(F.struct(F.struct(F.lit(429).alias("status_code")).alias("error_info")).alias("_llm_client"))), F.lit("{}"),
    ]
    out = F.lit(None).cast("string")
    for i, s in enumerate(shapes):
        out = F.when(kind == i, s).otherwise(out)
    docs = table(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 31 == 0, "").otherwise(F.col("text")))
    return docs.select("doc_id", "lang", "source", "text", out.alias("response"))


STATUS = """CASE WHEN doc_id % 12 IN (0, 7, 8) THEN CASE WHEN text = '' THEN 'missing_content' ELSE 'success' END WHEN doc_id % 12 = 1 THEN 'truncation' WHEN doc_id % 12 IN (2, 4) THEN 'moderation' WHEN doc_id % 12 IN (3, 5, 6, 10) THEN 'provider_error' WHEN doc_id % 12 = 9 THEN 'unknown_metadata' ELSE 'empty_response' END"""


@query(f"""SELECT doc_id, {STATUS} AS status, CASE WHEN text = '' AND doc_id % 12 IN (0, 7, 8) THEN 'missing_final_content' ELSE CASE doc_id % 12 WHEN 0 THEN 'finish_reason:stop' WHEN 1 THEN 'finish_reason:length' WHEN 2 THEN 'content_filter' WHEN 3 THEN 'top_error_code:500' WHEN 4 THEN 'moderation_error_text' WHEN 5 THEN 'top_error_code:500' WHEN 6 THEN 'top_error:server'
 WHEN 7 THEN 'stop_reason:end_turn' WHEN 8 THEN '_llm_client.standardized_response.finish_reason:stop' WHEN 9 THEN 'unknown_finish_reason:strange' WHEN 10 THEN 'llm_client_error_status:429' ELSE 'empty_response' END END AS reason,
 CASE WHEN doc_id % 12 IN (0, 1, 2, 7, 8, 9) THEN length(text) ELSE 0 END AS chars, CASE WHEN doc_id % 12 IN (3, 4, 5, 6) THEN 'error' ELSE 'text' END AS kind, CASE WHEN doc_id % 12 IN (0, 1, 2, 7, 8, 9) AND text <> '' THEN sha256(text) END AS digest FROM {PLANTED}""")
def response_texts(spark: SparkSession, d: str) -> DataFrame:
    """Status, reason and content of whole texts in every shape of response."""
    r = Response(F.col("response"), F.lit("vendor/m"))
    sig = X.content_signature(r.has_error(), r.text())
    each = _responses(spark, d).select("doc_id", r.status().alias("s"), r.text().alias("t"), sig.alias("g"))
    return each.select("doc_id", F.col("s.status").alias("status"), F.col("s.reason").alias("reason"), F.length("t").cast("long").alias("chars"), F.col("g.kind").alias("kind"), F.col("g.digest").alias("digest"))


@query(f"""WITH r AS (SELECT doc_id, doc_id // 2 AS q, {STATUS} AS status FROM {PLANTED}), o AS (SELECT *, CASE WHEN status = 'empty_response' THEN 'empty_response' WHEN status IN ('provider_error', 'missing_content') THEN 'retryable_error' WHEN status = 'truncation' THEN 'truncation' END AS own FROM r),
b AS (SELECT *, coalesce(bool_or(own IS NULL) OVER (PARTITION BY q ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS again FROM o)
SELECT coalesce(CASE WHEN own = 'empty_response' THEN own WHEN again THEN 'duplicate_question_id' ELSE own END, 'kept') AS removed, count(*) AS n FROM b GROUP BY 1""")
def cleanup_report(spark: SparkSession, d: str) -> DataFrame:
    """F1."""
    r = _responses(spark, d).select("doc_id", F.expr("doc_id div 2").alias("question_id"), F.lit("vendor/m").alias("model"), "response")
    return rows.clean_for_retry(r, "doc_id", truncations=True).groupBy(F.coalesce("removed", F.lit("kept")).alias("removed")).agg(recon.one())


@query(f"""SELECT doc_id, doc_id % 12 IN (0, 1, 2, 9, 7) AND text <> '' AS has_content, CASE doc_id % 12 WHEN 7 THEN 'end_turn' WHEN 0 THEN 'stop' WHEN 1 THEN 'length' WHEN 2 THEN 'content_filter' WHEN 9 THEN 'strange' END AS finish_reason, CASE WHEN doc_id % 12 = 7 THEN 1 ELSE 0 END AS details FROM {PLANTED}""")
def reasoning_payloads(spark: SparkSession, d: str) -> DataFrame:
    """P12."""
    each = _responses(spark, d).select("doc_id", reasoning_summary(Response(F.col("response"), F.lit("m"))).alias("s"))
    return each.select("doc_id", "s.has_content", "s.finish_reason", F.col("s.reasoning_detail_count").alias("details"))


_NAMED = r"(?i)\b(?:COMPLIANCE|FINAL\s+LABEL|LABEL|VERDICT)\s*:\s*[\[\(\"''`*]*\s*(COMPLETE|DENIAL|EVASIVE)\b"
_ALONE = r"(?im)^\s*[\[\(\"''`*#>-]*\s*(COMPLETE|DENIAL|EVASIVE)\s*[\]\)\"''`*.,!;:]*\s*$"
_ENDS = ["\nLABEL: denial\nso it is. Final label: EVASIVE", "\nI say >>COMPLETE<<", " nothing", "\n<think>LABEL: COMPLETE", "\n<|channel>thought COMPLIANCE: COMPLETE<channel|> COMPLIANCE: [evasive]", " none"]


@query(rf"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, CASE doc_id % 4 WHEN 1 THEN replace(text, '. ', '. Verdict: *denial* ') WHEN 2 THEN replace(text, '. ', '.' || chr(10) || '> Complete.' || chr(10)) WHEN 3 THEN replace(text, '. ', '</think> label: (evasive) ') ELSE text END AS text FROM documents),
t AS (SELECT doc_id, k, CASE k WHEN 3 THEN '<think>LABEL: COMPLETE ' || text ELSE text || {str([e.replace(chr(10), "~") for e in _ENDS])}[k + 1] END AS t FROM d), u AS (SELECT doc_id, k, replace(t, '~', chr(10)) AS t, contains(lower(t), '</think>') AS closed FROM t),
r AS (SELECT *, CASE WHEN closed THEN list_last(string_split(t, '</think>')) ELSE t END AS rest FROM u),
l AS (SELECT *, CASE WHEN NOT closed AND regexp_matches(t, '^\s*<think\b') THEN 'UNPARSED' ELSE coalesce(upper(list_last(regexp_extract_all(rest, '{_NAMED}', 1))), upper(list_last(regexp_extract_all(rest, '{_ALONE}', 1))), 'UNPARSED') END AS content, upper(list_last(regexp_extract_all(t, '>>(COMPLETE|DENIAL|EVASIVE)<<', 1))) AS plain FROM r)
SELECT doc_id, CASE WHEN content <> 'UNPARSED' THEN content WHEN plain IS NOT NULL THEN plain WHEN k = 2 THEN 'DENIAL' ELSE 'UNPARSED' END AS observed, CASE WHEN content <> 'UNPARSED' THEN 'content' WHEN plain IS NOT NULL THEN 'plain_label' WHEN k = 2 THEN 'reasoning_decision' ELSE 'unparsed' END AS origin,
coalesce(nullif(upper(regexp_extract(t, '{_NAMED}', 1)), ''), 'UNPARSED') AS first, CASE k WHEN 4 THEN length(t) - length('evasive]') END AS prefix_chars FROM l""")
def observed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels in judge texts that hold whole documents, with labels and ends of thought strewn in."""
    i, text = F.col("doc_id"), F.col("text")
    sown = F.when(i % 4 == 1, F.replace(text, F.lit(". "), F.lit(". Verdict: *denial* "))).when(i % 4 == 2, F.replace(text, F.lit(". "), F.lit(".\n> Complete.\n"))).when(i % 4 == 3, F.replace(text, F.lit(". "), F.lit("</think> label: (evasive) "))).otherwise(text)
    k = (i % 6).cast("int")
    docs = table(spark, d, "documents").select("doc_id", k.alias("k"), sown.alias("text"))
    answer = F.when(F.col("k") == 3, F.concat(F.lit("<think>LABEL: COMPLETE "), "text")).otherwise(F.concat("text", F.element_at(F.array(*[F.lit(e) for e in _ENDS]), F.col("k") + 1)))
    reasoning = F.when(F.col("k") == 2, "I decide DENIAL").otherwise(F.lit(""))
    seen = L.observed_label(F.col("t"), F.col("r"), r"(?i)>>(COMPLETE|DENIAL|EVASIVE)<<", r"(?i)decide (COMPLETE|DENIAL|EVASIVE)")
    each = docs.select("doc_id", answer.alias("t"), reasoning.alias("r")).select("doc_id", seen.alias("s"), L.first_label(F.col("t")).alias("first"), F.length(L.prefix_to_label(F.col("t"))).cast("long").alias("prefix_chars"))
    return each.select("doc_id", F.col("s.label").alias("observed"), F.col("s.source").alias("origin"), "first", "prefix_chars")


@query(f"""{JOINED} SELECT doc_id, 'type' || CASE WHEN doc_id % 10 BETWEEN 1 AND 4 AND doc_id < 10 THEN CAST(doc_id AS VARCHAR) ELSE '?' END AS qtype, CASE WHEN a = 'COMPLETE' THEN 'COMPLY' ELSE 'REFUSE' END AS binary_label,
 CASE WHEN c IS NULL OR c NOT IN ('COMPLETE', 'DENIAL', 'EVASIVE') THEN 'unparseable' WHEN c = expected AND c = a THEN 'all_agree' WHEN c = expected THEN 'judge_confirms_pool' WHEN c = a THEN 'judge_confirms_local' ELSE 'judge_third_label' END AS adjudication,
 CASE WHEN a = expected THEN 'confirmed_original' WHEN a = b THEN 'flipped_to_rejected' ELSE 'third_label' END AS target,
 CASE WHEN expected = 'COMPLETE' AND a <> 'COMPLETE' THEN 'true_complete_recovery' WHEN expected <> 'COMPLETE' AND a = 'COMPLETE' THEN 'false_complete_suppression' END AS side,
 CASE WHEN a = 'COMPLETE' AND expected <> 'COMPLETE' THEN 2.0 WHEN expected = 'COMPLETE' AND a <> 'COMPLETE' THEN 1.5 ELSE 1.0 END AS weight,
 CASE WHEN c IS NULL OR c NOT IN ('COMPLETE', 'DENIAL', 'EVASIVE') THEN -0.5 WHEN c = expected THEN 1.0 WHEN c = 'EVASIVE' THEN -1.0 ELSE 0.0 END AS reward,
 CASE WHEN doc_id % 2 = 0 THEN 'COMPLIANCE: ' || a ELSE 'rendered' END AS completion FROM joined""")
def label_rules(spark: SparkSession, d: str) -> DataFrame:
    """P18, P27, P43 to P47, X15."""
    e, a, b, c, i = (F.col(x) for x in ("expected", "a", "b", "c", "doc_id"))
    raw = F.concat(F.lit("COMPLIANCE: "), F.when(i % 2 == 0, a).otherwise("INCOMPLETE"))
    return joined(spark, d).select(
        "doc_id", L.question_type_or_unknown(i.cast("string")).alias("qtype"), L.to_binary(a).alias("binary_label"), L.adjudication_status(e, a, c).alias("adjudication"), L.target_status(e, b, a).alias("target"),
        L.complete_side(e, a).alias("side"), L.preference_weight(e, a).alias("weight"), L.shaped_reward(c, e).alias("reward"), L.label_completion(raw, a, F.lit("rendered")).alias("completion"),
    )


@query(rf"""{JOINED}, t AS (SELECT joined.doc_id, lang, source, 'v' || source || '/' || lang || '-model-with-a-rather-long-name-of-its-own' AS model, CASE WHEN joined.doc_id % 9 = 0 THEN repeat(left(text, 1), 4) WHEN joined.doc_id % 9 = 1 THEN chr(10) || text || ' ' || chr(9) ELSE text END AS text FROM joined JOIN (SELECT doc_id, text FROM documents) USING (doc_id)),
c AS (SELECT *, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS compact, list_filter(list_transform(string_split(' ' || upper(source) || ',' || lang || ' ,, ' || CASE WHEN doc_id % 3 = 0 THEN source ELSE 'X' || doc_id % 5 END, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS parts FROM t)
SELECT doc_id, model || '::q' || doc_id AS key, 'q' || doc_id || ',' || model || '::q' || doc_id || ',us_hard::' || model || '::q' || doc_id || ',gold::' || model || '::q' || doc_id AS aliases,
 CASE WHEN length(compact) <= 30 THEN compact ELSE left(compact, 27) || '...' END AS excerpt, length(text) AS chars,
 'top_error;code=' || doc_id || ';type=server' AS family, CAST(CASE WHEN length(text) % 8 = 2 THEN length(text) // 4 WHEN length(text) % 4 >= 2 THEN length(text) // 4 + 1 ELSE length(text) // 4 END AS BIGINT) AS tokens,
 CASE WHEN length(model) <= 45 THEN model ELSE left(model, 42) || '...' END AS shown, array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: list_position(parts, parts[i]) = i), lambda i: parts[i]), ',') AS subs, length(text) > 0 AND replace(text, left(text, 1), '') = '' AS one_character FROM c""")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys and marks of whole texts, some of them one character over and over, some not trimmed."""
    text = F.when(F.col("doc_id") % 9 == 0, F.repeat(F.left("text", F.lit(1)), F.lit(4))).when(F.col("doc_id") % 9 == 1, F.concat(F.lit("\n"), "text", F.lit(" \t"))).otherwise(F.col("text"))
    t = joined(spark, d).join(_docs(spark, d, "doc_id", text.alias("text")), "doc_id")
    t = t.withColumn("model", F.concat(F.lit("v"), "source", F.lit("/"), "lang", F.lit("-model-with-a-rather-long-name-of-its-own"))).withColumn("q", F.concat(F.lit("q"), F.col("doc_id").cast("string")))
    model, q, text = F.col("model"), F.col("q"), F.col("text")
    listed = F.concat(F.lit(" "), F.upper("source"), F.lit(","), "lang", F.lit(" ,, "), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.concat(F.lit("X"), (F.col("doc_id") % 5).cast("string"))))
    return t.select(
        "doc_id", X.composite_key(model, q).alias("key"), F.array_join(X.alias_keys(model, q, F.lit(None).cast("string"), q), ",").alias("aliases"), X.excerpt(text, 30).alias("excerpt"), F.length("text").cast("long").alias("chars"),
        X.error_family("top_error", F.lit(None), F.col("doc_id"), F.lit("server"), F.lit(None).cast("string")).alias("family"), X.prompt_tokens(F.length("text")).alias("tokens"),
        X.truncate_model(model).alias("shown"), F.array_join(X.subproviders(listed), ",").alias("subs"), X.single_character(text).alias("one_character"),
    )


@query(r"""WITH c AS (SELECT conv_id, turn, role, CASE conv_id % 5 WHEN 0 THEN chr(10) || text || ' ' || chr(9) WHEN 1 THEN '<b>' || text || '</b> <a' WHEN 2 THEN CASE WHEN turn = 1 THEN '' ELSE text END ELSE text END AS text FROM conversations)
SELECT conv_id, turn, role || ': ' || text AS rendered, trim(text, e' \t\n\x0b\x0c\r') AS body, CASE WHEN turn % 3 = 0 THEN text ELSE '<think>' || chr(10) || 'r' || turn || chr(10) || '</think>' || chr(10) || text END AS thought, CASE WHEN turn % 2 = 0 THEN 'user' ELSE role END AS first_role, role AS meta_role, 'user,' || role AS ids FROM c""")
def message_rows(spark: SparkSession, d: str) -> DataFrame:
    """Turns as training rows."""
    n, whole = F.col("conv_id") % 5, F.col("text")
    text = F.when(n == 0, F.concat(F.lit("\n"), whole, F.lit(" \t"))).when(n == 1, F.concat(F.lit("<b>"), whole, F.lit("</b> <a"))).when((n == 2) & (F.col("turn") == 1), "").otherwise(whole)
    c = table(spark, d, "conversations").withColumn("text", text)
    c = rows.set_field(c, "source", "chat").withColumn("messages", F.when(F.col("turn") % 2 == 1, F.array(F.struct("role", F.col("text").alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>")))
    made = rows.training_rows(c.withColumn("id", F.col("conv_id")), "system text", "text", "role", "role", ["turn", "source"]).select(F.col("id").alias("conv_id"), F.col("metadata.turn").alias("turn"), F.col("messages")[2]["content"].alias("meta_role")).distinct()
    text, role = F.col("text"), F.col("role")
    pairs = X.pair_ids(F.array(F.lit("q")), F.array(F.lit("user")), F.array(F.concat(F.lit("gold::"), role, F.lit("::q"))))
    named = F.array_join(F.concat(F.array(F.lit("user")), F.array(F.element_at(pairs, -1)["model"])), ",")
    each = c.select(
        "conv_id", "turn", X.rendered("{role}: {text}", role=role, text=text).alias("rendered"), X.tag_body(F.concat(F.lit("x <a>"), text, F.lit("</A>")), "a").alias("body"),
        X.think_text(F.when(F.col("turn") % 3 == 0, " \n").otherwise(F.concat(F.lit(" r"), F.col("turn").cast("string"), F.lit("\n"))), text).alias("thought"), X.chat_messages(F.col("messages"), text)[0]["role"].alias("first_role"), named.alias("ids"),
    )
    return each.join(made, ["conv_id", "turn"])


_PADS = ["".join(f"{x ^ pad:02x}" for x in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"""WITH h AS (SELECT item_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(text)))) AS mac, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(text)) AS s FROM benchmark)
SELECT item_id, mac, left(s, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST('0x' || substr(s, 17, 1) AS INTEGER) + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS uuid FROM h""")
def keyed_hashes(spark: SparkSession, d: str) -> DataFrame:
    """P33, P39."""
    import uuid

    return table(spark, d, "benchmark").select("item_id", X.hmac_sha256("secret", F.col("text")).alias("mac"), X.uuid5(str(uuid.NAMESPACE_URL), F.col("text")).alias("uuid"))


@query(f"""{JOINED} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'ERROR_ORIGINAL_MODERATION' WHEN doc_id % 7 = 1 AND NOT coalesce(starts_with(c, 'ERROR_'), false) THEN 'ERROR_ORIGINAL_RESPONSE' ELSE c END AS compliance,
 CASE WHEN doc_id % 7 = 0 THEN c END AS former_label, CASE WHEN doc_id % 7 = 0 THEN 'now' ELSE 'then' END AS at, CASE WHEN doc_id % 7 = 0 THEN 'Post-processed: original response stopped by provider moderation/classifier (sensitive); changed compliance from ' || coalesce('''' || c || '''', 'None') || ' to ERROR_ORIGINAL_MODERATION. Previous judge analysis: old' ELSE 'old' END AS analysis FROM joined""")
def recoded_labels(spark: SparkSession, d: str) -> DataFrame:
    """P40, P41."""
    j = joined(spark, d).select("doc_id", F.col("c").alias("compliance"), F.lit("old").alias("judge_analysis"), F.lit("then").alias("timestamp"), F.lit("raw").alias("raw_judge_response"))
    moderated = rows.recode_moderated(j, F.when(F.col("doc_id") % 7 == 0, "sensitive"), "now")
    return rows.recode_failed(moderated, F.when(F.col("doc_id") % 7 == 1, "error").otherwise("stop")).select("doc_id", "compliance", "former_label", F.col("timestamp").alias("at"), F.col("judge_analysis").alias("analysis"))


@query(f"""{JOINED} SELECT CASE doc_id % 3 WHEN 0 THEN lang || '::' || doc_id WHEN 1 THEN 'k' || doc_id ELSE lang || '::' || doc_id END AS key, coalesce(c, 'UNPARSED') AS observed, doc_id % 3 = 1 AND doc_id % 2 = 0 AS is_truncated FROM joined WHERE lang IS NOT NULL AND (doc_id % 3 <> 0 OR c IS NOT NULL) AND (doc_id % 3 <> 2 OR c IS NULL OR c NOT LIKE 'ERR%')""")
def normalized_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of judge files, local runs and evaluation environments in one form."""
    k, c = F.col("doc_id") % 3, F.col("c")
    j = joined(spark, d).filter("lang IS NOT NULL AND (doc_id % 3 <> 0 OR c IS NOT NULL) AND (doc_id % 3 <> 2 OR c IS NULL OR c NOT LIKE 'ERR%')")
    none = F.lit(None).cast("string")
    shaped = j.select(
        F.when(k == 0, c).alias("compliance"), F.when(k == 0, F.col("lang")).alias("model"), F.when(k == 0, F.col("doc_id").cast("string")).alias("question_id"), F.when(k == 1, F.coalesce(c, F.lit(""))).alias("observed"),
        F.when(k == 1, F.concat(F.lit('{"key":"k'), "doc_id", F.lit('"}'))).alias("metadata"), none.alias("id"), none.alias("raw_judge_response"), F.lit(1).cast("long").alias("generated_tokens"), (F.col("doc_id") % 2 == 0).alias("t"),
        F.when(k == 2, F.concat(F.lit('{"id":"gold::'), "lang", F.lit("::"), "doc_id", F.lit('"}'))).alias("info"), F.concat(F.lit('[{"content":"LABEL: '), F.coalesce(c, F.lit("none")), F.lit('"}]')).alias("completion"), none.alias("token_usage"), k.alias("k"),
    ).withColumn("is_truncated", F.col("t") & (F.col("k") == 1))
    return rows.normalize_results(shaped).select("key", "observed", "is_truncated")


# joins of results, reviews and registries


@query(f"""{JOINED} SELECT doc_id, expected, coalesce(c, a, 'NONE') AS label, CASE WHEN doc_id % 5 = 0 THEN 'b' || doc_id END AS prompt FROM joined WHERE doc_id NOT IN (SELECT doc_id FROM joined WHERE doc_id % 9 = 0 OR doc_id % 8 = 0) AND doc_id % 2 = 0""")
def filled_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels filled from another judge, excluded aliases gone, prompts looked up."""
    j = joined(spark, d)
    both = recon.align_strictly(j.select("doc_id", "expected", "c"), gold(spark, d), "doc_id", "expected").select("doc_id", "expected", F.col("c").alias("label"))
    filled = recon.fill(both, j.select("doc_id", F.col("a").alias("label")), "doc_id", "label", default=F.lit("NONE"))
    key = F.concat(F.lit("k"), F.col("doc_id").cast("string"))
    named = filled.withColumn("aliases", F.array(key, F.concat(F.lit("gold::"), key)))
    excluded = j.filter("doc_id % 9 = 0").select(key.alias("key")).unionByName(j.filter("doc_id % 8 = 0").select(F.concat(F.lit("gold::"), key).alias("key")))
    kept = recon.semi(recon.exclude_by_alias(named, "aliases", excluded, "key", "doc_id"), j.filter("doc_id % 2 = 0"), "doc_id")
    none = F.lit(None).cast("string")
    lookup = j.filter("doc_id % 5 = 0").select(F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("lookup_key")).withColumn("prompt", F.col("lookup_key"))
    asked = kept.withColumns({"text": none, "prompt": none, "first_key": key, "second_key": F.concat(F.lit("b"), F.col("doc_id").cast("string"))})
    return recon.resolve_prompt(asked, lookup, ["first_key", "second_key"]).select("doc_id", "expected", "label", F.col("resolved").alias("prompt"))


@query(f"""{JOINED} SELECT lang, count(*) AS rows, count(*) FILTER (a IS DISTINCT FROM b) AS changed, count(*) FILTER (sha256(a) IS DISTINCT FROM sha256(c)) AS stale_content FROM joined WHERE lang IS NOT NULL GROUP BY lang""")
def version_changes(spark: SparkSession, d: str) -> DataFrame:
    """J18, J19."""
    j = joined(spark, d).filter("lang IS NOT NULL")
    old, new = j.select("doc_id", "lang", F.col("a").alias("label")), j.select("doc_id", "lang", F.col("b").alias("label"))
    changes = recon.compare_versions(old, new, ["doc_id", "lang"], "label", "lang")
    responses, analysed = (j.select("doc_id", "lang", F.sha2(x, 256).alias("signature")) for x in ("a", "c"))
    stale = recon.content_mismatch(responses, analysed, ["doc_id", "lang"], "signature").groupBy("lang").agg(recon.one("stale_content"))
    return changes.join(stale, "lang", "left").fillna(0, ["stale_content"])


@query("SELECT doc_id, max(n_chars) AS score FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, NULL FROM documents) GROUP BY doc_id")
def alias_priority(spark: SparkSession, d: str) -> DataFrame:
    """J20."""
    docs = _docs(spark, d, "doc_id", "n_chars")
    first, second = F.concat(F.lit("p"), F.col("doc_id").cast("string")), F.concat(F.lit("q"), F.col("doc_id").cast("string"))
    known = docs.filter("doc_id % 2 = 0").select(first.alias("key"), F.col("n_chars").alias("score")).unionByName(docs.filter("doc_id % 3 = 0").select(second.alias("key"), F.col("doc_id").alias("score")))
    return recon.priority_by_alias(docs.select("doc_id", F.array(first, second).alias("aliases")), "aliases", known, "key", "score", "doc_id").select("doc_id", "score")


@query(f"""{THREE}, v AS (SELECT doc_id, expected, string_agg(judge || '=' || label, ',' ORDER BY judge) AS votes, count(label) AS n FROM three WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, votes, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'EVASIVE' ELSE expected END AS label, expected AS former FROM v""")
def revised_gold(spark: SparkSession, d: str) -> DataFrame:
    """judges' votes beside gold that reviews have changed."""
    three = _three(spark, d).filter("label IS NOT NULL")
    v = recon.pivot_votes(three, "doc_id", "judge", "label")
    reviews = gold(spark, d).filter("doc_id % 3 = 0").select("doc_id", F.lit("likely_gold_wrong").alias("verdict"), F.when(F.col("doc_id") % 2 == 0, "EVASIVE").alias("new_label")).unionByName(gold(spark, d).filter("doc_id % 3 = 1").select("doc_id", F.lit("gold_right").alias("verdict"), F.lit("DENIAL").alias("new_label")))
    out = recon.revise_gold(gold(spark, d), reviews, "doc_id", "expected").join(v, "doc_id")
    votes_text = F.array_join(F.transform(F.array_sort(F.map_keys("votes")), lambda k: F.concat(k, F.lit("="), F.col("votes")[k])), ",")
    return out.select("doc_id", votes_text.alias("votes"), F.col("expected").alias("label"), "former")


@query(f"""{THREE}, r AS (SELECT doc_id, expected, judge, CASE WHEN doc_id % 2 = 0 THEN 'think' ELSE 'plain' END AS regime, label FROM three WHERE label IS NOT NULL), j AS (SELECT judge, regime, count(*) AS rows, round(100.0 * count(*) FILTER (label = expected) / count(*), 3) AS agreement_pct FROM r GROUP BY 1, 2), n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1)
SELECT judge, regime, rows, agreement_pct, (SELECT min(n) FROM n) AS least, (SELECT round(avg(n), 6) FROM n) AS mean, (SELECT max(n) FROM n) AS most FROM j""")
def published_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Nested judges and regimes of a published set, and their coverage."""
    r = _three(spark, d).filter("label IS NOT NULL").withColumn("regime", F.when(F.col("doc_id") % 2 == 0, "think").otherwise("plain"))
    nested = recon.nest_judges(r, "doc_id").join(gold(spark, d), "doc_id")
    return votes.judge_coverage(nested, "judges", "expected", "doc_id").crossJoin(F.broadcast(votes.coverage_range(nested, "judges")))


@query("""WITH dec AS (SELECT user_id AS key, CAST(epoch_us(ts) AS VARCHAR) AS reviewed_at, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'agree' ELSE 'reclassify' END AS decision FROM events), q AS (SELECT DISTINCT user_id AS key, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS stratum FROM events WHERE user_id % 3 <> 0),
last AS (SELECT key, decision, count(*) OVER (PARTITION BY key) AS n FROM dec WHERE key % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY reviewed_at DESC) = 1)
SELECT stratum, count(*) AS rows, count(decision) AS decided, count(*) FILTER (decision = 'agree') AS agree, count(*) FILTER (decision = 'reclassify') AS reclassify, CAST(sum(coalesce(n, 0)) AS BIGINT) AS decisions FROM q LEFT JOIN last USING (key) GROUP BY 1""")
def review_progress(spark: SparkSession, d: str) -> DataFrame:
    """Trails of decisions, and how far a queue has been reviewed."""
    e = table(spark, d, "events")
    dec = e.filter("user_id % 5 <> 0").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("reviewed_at"), F.when(F.col("event_type").isin("click", "view"), "agree").otherwise("reclassify").alias("decision"), F.lit(None).cast("string").alias("new_label"))
    queue = e.filter("user_id % 3 <> 0").select(F.col("user_id").alias("key"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("stratum")).distinct()
    trails = recon.decision_trails(dec, queue, "key").join(queue, "key").groupBy("stratum").agg(F.sum(F.size("trail")).alias("decisions"))
    return report.progress(queue, dec, "key", "stratum").join(trails, "stratum")


# the judging loop


@query("""WITH a AS (SELECT o_orderkey AS k, max(CASE WHEN l_linestatus = 'F' THEN 'ERROR_ORIGINAL_RESPONSE' ELSE 'COMPLETE' END) AS label, max(l_shipdate) AS seen FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 4 <> 0 GROUP BY 1),
r AS (SELECT o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'provider_error' WHEN 'O' THEN 'success' ELSE 'moderation' END AS status FROM orders)
SELECT o_orderkey, status FROM r LEFT JOIN a ON k = o_orderkey WHERE k IS NULL OR seen < o_orderdate OR NOT CASE status WHEN 'success' THEN label <> 'ERROR_ORIGINAL_RESPONSE' WHEN 'moderation' THEN false ELSE label = 'ERROR_ORIGINAL_RESPONSE' END""")
def judging_worklist(spark: SparkSession, d: str) -> DataFrame:
    """F2, section 2.12: orders as responses, their lines as analyses; missing, stale and unfit ones."""
    li = table(spark, d, "lineitem").filter("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "ERROR_ORIGINAL_RESPONSE").otherwise("COMPLETE").alias("label"), "l_shipdate")
    done = li.groupBy("o_orderkey").agg(F.max("label").alias("label"), F.max("l_shipdate").alias("analysed_at"))
    status = F.when(F.col("o_orderstatus") == "F", "provider_error").when(F.col("o_orderstatus") == "O", "success").otherwise("moderation")
    batch = table(spark, d, "orders").select("o_orderkey", "o_orderdate", status.alias("status")).join(done.select("o_orderkey", "label"), "o_orderkey", "left")
    todo = work_list(batch, done.select("o_orderkey", "analysed_at"), ["o_orderkey"], "o_orderdate", rows.analysis_fits(F.col("status"), F.col("label")))
    return todo.select("o_orderkey", "status")


@query("""SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) > CAST(l AS VARCHAR) AS stale, o_orderkey % 3 <> 0 AS no_category FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    """F3, F4."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("l"))
    o = table(spark, d, "orders").join(li, "o_orderkey")
    category = F.when(F.col("o_orderkey") % 3 == 0, "x").when(F.col("o_orderkey") % 3 == 1, " Undefined ")
    return o.select("o_orderkey", X.stale(F.col("o_orderdate").cast("string"), F.col("l").cast("string")).alias("stale"), X.missing_category(category).alias("no_category"))


@query(f"""{JOINED}, n AS (SELECT source FROM joined GROUP BY source HAVING count(*) >= 3) SELECT doc_id, coalesce(c, 'none') AS label, regexp_matches(coalesce(c, ''), '(?i)format') AS told FROM joined WHERE source IN (SELECT source FROM n) AND lang IN ('en', 'fr') AND (c IN ('COMPLETE', 'DENIAL')) OR source IN (SELECT source FROM n) AND c = 'ERROR_JUDGE_FORMAT'""")
def filtered_rows(spark: SparkSession, d: str) -> DataFrame:
    """wanted types and labels of models with enough rows, and a recovery subset."""
    j = rows.models_with(joined(spark, d).withColumnsRenamed({"c": "label"}), "source", 3)
    wanted = j.filter(rows.matching(["en", "fr"], ["COMPLETE", "DENIAL"], "lang", "label"))
    out = wanted.unionByName(rows.recovery_subset(j, "label", ["ERROR_JUDGE_FORMAT"], "doc_id", gold(spark, d)))
    return out.select("doc_id", F.coalesce("label", F.lit("none")).alias("label"), F.coalesce(rows.error_text(F.array("label"), "(?i)format"), F.lit(False)).alias("told"))


# rollouts: a user's events are rollouts of one prompt
ROLL = """roll AS (SELECT user_id AS id, event_id, CASE event_type WHEN 'click' THEN 'COMPLETE' WHEN 'view' THEN 'DENIAL' WHEN 'signup' THEN 'EVASIVE' WHEN 'purchase' THEN 'COMPLETE' ELSE 'UNPARSED' END AS observed, CASE user_id % 3 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'DENIAL' ELSE 'EVASIVE' END AS expected, value, value > 190 AS is_truncated FROM events)"""
VOTED = f"""{ROLL}, v AS (SELECT id, min(expected) AS expected, count(*) AS rollouts, count(*) FILTER (observed <> 'UNPARSED') AS parseable, count(*) FILTER (observed = expected) AS correct_votes, count(*) FILTER (is_truncated) AS truncated FROM roll GROUP BY id)"""


def _rollouts(spark: SparkSession, d: str) -> DataFrame:
    label = F.create_map(*[F.lit(x) for x in ("click", "COMPLETE", "view", "DENIAL", "signup", "EVASIVE", "purchase", "COMPLETE", "error", "UNPARSED")])
    expected = F.element_at(F.array(*[F.lit(x) for x in L.LABELS]), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", label[F.col("event_type")].alias("observed"), expected.alias("expected"), "value", (F.col("value") > 190).alias("is_truncated"))


@query(f"""WITH {VOTED} SELECT id, correct_votes > 0 AND correct_votes < rollouts AND parseable = rollouts AND truncated = 0 AS strict_mixed, correct_votes > 0 AND parseable > correct_votes AS loose_mixed, correct_votes = 0 AND parseable = rollouts AND truncated = 0 AS all_wrong, round(abs(correct_votes - rollouts / 2), 6) AS priority,
 round((1 - correct_votes / rollouts) * 2 + CASE WHEN expected = 'COMPLETE' THEN (1 - correct_votes / rollouts) ELSE 0.5 * correct_votes / rollouts END, 9) AS selection_score, greatest(0.5, least(2.0, 1 + (1 - correct_votes / rollouts))) AS loss_weight FROM v""")
def vote_signals(spark: SparkSession, d: str) -> DataFrame:
    """F7, F16, M23, X11."""
    v = votes.votes(_rollouts(spark, d))
    rate = F.col("correct_votes") / F.col("rollouts")
    pair = scores.pair_score(rate, F.col("expected"), rate, (2.0, 0.5, 1.0), (1.0, 0.0, 0.0), 1.0, 0.5, 2.0)
    each = v.select("id", votes.countable("mixed").alias("strict_mixed"), votes.countable("mixed", "loose").alias("loose_mixed"), votes.countable("all_wrong").alias("all_wrong"), F.round(sampling.vote_priority(F.col("correct_votes"), F.col("rollouts")), 6).alias("priority"), pair.alias("p"))
    return each.select("id", "strict_mixed", "loose_mixed", "all_wrong", "priority", F.round("p.selection_score", 9).alias("selection_score"), "p.loss_weight")


@query(f"""WITH {ROLL}, ok AS (SELECT id FROM roll GROUP BY id HAVING bool_and(observed <> 'UNPARSED') AND bool_and(NOT is_truncated)), f AS (SELECT * FROM roll SEMI JOIN ok USING (id)), g AS (SELECT id, count(DISTINCT observed) AS d FROM f GROUP BY id)
SELECT (SELECT count(*) FROM f) AS rollouts, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g WHERE d <= 1) AS one_label FROM f""")
def reward_spread(spark: SparkSession, d: str) -> DataFrame:
    """Whole groups of rollouts and the spread of their rewards."""
    whole = votes.whole_groups(_rollouts(spark, d), "id")
    spread = votes.reward_spread(whole, "id", "value").select("mean", "std", "groups")
    one_label = votes.reward_spread(whole.withColumn("code", F.length("observed")), "id", "code").select(F.col("zero_variance").alias("one_label"))
    return spread.crossJoin(one_label).crossJoin(whole.agg(recon.one("rollouts")))


@query(f"""WITH {ROLL}, g AS (SELECT id % 4 AS step, id, count(*) AS rollouts, avg(CASE WHEN observed = expected THEN 1.0 ELSE 0.0 END) AS reward FROM roll GROUP BY 1, 2)
SELECT 'overall' AS dimension, NULL AS value, count(*) AS groups, CAST(sum(rollouts) AS BIGINT) AS rollouts, round(sum(reward * rollouts) / sum(rollouts), 6) AS mean_reward FROM g UNION ALL SELECT 'step', CAST(step AS VARCHAR), count(*), CAST(sum(rollouts) AS BIGINT), round(sum(reward * rollouts) / sum(rollouts), 6) FROM g GROUP BY step""")
def reward_batches(spark: SparkSession, d: str) -> DataFrame:
    """A23."""
    g = _rollouts(spark, d).groupBy((F.col("id") % 4).alias("step"), "id").agg(recon.one("rollouts"), F.avg(F.when(F.col("observed") == F.col("expected"), 1.0).otherwise(0.0)).alias("reward"))
    batches = g.groupBy("step").agg(F.collect_list(F.struct("rollouts", "reward")).alias("groups"))  # a step's groups are one logged batch
    return votes.reward_batches(batches, ["step"]).select("dimension", "value", "groups", "rollouts", "mean_reward")


@query(f"""WITH {VOTED}, grid AS (SELECT e, p FROM (VALUES ('COMPLETE'), ('DENIAL'), ('EVASIVE')) a(e), (VALUES (0), (1), (2)) b(p)), k AS (SELECT expected AS e, id % 3 AS p, count(*) AS n FROM v WHERE correct_votes > 0 AND correct_votes < rollouts AND parseable = rollouts AND truncated = 0 GROUP BY 1, 2), s AS (SELECT e, p, coalesce(n, 0) AS n, min(coalesce(n, 0)) OVER () AS floor FROM grid LEFT JOIN k USING (e, p))
SELECT e AS expected, CAST(p AS BIGINT) AS part, n, floor, n < 5 AND EXISTS (SELECT 1 FROM v WHERE v.expected = s.e AND v.id % 3 = s.p AND v.id % 2 = 1) AS open FROM s""")
def vote_stock(spark: SparkSession, d: str) -> DataFrame:
    """Stock of usable votes by bucket, and buckets under target with fresh candidates."""
    v = votes.votes(_rollouts(spark, d)).withColumn("part", F.col("id") % 3)
    grid = spark.createDataFrame([(x,) for x in L.LABELS], "expected string").crossJoin(spark.range(3).select(F.col("id").alias("part")))
    held = votes.stock(v, "id", F.col("id"), ["expected", "part"], grid, votes.countable("mixed"))
    fresh = votes.under_target(held, v.select("expected", "part", "id"), v.filter("id % 2 = 0").select("id"), ["expected", "part"], "id", 5).select("expected", "part", F.lit(True).alias("open"))
    return held.join(fresh, ["expected", "part"], "left").select("expected", "part", "n", "floor", F.coalesce("open", F.lit(False)).alias("open"))


@query(f"""{JOINED}, p AS (SELECT doc_id AS id, doc_id || '::' || b AS pair_id, expected, b, n_chars FROM joined WHERE b <> expected), s AS (SELECT id, pair_id, expected, b, CASE WHEN expected = 'COMPLETE' THEN 'true_complete_recovery' WHEN b = 'COMPLETE' THEN 'false_complete_suppression' END AS side FROM p WHERE id % 4 <> 0), u AS (SELECT *, CASE WHEN b = 'COMPLETE' THEN 2.0 WHEN expected = 'COMPLETE' THEN 1.5 ELSE 1.0 END AS w FROM s WHERE side IS NOT NULL)
SELECT 'overall' AS dimension, NULL AS value, count(*) AS pairs, count(DISTINCT id) AS prompts, round(sum(w), 6) AS weight, round(avg(w), 6) AS mean_weight FROM u UNION ALL SELECT 'expected_label', expected, count(*), count(DISTINCT id), round(sum(w), 6), round(avg(w), 6) FROM u GROUP BY expected
UNION ALL SELECT 'boundary', expected || '->' || b, count(*), count(DISTINCT id), round(sum(w), 6), round(avg(w), 6) FROM u GROUP BY 2 UNION ALL SELECT 'side', side, count(*), count(DISTINCT id), round(sum(w), 6), round(avg(w), 6) FROM u GROUP BY side""")
def pair_report(spark: SparkSession, d: str) -> DataFrame:
    """Usable preference pairs by label, boundary and side."""
    j = joined(spark, d).filter("b <> expected").withColumn("id", F.col("doc_id"))
    pairs = j.select("id", F.concat_ws("::", F.col("id").cast("string"), "b").alias("pair_id"), F.col("expected").alias("expected_label"), F.col("b").alias("rejected_label"), F.concat_ws("->", "expected", "b").alias("boundary"), L.preference_weight(F.col("expected"), F.col("b")).alias("weight"))
    usable = rows.usable_pairs(pairs.unionByName(pairs), j.filter("id % 4 = 0").select("id"), "id")
    return report.pair_summary(usable).select("dimension", "value", "pairs", "prompts", "weight", "mean_weight")


@query(f"""{JOINED}, k AS (SELECT doc_id, expected AS adjudicated, lab, count(*) AS n FROM (SELECT doc_id, expected, unnest([a, b, c]) AS lab FROM joined) WHERE lab IN ('COMPLETE', 'DENIAL', 'EVASIVE') AND lab <> expected GROUP BY 1, 2, 3), t AS (SELECT *, CASE WHEN adjudicated <> 'COMPLETE' AND lab = 'COMPLETE' THEN 0 WHEN adjudicated = 'COMPLETE' AND lab = 'EVASIVE' THEN 0 ELSE 1 END AS tie, max(n) OVER (PARTITION BY doc_id) AS top FROM k), c AS (SELECT *, count(*) FILTER (n = top) OVER (PARTITION BY doc_id) AS ties FROM t)
SELECT doc_id, adjudicated, lab AS rejected_label, CASE WHEN ties = 1 THEN 'policy_frequency' WHEN tie = 0 AND lab = 'COMPLETE' THEN 'tie_prefer_complete_boundary' WHEN tie = 0 THEN 'tie_complete_canonical_prefer_evasive_boundary' ELSE 'tie_deterministic_fallback' END AS reason FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tie, lab) = 1""")
def adjudicated_targets(spark: SparkSession, d: str) -> DataFrame:
    """The wrong label that an adjudicated prompt is paired with."""
    k = _three(spark, d).filter("label IN ('COMPLETE', 'DENIAL', 'EVASIVE') AND label <> expected").groupBy("doc_id", F.col("expected").alias("adjudicated"), "label").agg(recon.one())
    return sampling.choose_wrong_label(k, "doc_id", "adjudicated", "label", "n")


# reports


@query(f"""WITH s AS (SELECT source AS model, {STATUS} AS status FROM {PLANTED}) SELECT status, NULL AS model, count(*) AS n FROM s GROUP BY status UNION ALL SELECT status, model, count(*) FROM s GROUP BY status, model""")
def status_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counts by status, and by model and status; three examples of unknown metadata are asked for as well."""
    r = _responses(spark, d).select("doc_id", F.col("source").alias("model"), Response(F.col("response"), F.lit("v/m")).status().alias("s"))
    tagged = written(r.select("model", "s.status", "s.reason", F.lit("f").alias("_file"), F.col("doc_id").alias("_line")), "statuses")
    counts, shown = report.status_audit(tagged, 3)
    return counts.filter("reason IS NULL").join(F.broadcast(shown.agg(F.count_if(F.col("_line") > 0).alias("m"))), F.col("m") <= 3).select("status", "model", "n")


@query(f"""{JOINED}, e AS (SELECT doc_id AS question_id, CASE WHEN doc_id % 5 = 0 THEN 'truncation' ELSE 'success' END AS status, coalesce(c, '<missing_analysis>') AS label, c FROM joined), r AS (SELECT *, status <> 'success' OR label NOT IN ('COMPLETE', 'DENIAL', 'EVASIVE') AS retained FROM e)
SELECT status || ' | ' || label AS bucket, count(*) AS rows, (SELECT count(*) FROM r WHERE retained) AS retained, (SELECT count(*) FROM r WHERE c IS NULL) AS missing, array_to_string(list_sort(list(question_id ORDER BY question_id)[1:5]), ',') AS examples FROM r WHERE retained GROUP BY 1""")
def error_report(spark: SparkSession, d: str) -> DataFrame:
    """Retained errors by bucket with examples."""
    none = F.lit(None).cast("string")
    e = joined(spark, d).select(F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 5 == 0, "truncation").otherwise("success").alias("status"), none.alias("reason"), F.col("c").alias("compliance"), none.alias("finish"), none.alias("family"), none.alias("provider"))
    counts, shown = report.eval_errors(e, 5)
    overall = counts.filter("dimension = 'overall'").select("retained", F.col("missing_analysis").alias("missing"))
    sizes = e.filter("status <> 'success' OR compliance IS NULL OR compliance NOT IN ('COMPLETE', 'DENIAL', 'EVASIVE')").groupBy(F.concat_ws(" | ", "status", F.coalesce("compliance", F.lit("<missing_analysis>"))).alias("bucket")).agg(recon.one("rows"))
    return sizes.join(shown, "bucket").crossJoin(F.broadcast(overall)).select("bucket", "rows", "retained", "missing", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query(f"""{JOINED}, s AS (SELECT lang, source, CASE WHEN c IS NULL OR c NOT IN ('COMPLETE', 'DENIAL', 'EVASIVE') THEN 'unparseable' WHEN c = expected AND c = a THEN 'all_agree' WHEN c = expected THEN 'judge_confirms_pool' WHEN c = a THEN 'judge_confirms_local' ELSE 'judge_third_label' END AS status FROM joined),
d AS (SELECT 'overall' AS dimension, NULL AS value, status FROM s UNION ALL SELECT 'boundary', lang, status FROM s UNION ALL SELECT 'question_type', source, status FROM s UNION ALL SELECT 'bucket', lang || source, status FROM s)
SELECT dimension, value, count(*) AS rows, count(*) FILTER (status = 'all_agree') AS all_agree, count(*) FILTER (status = 'judge_third_label') AS third, count(*) FILTER (status = 'unparseable') AS unparseable FROM d GROUP BY 1, 2""")
def adjudication_report(spark: SparkSession, d: str) -> DataFrame:
    """A34, A38, P44."""
    s = joined(spark, d).select(F.col("lang").alias("boundary"), F.col("source").alias("question_type"), F.concat("lang", "source").alias("bucket"), L.adjudication_status(F.col("expected"), F.col("a"), F.col("c")).alias("status"))
    return report.adjudications(s).select("dimension", "value", "rows", "all_agree", F.col("judge_third_label").alias("third"), "unparseable")


@query(f"""{JOINED}, m AS (SELECT lang, count(*) AS rows, count(*) FILTER (a = 'COMPLETE') AS complete, count(*) FILTER (a = 'DENIAL') AS denial, count(*) FILTER (a = 'EVASIVE') AS evasive, count(DISTINCT source) AS types, round(avg(n_chars), 3) AS mean_chars FROM joined GROUP BY lang), n AS (SELECT source, count(*) AS n FROM joined GROUP BY source), o AS (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS c FROM n)
SELECT m.*, (SELECT min(n) FROM n) AS least, (SELECT n FROM o WHERE r = (c + 1) // 2) AS median, (SELECT max(n) FROM n) AS most FROM m""")
def composition_report(spark: SparkSession, d: str) -> DataFrame:
    """A36, A37."""
    j = joined(spark, d).select("lang", F.col("a").alias("label"), F.col("source").alias("question_type"), F.col("lang").alias("domain"), F.col("source").alias("model"), F.col("n_chars").alias("response_chars"))
    m = report.composition(j, "lang").select("lang", "rows", "complete", "denial", "evasive", "types", "mean_chars")
    matrix = report.type_label_matrix(j).agg(F.sum(F.col("COMPLETE") + F.col("DENIAL") + F.col("EVASIVE")).alias("whole"))
    balance = report.source_balance(j, "model").select("least", "median", "most")
    checked = m.agg(F.sum("rows").alias("whole")).join(matrix, "whole").crossJoin(balance)  # both tables count the same rows
    return m.crossJoin(F.broadcast(checked.drop("whole")))


@query(f"""{JOINED}, s AS (SELECT lang, source, CASE WHEN c IN ('COMPLETE', 'DENIAL', 'EVASIVE') THEN c END AS o, expected FROM joined), d AS (SELECT 'overall' AS dimension, NULL AS value, o, expected FROM s UNION ALL SELECT 'lang', lang, o, expected FROM s UNION ALL SELECT 'source', source, o, expected FROM s)
SELECT dimension, value, count(*) AS rows, count(*) FILTER (o = expected) AS correct, count(*) FILTER (o IS NULL) AS ties, round(100.0 * count(*) FILTER (o = expected) / count(*), 3) AS accuracy_pct, CASE WHEN count(o) > 0 THEN round(100.0 * count(*) FILTER (o = expected) / count(o), 3) ELSE 0.0 END AS decided_pct FROM d GROUP BY 1, 2""")
def tier_scores(spark: SparkSession, d: str) -> DataFrame:
    """A38."""
    s = joined(spark, d).withColumn("observed", F.when(F.col("c").isin(*L.LABELS), F.col("c")))
    return report.score_by_tier(s, ["lang", "source"]).select("dimension", "value", "rows", "correct", "ties", "accuracy_pct", "decided_pct")


@query(f"""{JOINED}, k AS (SELECT * FROM joined WHERE c IN ('COMPLETE', 'DENIAL', 'EVASIVE')), w AS (SELECT lang AS run, count(*) AS n, count(*) FILTER (c = expected) AS ok FROM k GROUP BY lang), size AS (SELECT max(n) AS n FROM w)
SELECT count(*) AS rows, count(*) FILTER (a <> b) AS changed, count(*) FILTER (a <> expected AND b = expected) AS toward_gold, count(*) FILTER (a = expected AND b <> expected) AS away_from_gold, count(*) FILTER (a = expected) AS correct, count(c) AS with_local, count(*) FILTER (a = c) AS agree_local, CAST((SELECT sum(ok) FROM w WHERE n = 20) AS BIGINT) AS whole_correct FROM joined""")
def turn_report(spark: SparkSession, d: str) -> DataFrame:
    """A41, A59, A60."""
    j = joined(spark, d)
    flips = votes.two_turn_flips(j, "expected", "a", "b")
    local = report.local_agreement(j, "expected", "a", "c").select("correct", "with_local", "agree_local")
    whole = report.whole_runs(j, "lang", "expected", "c", 20).agg(F.sum("correct").alias("whole_correct"))
    return flips.crossJoin(local).crossJoin(whole)


@query(f"""WITH {JUDGES}, k AS (SELECT lang AS file, source || '/m' AS model, a FROM judged), s AS (SELECT file, model, count(*) AS total, count(*) FILTER (a = 'COMPLETE') / count(*) AS c, count(*) FILTER (a = 'DENIAL') / count(*) AS d, count(*) FILTER (a = 'EVASIVE') / count(*) AS e FROM k GROUP BY 1, 2)
SELECT file, model, total, round(c, 9) AS complete_pct, CASE WHEN c = greatest(c, d, e) THEN 'COMPLETE' WHEN d = greatest(c, d, e) THEN 'DENIAL' ELSE 'EVASIVE' END AS dominant, round(greatest(c, d, e) - least(c, d, e), 9) AS balance, split_part(model, '/', 1) AS creator FROM s""")
def model_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A45."""
    k = judged(spark, d).select(F.col("lang").alias("file"), F.concat("source", F.lit("/m")).alias("model"), F.col("a").alias("label"))
    return report.model_stats(k, "file", "model", "label").select("file", "model", "total", F.round("complete_pct", 9).alias("complete_pct"), "dominant", F.round("balance", 9).alias("balance"), "creator")


@query(r"""WITH b AS (SELECT regexp_replace(CAST(p_partkey AS VARCHAR), '\d$', '') AS base_id, count(*) AS n FROM part GROUP BY 1), s AS (SELECT p_brand, p_size % 3 AS tier, count(*) AS n, min(p_retailprice) AS least, max(p_retailprice) AS greatest FROM part GROUP BY 1, 2)
SELECT p_brand, CAST(tier AS INTEGER) AS tier, n, least, greatest, (SELECT count(*) FROM b) AS bases, (SELECT max(n) FROM b) AS variants, (SELECT count(DISTINCT trim(p_type)) FROM part WHERE p_type <> '') AS domains, (SELECT count(*) FROM (SELECT p_brand, p_size FROM part GROUP BY ALL HAVING count(*) > 1)) AS doubles FROM s""")
def bucket_report(spark: SparkSession, d: str) -> DataFrame:
    """A31, A49, A56, A57, U7."""
    p = table(spark, d, "part")
    s = report.bucket_scores(p.withColumn("tier", F.col("p_size") % 3), ["p_brand", "tier"], "p_retailprice")
    variants = report.variant_counts(p.select(F.col("p_partkey").cast("string").alias("id")), "id").agg(recon.one("bases"), F.max("n").alias("variants"))
    names = report.domains(p, "p_type").agg(recon.one("domains"))
    doubles = jsonl.duplicates(p, ["p_brand", "p_size"]).agg(recon.one("doubles"))
    return s.crossJoin(variants).crossJoin(names).crossJoin(doubles)


@query(f"""{JOINED} SELECT source AS question_type, count(*) FILTER (a = 'COMPLETE') AS "COMPLETE", count(*) FILTER (a = 'DENIAL') AS "DENIAL", count(*) FILTER (a = 'EVASIVE') AS "EVASIVE" FROM joined GROUP BY source""")
def type_labels(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of types and labels, cell by cell."""
    return report.type_label_matrix(joined(spark, d).select(F.col("source").alias("question_type"), F.col("a").alias("label")))


@query(r"""SELECT 'variants' AS what, regexp_replace(CAST(p_partkey AS VARCHAR), '\d$', '') AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'domain', trim(p_type), NULL FROM part WHERE trim(p_type) <> '' GROUP BY 2
UNION ALL SELECT 'double', p_brand || '|' || p_size, count(*) FROM part GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'whole run', CAST(l_orderkey AS VARCHAR), count(*) FILTER (l_returnflag = 'A') FROM lineitem GROUP BY 2 HAVING count(*) = 4""")
def bucket_rows(spark: SparkSession, d: str) -> DataFrame:
    """Variants, domains, repeated keys and runs of exactly four rows, row by row."""
    p = table(spark, d, "part")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("run"), F.lit("COMPLETE").alias("expected"), F.when(F.col("l_returnflag") == "A", "COMPLETE").otherwise("DENIAL").alias("observed"))
    parts = {
        "variants": report.variant_counts(p.select(F.col("p_partkey").cast("string").alias("id")), "id").select(F.col("base_id").alias("value"), "n"),
        "domain": report.domains(p, "p_type").select(F.col("p_type").alias("value"), F.lit(None).cast("long").alias("n")),
        "double": jsonl.duplicates(p, ["p_brand", "p_size"]).select(F.concat_ws("|", "p_brand", "p_size").alias("value"), "n"),
        "whole run": report.whole_runs(li, "run", "expected", "observed", 4).select(F.col("run").alias("value"), F.col("correct").alias("n")),
    }
    out = None
    for what, rows_ in parts.items():
        named = rows_.select(F.lit(what).alias("what"), "value", "n")
        out = named if out is None else out.unionByName(named)
    return out


@query("""WITH u AS (SELECT CAST(sum(CASE WHEN event_id % 3 <> 0 THEN value ELSE 0 END) AS DOUBLE) + sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS tokens FROM events) SELECT round(tokens, 4) AS completion_tokens FROM u""")
def usage_report(spark: SparkSession, d: str) -> DataFrame:
    """A10: usage summed over two payloads of a row."""
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 3 != 0, F.concat(F.lit('{"usage":{"completion_tokens":'), F.col("value").cast("string"), F.lit("}}"))).alias("first"), F.when(F.col("event_id") % 2 == 0, F.lit('{"usage":{"completion_tokens":1}}')).alias("second"))
    return metrics.usage_totals(e, ["first", "second"], ["completion_tokens"]).select(F.round("completion_tokens", 4).alias("completion_tokens"))


@query("""WITH o AS (SELECT l_orderkey AS run, sum(l_quantity) AS q, sum(l_tax) AS t, sum(l_extendedprice) AS c FROM lineitem GROUP BY 1) SELECT run, round(q - 100, 6) AS delta_inference_seconds, round(t - 1, 6) AS delta_startup_seconds, round(c - o_totalprice, 6) AS delta_cost, round(100 * (q - 100) / 100, 3) AS delta_inference_seconds_pct FROM o JOIN orders ON o_orderkey = run""")
def estimate_check(spark: SparkSession, d: str) -> DataFrame:
    """A61."""
    attempts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_quantity").alias("inference_seconds"), F.col("l_tax").alias("startup_seconds"), F.col("l_extendedprice").alias("cost"))
    estimate = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.lit(100.0).alias("inference_seconds"), F.lit(1.0).alias("startup_seconds"), F.col("o_totalprice").alias("cost"))
    return scores.estimate_against_observed(estimate, attempts, "run").select("run", "delta_inference_seconds", "delta_startup_seconds", "delta_cost", "delta_inference_seconds_pct")


# orders and queues: each is cut after its first rows, so that the order shows


@query(f"""{THREE}, v AS (SELECT doc_id, expected, count(*) AS n, count(*) FILTER (label <> expected) AS k FROM three WHERE label IS NOT NULL GROUP BY 1, 2), q AS (SELECT 'review' AS queue, row_number() OVER (ORDER BY expected <> 'EVASIVE', k DESC, doc_id) AS place, doc_id FROM v WHERE k >= n // 2 + 1 ORDER BY place LIMIT 25),
p AS (SELECT 'priority' AS queue, row_number() OVER (ORDER BY n_chars % 9 DESC, {MD5.format('prio')}, doc_id) AS place, doc_id FROM documents ORDER BY place LIMIT 25),
s AS (SELECT 'selection' AS queue, row_number() OVER (ORDER BY CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 ELSE 1000000000 END, n_chars % 7 DESC, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0 END DESC, doc_id) AS place, doc_id FROM documents ORDER BY place LIMIT 25)
SELECT queue, doc_id FROM q UNION ALL SELECT queue, doc_id FROM p UNION ALL SELECT queue, doc_id FROM s""")
def queues(spark: SparkSession, d: str) -> DataFrame:
    """The heads of three queues."""
    v = recon.pivot_votes(_three(spark, d).filter("label IS NOT NULL"), "doc_id", "judge", "label")
    review = report.review_queue(gold(spark, d), v, "doc_id", "expected", limit=25).select(F.lit("review").alias("queue"), "doc_id")
    docs = _docs(spark, d, "doc_id", "n_chars")
    by_priority = report.priority_order(docs.withColumn("p", F.col("n_chars") % 9), "p", "prio", "doc_id").limit(25).select(F.lit("priority").alias("queue"), "doc_id")
    ranked = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 50).alias("selection_rank"), (F.col("n_chars") % 7).cast("double").alias("priority_score"), F.when(F.col("doc_id") % 2 == 0, 0.5).alias("margin"))
    return review.unionByName(by_priority).unionByName(report.queue_order(ranked, "doc_id").limit(25).select(F.lit("selection").alias("queue"), "doc_id"))


@query(f"""{THREE}, k AS (SELECT judge, round(100.0 * count(*) FILTER (label = expected) / count(*), 3) AS accuracy_pct FROM three GROUP BY judge ORDER BY 2 DESC, 1 LIMIT 2), m AS (SELECT label, count(*) AS n FROM three WHERE label IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 2)
SELECT judge AS name, accuracy_pct AS figure FROM k UNION ALL SELECT label, n FROM m""")
def top_lists(spark: SparkSession, d: str) -> DataFrame:
    """T2, T4, W12."""
    three = _three(spark, d)
    accuracy = three.groupBy("judge").agg(F.round(100.0 * F.count_if(F.col("label") == F.col("expected")) / F.count(F.lit(1)), 3).alias("accuracy_pct"))
    card = report.scorecard(accuracy, "judge").limit(2).select(F.col("judge").alias("name"), F.col("accuracy_pct").alias("figure"))
    return card.unionByName(report.most_common(three.filter("label IS NOT NULL"), "label", 2).select(F.col("label").alias("name"), F.col("n").cast("double").alias("figure")))


@query(f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {MD5.format('in')}, doc_id) AS r FROM documents) SELECT doc_id, r AS round FROM r ORDER BY r, lang, source LIMIT 90""")
def interleaved(spark: SparkSession, d: str) -> DataFrame:
    """Cells taken in turn."""
    out = rank.round_robin(_docs(spark, d, "doc_id", "lang", "source"), ["lang", "source"], [X.hash_order("in", F.col("doc_id")), F.col("doc_id")])
    return out.orderBy("round", "lang", "source").limit(90).select("doc_id", "round")


@query(r"""WITH o(id, gpu, n, mem, provider, socket, stock, spot, price) AS (SELECT 'o' || p_partkey, CASE p_size % 3 WHEN 0 THEN 'h100_80gb' WHEN 1 THEN 'A100 80GB (Spot)' ELSE 'T4' END, 1 + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END, CASE WHEN p_size % 2 = 0 THEN 80.0 ELSE 40.0 END, 'P' || p_size % 4, CASE WHEN p_size % 5 = 0 THEN 'SXM5' ELSE 'PCIe' END, CASE p_partkey % 3 WHEN 0 THEN 'Available' WHEN 1 THEN 'Low' ELSE 'High' END, p_partkey % 7 = 0, p_retailprice / 100 FROM part),
pr(ord, id, pat, mem, socket, provider, rate, cold, seen) AS (VALUES (0, 'fast', '^H100', 60.0, 'sxm5', 'p1', 2.0, 60.0, '2026-01'), (1, 'any', '^H100', NULL, NULL, 'p2', 1.0, 90.0, '2025-01'), (2, 'mid', '^A100', 60.0, '', 'p0', 1.5, 80.0, '2026-02'), (3, 'mid2', '100', NULL, '', 'p3', 0.5, 10.0, '2024-02')),
t AS (SELECT *, CASE WHEN lower(provider) = 'p3' THEN 'explicitly_excluded' WHEN n <> 1 THEN 'not_single' WHEN stock = 'High' THEN 'ineligible_stock' WHEN spot THEN 'spot_policy_excluded' END AS reason FROM o),
m AS (SELECT t.id, t.price, pr.id AS profile_id, pr.rate, pr.cold, row_number() OVER (PARTITION BY t.id ORDER BY CASE WHEN coalesce(pr.socket, '') <> '' THEN 10 ELSE 0 END + CASE WHEN lower(t.provider) = pr.provider THEN 2 ELSE 0 END DESC, pr.seen DESC, pr.ord) AS r FROM t JOIN pr ON regexp_matches(upper(regexp_replace(t.gpu, '\s*\(spot\)\s*$', '', 'i')), pr.pat) AND (pr.mem IS NULL OR t.mem >= pr.mem) AND (coalesce(pr.socket, '') = '' OR lower(t.socket) = pr.socket) WHERE t.reason IS NULL)
SELECT id, profile_id, round(2120 / rate, 6) AS inference_seconds, round((2120 / rate + cold) * price / 3600, 6) AS total_cost FROM m WHERE r = 1""")
def ranked_offers(spark: SparkSession, d: str) -> DataFrame:
    """Parts as GPU offers."""
    p = table(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    offers = p.select(
        F.concat(F.lit("o"), k.cast("string")).alias("id"), F.when(size % 3 == 0, "h100_80gb").when(size % 3 == 1, "A100 80GB (Spot)").otherwise("T4").alias("gpu_type"), F.when(k % 11 == 0, 2).otherwise(1).alias("gpu_count"), F.when(size % 2 == 0, 80.0).otherwise(40.0).alias("gpu_memory"),
        F.concat(F.lit("P"), (size % 4).cast("string")).alias("provider"), F.when(size % 5 == 0, "SXM5").otherwise("PCIe").alias("socket"), F.when(k % 3 == 0, "Available").when(k % 3 == 1, "Low").otherwise("High").alias("stock_status"), (k % 7 == 0).alias("is_spot"), (F.col("p_retailprice") / 100).alias("price_value"),
    )
    profile = lambda n, i, pat, mem, socket, prov, rate, cold, at: (n, i, pat, mem, socket, prov, rate, {"cold": cold}, {}, "measured", at)
    schema = "ordinal int, profile_id string, gpu_type_regex string, minimum_gpu_memory_gb double, socket string, source_provider string, rows_per_second double, startup_seconds map<string,double>, provider_startup_seconds map<string,map<string,double>>, confidence string, measured_at string"
    profiles = spark.createDataFrame([profile(0, "fast", "^H100", 60.0, "sxm5", "p1", 2.0, 60.0, "2026-01"), profile(1, "any", "^H100", None, None, "p2", 1.0, 90.0, "2025-01"), profile(2, "mid", "^A100", 60.0, "", "p0", 1.5, 80.0, "2026-02"), profile(3, "mid2", "100", None, "", "p3", 0.5, 10.0, "2024-02")], schema)
    ranked, _ = rows.rank_offers(offers, profiles, 2120, spot=False, providers=["p3"])
    return ranked.select("id", "profile_id", F.round("inference_seconds", 6).alias("inference_seconds"), F.round("total_cost", 6).alias("total_cost"))


# sampling


@query("""WITH b AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) AS r, count(*) OVER () AS k FROM documents WHERE lang IS NOT NULL GROUP BY lang), cap AS (SELECT min(c) AS cap FROM (SELECT c, (SELECT sum(least(n, c)) FROM b) AS s FROM range(5, 101) t(c)) WHERE s >= 100)
SELECT lang, CAST(97 // k + CASE WHEN r <= 97 % k THEN 1 ELSE 0 END AS BIGINT) AS allocated, coalesce((SELECT cap FROM cap), 100) AS cap FROM b""")
def even_split(spark: SparkSession, d: str) -> DataFrame:
    """M3, M6."""
    b = _docs(spark, d, "lang").filter("lang IS NOT NULL").groupBy("lang").agg(recon.one())
    cap = sampling.relaxed_cap(b, "n", 100, 5)
    return sampling.split_evenly(b, "lang", 97).select("lang", "allocated").crossJoin(F.broadcast(cap))


@query(f"""{JOINED}, s AS (SELECT doc_id, expected, a, (n_chars % 60) / 100.0 AS contention, (n_chars % 31) / 31.0 AS entropy FROM joined), w AS (SELECT doc_id, expected, 1.0 + CASE WHEN contention >= 0.45 THEN 4.0 WHEN contention >= 0.33 THEN 3.0 WHEN contention >= 0.20 THEN 2.0 ELSE 1.0 END + 4.0 * contention + 3.0 * entropy + CASE WHEN a <> expected THEN 3.0 ELSE 0.0 END AS w FROM s)
SELECT doc_id, round(w, 6) AS weight, round(w * CASE WHEN expected IN ('COMPLETE', 'EVASIVE') THEN 1.35 ELSE 0.85 END, 6) AS fill_weight FROM w""")
def boundary_weights(spark: SparkSession, d: str) -> DataFrame:
    """M7, M9."""
    w = sampling.boundary_weight((F.col("n_chars") % 60) / 100.0, (F.col("n_chars") % 31) / 31.0, F.col("a"), F.col("expected"))
    each = joined(spark, d).select("doc_id", "expected", w.alias("w"))
    return each.select("doc_id", F.round("w", 6).alias("weight"), F.round(sampling.boundary_fill_weight(F.col("w"), F.col("expected")), 6).alias("fill_weight"))


@query(f"""WITH o AS (SELECT *, {MD5.format('sp')} AS h FROM (SELECT doc_id, lang, source, doc_id // 3 AS prompt FROM documents)), c AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY lang, prompt ORDER BY h, doc_id) <= 2), t AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) AS t FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY t, source) - 1 AS bucket_index FROM t)
SELECT doc_id, bucket_index FROM b WHERE bucket_index < 12""")
def selected_pairs(spark: SparkSession, d: str) -> DataFrame:
    """M21."""
    docs = _docs(spark, d, "doc_id", "lang", "source").withColumn("prompt", F.expr("doc_id div 3"))
    return sampling.select_pairs(docs, ["lang"], "source", "prompt", 12, 2, "sp", "doc_id").select("doc_id", "bucket_index")


@query(f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY {MD5.format('left')}, doc_id) AS r FROM documents), k AS (SELECT count(DISTINCT coalesce(lang, '?')) AS k FROM documents) SELECT doc_id FROM r, k ORDER BY r <= 150 // greatest(k, 1) DESC, r, lang LIMIT 150""")
def leftover_selection(spark: SparkSession, d: str) -> DataFrame:
    """M24, M29."""
    return sampling.select_with_leftovers(_docs(spark, d, "doc_id", "lang", "source"), ["lang"], 150, "left", "doc_id").select("doc_id")


@query("""WITH i AS (SELECT conv_id, turn, md5(conv_id || '|' || turn) AS h FROM conversations), s AS (SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY h, turn) AS turns FROM i GROUP BY conv_id), c AS (SELECT lang, count(*) FILTER (doc_id % 2 = 0) AS done, count(*) FILTER (doc_id % 2 = 1) AS flying FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT conv_id, turns, (SELECT lang FROM c WHERE done < 100000 ORDER BY done + 0.5 * flying, lang LIMIT 1) AS next FROM s""")
def shuffled_turns(spark: SparkSession, d: str) -> DataFrame:
    """M31, M32."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    counts = _docs(spark, d, "doc_id", "lang").filter("lang IS NOT NULL").groupBy("lang").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("done"), F.count_if(F.col("doc_id") % 2 == 1).alias("flying"))
    following = sampling.next_bucket(counts, "lang", "done", "flying", 100000, 0.5).select(F.col("lang").alias("next"))
    shown = F.array_join(F.transform(sampling.shuffled(F.col("turns"), F.col("conv_id").cast("string")), lambda t: t.cast("string")), ",")
    return c.select("conv_id", shown.alias("turns")).crossJoin(F.broadcast(following))


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), f AS (SELECT conv_id, turn, r, t AS longest, 1 AS n, 0 AS batch FROM o WHERE r = 1 UNION ALL
SELECT o.conv_id, o.turn, o.r, CASE WHEN f.n + 1 > 3 OR greatest(f.longest, o.t) * (f.n + 1) > 2000 THEN o.t ELSE greatest(f.longest, o.t) END, CASE WHEN f.n + 1 > 3 OR greatest(f.longest, o.t) * (f.n + 1) > 2000 THEN 1 ELSE f.n + 1 END, f.batch + CASE WHEN f.n + 1 > 3 OR greatest(f.longest, o.t) * (f.n + 1) > 2000 THEN 1 ELSE 0 END FROM f JOIN o ON o.conv_id = f.conv_id AND o.r = f.r + 1)
SELECT conv_id, turn, batch FROM f""")
def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation in padded batches."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("tokens"))
    return sampling.padded_batches(c, ["conv_id"], [F.col("turn")], "tokens", 3, 2000).select("conv_id", "turn", "batch")


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'train' END AS a, CASE WHEN doc_id % 2 = 0 THEN 'eval' END AS b, CASE WHEN doc_id % 5 = 0 THEN 'test' END AS c FROM documents) SELECT array_to_string(list_filter([b, c, a], lambda x: x IS NOT NULL), ',') AS splits, count(*) AS keys FROM s WHERE len(list_filter([b, c, a], lambda x: x IS NOT NULL)) > 1 GROUP BY 1""")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """U6."""
    docs = _docs(spark, d, "doc_id")
    parts = [docs.filter(F.col("doc_id") % n == 0).withColumn("split", F.lit(name)) for n, name in ((3, "train"), (2, "eval"), (5, "test"))]
    return sampling.overlap_report(parts[0].unionByName(parts[1]).unionByName(parts[2]), "split", "doc_id").select(F.array_join("in", ",").alias("splits"), "keys")


# score math


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, -l_quantity / 10 AS x, -l_discount * 20 AS y, -l_tax * 30 AS z FROM lineitem), e AS (SELECT *, exp(x - greatest(x, y, z)) AS a, exp(y - greatest(x, y, z)) AS b, exp(z - greatest(x, y, z)) AS c FROM s), p AS (SELECT *, a / (a + b + c) AS pa, b / (a + b + c) AS pb, c / (a + b + c) AS pc FROM e),
h AS (SELECT *, -(pa * ln(pa) + pb * ln(pb) + pc * ln(pc)) AS h FROM p), m AS (SELECT *, list_reverse_sort([0.25 * x + 0.75 * pa + 0.1, 0.25 * y + 0.75 * pb, 0.25 * z + 0.75 * pc - 0.1]) AS blend FROM h)
SELECT l_orderkey, l_linenumber, round(pa, 6) AS first, round(h, 6) AS entropy, round(h - 0.3 * greatest(x, y, z), 6) AS priority, round(blend[1] - blend[2], 6) AS margin FROM m""")
def score_priority(spark: SparkSession, d: str) -> DataFrame:
    """X2, X3, X9, X10, W11."""
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(-F.col("l_quantity") / 10, -F.col("l_discount") * 20, -F.col("l_tax") * 30).alias("s"))
    p = s.withColumn("p", scores.softmax(F.col("s"))).withColumn("h", scores.entropy_nats(F.col("p")))
    mixed = scores.blend([F.col("s")[i] for i in range(3)], [F.col("p")[i] for i in range(3)], 0.25, [0.1, 0.0, -0.1])
    return p.select("l_orderkey", "l_linenumber", F.round(F.col("p")[0], 6).alias("first"), F.round("h", 6).alias("entropy"), F.round(scores.priority(F.col("h"), F.array_max("s"), 0.3), 6).alias("priority"), F.round(rank.margin(mixed), 6).alias("margin"))


@query(f"""{JOINED}, p AS (SELECT doc_id, lang, expected, doc_id % 3 AS fold, (n_chars % 97) / 97.0 AS x, (n_chars % 89) / 89.0 AS y, (n_chars % 83) / 83.0 AS z FROM joined), g AS (SELECT i AS n, CAST(round(-0.5 + i * 0.25, 10) AS DOUBLE) AS cb FROM range(5) t(i)), held AS (SELECT i AS held FROM range(3) t(i)),
o AS (SELECT held, n, cb, expected, CASE WHEN x + cb >= y AND x + cb >= z THEN 'COMPLETE' WHEN y >= z THEN 'DENIAL' ELSE 'EVASIVE' END AS o FROM p CROSS JOIN g JOIN held ON fold <> held),
m AS (SELECT held, n, cb, count(*) FILTER (expected = o) AS correct, count(*) FILTER ((expected = 'COMPLETE') = (o = 'COMPLETE')) AS bin, count(*) FILTER (expected <> 'COMPLETE' AND o = 'COMPLETE') AS fp, count(*) FILTER (expected = 'COMPLETE' AND o <> 'COMPLETE') AS fn, count(*) FILTER (expected = 'EVASIVE' AND o = 'EVASIVE') AS ev FROM o GROUP BY 1, 2, 3),
best AS (SELECT held, cb FROM m QUALIFY row_number() OVER (PARTITION BY held ORDER BY bin DESC, fp, correct DESC, ev DESC, fn, n) = 1)
SELECT doc_id, coalesce(b.cb, CAST(0.125 AS DOUBLE)) AS cb FROM p LEFT JOIN (SELECT * FROM best WHERE held < 2) b ON held = fold""")
def out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    """Parameters from the other folds, a fallback where a fold has none."""
    n = F.col("n_chars")
    p = joined(spark, d).select("doc_id", "expected", (F.col("doc_id") % 3).cast("int").alias("fold"), ((n % 97) / 97.0).alias("x"), ((n % 89) / 89.0).alias("y"), ((n % 83) / 83.0).alias("z"))
    steps = [r["cb"] for r in scores.grid(spark, "cb", -0.5, 0.5, 0.25).orderBy("cb").collect()]  # five
    best = scores.biases_out_of_fold(p, [F.col(c) for c in "xyz"], "expected", steps, [0.0], "fold", objective="complete_low_fp").filter("fold < 2").select("fold", F.col("complete_bias").alias("cb"))
    fallback = spark.createDataFrame([(0.125,)], "cb double")
    return scores.calibrated(p, best, fallback, "fold", ["cb"]).select("doc_id", "cb")


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A report written as CSV and a Parquet read with a schema that drops what it doesn't know."""
    few = spark.read.schema("lang string, doc_id long").parquet(f"{d}/documents.parquet")
    path = scratch_path(spark, "report")
    jsonl.write_csv(few.filter("lang IS NOT NULL").groupBy("lang").agg(recon.one()), path)
    return spark.read.schema("lang string, n long").option("header", True).csv(path)
