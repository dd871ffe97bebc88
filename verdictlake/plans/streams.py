"""Queries whose rows come out of stateful streams: each part of a table arrives, is processed, and the stream starts again from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recon
from ..sources.scratch import scratch_path
from ..streaming import state
from .registry import query, table


def _arrives(rows: DataFrame, folder: str, batch: int) -> None:
    rows.write.mode("append").parquet(f"{folder}/arrived={batch}")


def _stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


_START = "TIMESTAMP '2024-01-01 00:00:00'"
# responses and analyses of two batches; in the second some responses are replaced and some analyses made again
_WORK = {
    "response": [("true", "doc_id * INTERVAL '1' SECOND", "CASE WHEN n_chars % 7 = 0 THEN 'provider_error' WHEN n_chars % 11 = 0 THEN 'moderation' ELSE 'success' END"), ("doc_id % 6 = 0", "doc_id * INTERVAL '1' SECOND + INTERVAL '1' DAY", "CASE WHEN doc_id % 18 = 0 THEN 'provider_error' ELSE 'success' END")],
    "analysis": [("doc_id % 4 <> 0", "doc_id * INTERVAL '1' SECOND + (doc_id % 5 - 1) * INTERVAL '1' MINUTE", "CASE WHEN n_chars % 3 = 0 THEN 'ERROR_ORIGINAL_RESPONSE' WHEN n_chars % 3 = 1 THEN 'COMPLETE' ELSE 'DENIAL' END"), ("doc_id % 12 = 0", "doc_id * INTERVAL '1' SECOND + INTERVAL '2' DAY", "CASE WHEN doc_id % 36 = 0 THEN 'ERROR_ORIGINAL_RESPONSE' ELSE 'COMPLETE' END")],
}


def _work_sql() -> str:
    parts = [f"SELECT source AS model, doc_id AS question, '{kind}' AS kind, {_START} + {ts} AS ts, {value} AS value FROM documents WHERE {which} AND source IS NOT NULL" for kind, batches in _WORK.items() for which, ts, value in batches]
    newest = "SELECT model, question, max(struct_pack(ts := ts, value := value)) AS {0} FROM rows WHERE kind = '{0}' GROUP BY 1, 2"
    return f"""WITH rows AS ({" UNION ALL ".join(parts)}), r AS ({newest.format("response")}), a AS ({newest.format("analysis")}),
j AS (SELECT model, question, response.ts AS response_ts, CASE WHEN analysis IS NULL THEN 'missing' WHEN response.ts > analysis.ts THEN 'stale'
 WHEN NOT CASE response.value WHEN 'success' THEN analysis.value <> 'ERROR_ORIGINAL_RESPONSE' WHEN 'moderation' THEN false ELSE analysis.value = 'ERROR_ORIGINAL_RESPONSE' END THEN 'unfit' ELSE '' END AS reason FROM r LEFT JOIN a USING (model, question))
SELECT model, question, CAST(epoch(response_ts) AS BIGINT) AS response_s, reason FROM j WHERE reason <> ''"""


def fits(status: str, label: str) -> bool:
    """rows.analysis_fits for a status and a label."""
    return label != "ERROR_ORIGINAL_RESPONSE" if status == "success" else status != "moderation" and label == "ERROR_ORIGINAL_RESPONSE"


@query(_work_sql())
def stateful_worklist(spark: SparkSession, d: str) -> DataFrame:
    """Section 2.12, F2: the work list as state by model and question, over two batches and a restart between them."""
    docs = table(spark, d, "documents").filter("source IS NOT NULL")
    folder, sink, kept = (scratch_path(spark, x) for x in ("work-in", "work-out", "work-state"))
    for batch in range(2):
        for kind, batches in _WORK.items():
            which, ts, value = batches[batch]
            _arrives(docs.filter(which).select(F.col("source").alias("model"), F.col("doc_id").alias("question"), F.lit(kind).alias("kind"), F.expr(f"{_START} + {ts}").alias("ts"), F.expr(value).alias("value")), folder, batch)
        stream = _stream(spark, folder, "model string, question long, kind string, ts timestamp, value string")
        told = state.stateful_work_list(stream, ["model", "question"], fits)
        write = lambda rows, number: rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch_id={number}")
        told.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema("model string, question long, response_ts timestamp, reason string, batch int").option("recursiveFileLookup", "true").parquet(sink)
    return state.work_now(written, ["model", "question"], F.col("batch")).select("model", "question", F.col("response_ts").cast("long").alias("response_s"), "reason")


_PARTS = 3
_ARRIVED = f"least({_PARTS - 1}, event_id * {_PARTS} // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END)"


@query(f"""WITH e AS (SELECT *, {_ARRIVED} AS batch FROM events), m AS (SELECT b, (SELECT max(ts) FROM e WHERE batch < b) - INTERVAL '2' DAY AS mark FROM range({_PARTS}) x(b)),
s AS (SELECT e.*, coalesce(ts <= mark, false) AS is_late FROM e JOIN m ON b = batch), r AS (SELECT DISTINCT user_id, ts FROM s WHERE event_type = 'view' AND NOT is_late), a AS (SELECT user_id, ts FROM s WHERE event_type = 'purchase' AND NOT is_late),
p AS (SELECT r.user_id, count(*) AS pairs FROM r JOIN a ON a.user_id = r.user_id AND a.ts BETWEEN r.ts AND r.ts + INTERVAL '6' HOUR GROUP BY 1), l AS (SELECT user_id, count(*) AS late FROM s WHERE is_late GROUP BY 1)
SELECT coalesce(p.user_id, l.user_id) AS user_id, coalesce(pairs, 0) AS pairs, coalesce(late, 0) AS late FROM p FULL JOIN l ON l.user_id = p.user_id""")
def late_and_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Section 2.12: views as responses, purchases as analyses; late rows are set aside and counted, views sent twice are one."""
    e = table(spark, d, "events")
    end = e.agg((F.max("event_id") + 1).alias("end"))
    batch = F.least(F.lit(_PARTS - 1), F.floor(F.col("event_id") * _PARTS / F.col("end")) + F.when(F.col("event_id") % 20 == 0, 1).otherwise(0))
    dealt = e.crossJoin(F.broadcast(end)).withColumn("part", batch).select("user_id", "event_type", "ts", "event_id", "part")
    folder, sink, kept, pairs, pair_state = (scratch_path(spark, x) for x in ("late-in", "late-out", "late-state", "late-pairs", "late-pair-state"))
    schema = "user_id long, event_type string, ts timestamp, event_id long"
    for number in range(_PARTS):
        rows = dealt.filter(F.col("part") == number).drop("part")
        _arrives(rows.unionByName(rows.filter("event_type = 'view' AND event_id % 3 = 0")), folder, number)  # some views come twice
        # the late rows among views sent twice count once: they are one event
        state.split_late(_stream(spark, folder, schema).dropDuplicates(["event_id"]), "ts", "2 DAYS", sink, kept).awaitTermination()
        on_time = spark.readStream.schema(schema).parquet(f"{sink}/rows/*/is_late=false")
        both = state.answered(on_time.filter("event_type = 'view'").select("user_id", F.col("ts").alias("response_ts")), on_time.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("analysis_ts")), ["user_id"], "2 days", "6 HOURS")
        both.writeStream.format("parquet").option("path", pairs).option("checkpointLocation", pair_state).trigger(availableNow=True).start().awaitTermination()
    late = spark.read.schema(schema + ", is_late boolean").parquet(f"{sink}/rows").filter("is_late").groupBy("user_id").agg(recon.one("late"))
    found = spark.read.schema("user_id long, response_ts timestamp, analysis_ts timestamp").parquet(pairs).groupBy("user_id").agg(recon.one("pairs"))
    return found.join(late, "user_id", "full").select("user_id", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("late", F.lit(0)).alias("late"))


_TURNS, _LIMIT = 4, 5


@query(f"""WITH e AS (SELECT *, user_id % 6 AS model, event_id * {_TURNS} // (SELECT max(event_id) + 1 FROM events) AS batch FROM events),
g AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY model ORDER BY batch, ts, event_id) AS g FROM e),
r AS (SELECT *, CASE WHEN event_type = 'error' THEN count(*) FILTER (event_type = 'error') OVER (PARTITION BY model, g ORDER BY batch, ts, event_id) ELSE 0 END AS run FROM g)
SELECT batch, model, count(*) AS n, max(run) AS longest FROM r WHERE batch <= coalesce((SELECT min(batch) FROM r WHERE run >= {_LIMIT}), {_TURNS}) GROUP BY 1, 2""")
def error_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Section 2.12: batches of events go by until one reports five errors of a model in a row; what comes later isn't processed."""
    e = table(spark, d, "events")
    dealt = e.crossJoin(F.broadcast(e.agg((F.max("event_id") + 1).alias("end")))).select(F.expr("user_id % 6").alias("model"), "ts", "event_id", "event_type", F.floor(F.col("event_id") * _TURNS / F.col("end")).alias("batch"))
    folder, sink, kept = (scratch_path(spark, x) for x in ("breaker-in", "breaker-out", "breaker-state"))
    breaker = state.Breaker("breaker", _LIMIT)
    spark.streams.addListener(breaker)
    try:
        for number in range(_TURNS):
            _arrives(dealt.filter(F.col("batch") == number).drop("batch"), folder, number)
            runs = state.error_runs(_stream(spark, folder, "model long, ts timestamp, event_id long, event_type string"), "model", "ts", "event_id", F.col("event_type") == "error")
            write = lambda rows, n: rows.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{sink}/batch_id={n}")
            state.guarded(runs, breaker, write, kept).awaitTermination()
            breaker.wait_for(number)
            if breaker.tripped is not None:
                break
    finally:
        spark.streams.removeListener(breaker)
    return spark.read.schema("model long, n long, longest long, batch long").option("recursiveFileLookup", "true").parquet(sink)
