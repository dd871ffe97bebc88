import os
import uuid

import pytest
from pyspark.sql import functions as F

from verdictlake.plans.streams import fits
from verdictlake.streaming import state

WORK = "model string, question long, kind string, ts timestamp, value string"


def at(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def drop(spark, folder, rows, schema, number):
    """One file, later than those before it."""
    out = f"{folder}-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]).coalesce(1).write.parquet(out)
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(out) if f.startswith("part-"))
    os.rename(f"{out}/{part}", f"{folder}/{number:03d}.parquet")
    os.utime(f"{folder}/{number:03d}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))


def told(spark, folder, sink, kept, **how):
    own = state.stateful_session(spark)
    stream = own.readStream.schema(WORK).option("maxFilesPerTrigger", 1).parquet(folder)
    out = state.stateful_work_list(stream, ["model", "question"], fits, **how)
    write = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{sink}/batch_id={n}")
    out.writeStream.outputMode("append" if how else "update").foreachBatch(write).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.batch, r.question, r.response_ts.hour * 60 + r.response_ts.minute, r.reason) for r in spark.read.option("recursiveFileLookup", "true").parquet(sink).collect())


def test_work_list_across_batches_and_a_restart(spark, tmp_path):
    folder, sink, kept = (str(tmp_path / x) for x in ("in", "out", "state"))
    drop(spark, folder, [("m", 1, "response", at(10), "success"), ("m", 2, "response", at(10), "success"), ("m", 2, "analysis", at(20), "DENIAL"), ("m", 3, "analysis", at(5), "DENIAL"), ("m", 4, "response", at(1), "success"), ("m", 4, "analysis", at(2), "ERROR_ORIGINAL_RESPONSE")], WORK, 0)
    first = [(0, 1, 10, "missing"), (0, 4, 1, "unfit")]
    assert told(spark, folder, sink, kept) == first
    # after the restart: 1 is analysed, 2 is replaced (an older copy comes too), 3's response is newer than its analysis
    drop(spark, folder, [("m", 1, "analysis", at(30), "COMPLETE"), ("m", 2, "response", at(40), "success"), ("m", 2, "response", at(9), "moderation"), ("m", 3, "response", at(6), "success"), ("m", 5, "analysis", at(1), "DENIAL")], WORK, 1)
    drop(spark, folder, [("m", 2, "analysis", at(50), "COMPLETE"), ("m", 1, "response", at(10), "success")], WORK, 2)
    assert told(spark, folder, sink, kept) == first + [(1, 1, 10, ""), (1, 2, 40, "stale"), (1, 3, 6, "stale"), (2, 2, 40, "")]
    assert [tuple(r)[:2] for r in state.work_now(spark.read.option("recursiveFileLookup", "true").parquet(sink), ["model", "question"], F.col("batch")).orderBy("question").collect()] == [("m", 3), ("m", 4)]


def test_work_is_due_after_a_grace(spark, tmp_path):
    folder, sink, kept = (str(tmp_path / x) for x in ("in", "out", "state"))
    drop(spark, folder, [("m", 1, "response", at(10), "success"), ("m", 2, "response", at(11), "success")], WORK, 0)
    drop(spark, folder, [("m", 2, "analysis", at(12), "DENIAL"), ("m", 9, "response", at(200), "success")], WORK, 1)
    drop(spark, folder, [("m", 9, "response", at(400), "success")], WORK, 2)
    got = told(spark, folder, sink, kept, late="1 minute", grace_ms=30 * 60_000)
    assert [x[1:] for x in got] == [(1, 10, "missing")]  # 2 was analysed in time, 9 is not yet due


def test_late_rows_are_set_aside_and_pairs_found_once(spark, tmp_path):
    folder, sink, kept, pairs, pair_state = (str(tmp_path / x) for x in ("in", "out", "state", "pairs", "pair_state"))
    schema = "id long, kind string, ts timestamp"
    batches = [[(1, "r", at(100)), (1, "r", at(100)), (1, "a", at(110)), (2, "r", at(100))], [(2, "a", at(130)), (1, "r", at(100)), (3, "a", at(20)), (4, "r", at(300))], [(5, "r", at(150)), (4, "a", at(310)), (6, "a", at(250))]]
    own = state.stateful_session(spark)
    for n, rows in enumerate(batches):
        drop(spark, folder, rows, schema, n)
        state.split_late(own.readStream.schema(schema).parquet(folder), "ts", "1 HOUR", sink, kept).awaitTermination()
        on_time = own.readStream.schema(schema).parquet(f"{sink}/rows/*/is_late=false")
        both = state.answered(on_time.filter("kind = 'r'").select("id", F.col("ts").alias("response_ts")), on_time.filter("kind = 'a'").select("id", F.col("ts").alias("analysis_ts")), ["id"], "1 hour", "1 HOUR")
        both.writeStream.format("parquet").option("path", pairs).option("checkpointLocation", pair_state).trigger(availableNow=True).start().awaitTermination()
    late = [(r.id, r.arrived) for r in spark.read.parquet(f"{sink}/rows").filter(F.col("is_late").cast("boolean")).orderBy("id").collect()]
    assert late == [(3, 1), (5, 2)]  # at 20 with the watermark at 50, at 150 with the watermark at 240
    assert sorted(r.id for r in spark.read.schema("id long").parquet(pairs).collect()) == [1, 2, 4]


@pytest.mark.parametrize(("limit", "batches"), [(3, 2), (9, 4)])
def test_breaker_stops_the_query_in_the_batch_that_trips_it(spark, tmp_path, limit, batches):
    folder, sink, kept = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "model string, ts timestamp, id long, ok string"
    runs = ["+-+", "--+", "+++", "---"]  # the run of b0 goes on into b1: one, then three
    for n, marks in enumerate(runs):
        drop(spark, folder, [("x", at(10 * n + i), i, m) for i, m in enumerate(marks[::-1] if n == 0 else marks)] + [("y", at(10 * n), 0, "+")], schema, n)
    drop(spark, folder, [("x", at(0), 0, "-"), ("x", at(1), 1, "-"), ("y", at(0), 0, "+")], schema, 0)
    own = state.stateful_session(spark)
    breaker = state.Breaker("b", limit)
    own.streams.addListener(breaker)
    try:
        stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        seen = []
        query = state.guarded(state.error_runs(stream, "model", "ts", "id", F.col("ok") == "-"), breaker, lambda rows, n: seen.append((n, {r.model: r.longest for r in rows.collect()})), kept)
        if limit == 3:
            with pytest.raises(Exception, match="errors in a row in batch 1"):
                query.awaitTermination()
            assert breaker.tripped == 1
        else:
            query.awaitTermination()
            assert breaker.tripped is None
    finally:
        own.streams.removeListener(breaker)
    assert [n for n, _ in seen] == list(range(batches))
    assert [x["x"] for _, x in seen] == [2, 4, 0, 3][:batches] and all(x["y"] == 0 for _, x in seen)


@pytest.mark.parametrize("name", ["error_breaker", "late_and_replaced", "stateful_worklist"])
def test_stateful_queries_hold_to_the_callers_settings(spark, data, name):
    """Tables may lie where only the caller's session finds them, and the state store is the caller's choice."""
    from verdictlake.plans.registry import QUERIES

    store, key = f"store{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    link = f"fs.viewfs.mounttable.{store}.link./in"
    kept = spark.conf.get(key)
    spark.conf.set(link, f"file://{data}")
    try:
        there = QUERIES[name](spark, f"viewfs://{store}/in")
        assert sorted(map(tuple, there.collect())) == sorted(map(tuple, QUERIES[name](spark, data).collect()))
        assert spark.conf.get(key) == kept
    finally:
        spark.conf.unset(link)


def test_runs_with_null_times_and_keys(spark, tmp_path):
    folder, sink, kept = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "model string, ts timestamp, id long, ok string"
    drop(spark, folder, [(None, None, 1, "-"), (None, at(5), 0, "-"), ("x", None, 2, "+"), ("x", at(1), 1, "-")], schema, 0)
    drop(spark, folder, [(None, at(1), 3, "-"), ("x", at(1), 3, "-")], schema, 1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    runs = state.error_runs(stream, "model", "ts", "id", F.col("ok") == "-")
    runs.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.withColumn("b", F.lit(n)).write.parquet(f"{sink}/{n}")).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(sink).collect()
    assert {(r.b, r.model, r.n, r.longest) for r in got} == {(0, None, 2, 2), (0, "x", 2, 1), (1, None, 1, 3), (1, "x", 1, 1)}


def test_a_work_list_keeps_state_by_part_not_by_key(spark, tmp_path):
    """Thousands of keys, large numbers and nulls among them: few groups, and what a plain fold over the rows tells."""
    folder, sink, kept = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "model string, question long, share double, kind string, ts timestamp, value string"
    key = lambda i: (None if i % 7 == 0 else f"m{i % 7}", None if i % 501 == 0 else (1 << 60) + i, float("nan") if i % 5 == 0 else None if i % 5 == 1 else i / 3)
    first = [(*key(i), "response", at(i % 1000), ("success", "moderation", "provider_error")[i % 3]) for i in range(4000)]
    first += [(*key(i), "analysis", at((i * 7) % 1000), "COMPLETE" if i % 2 else "ERROR_ORIGINAL_RESPONSE") for i in range(0, 4000, 3)]
    second = [(*key(i), "analysis", at(1001), "COMPLETE" if i % 3 else "ERROR_ORIGINAL_RESPONSE") for i in range(0, 4000, 2)]
    for n, rows in enumerate((first, second)):
        drop(spark, folder, rows, schema, n)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    write = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{sink}/batch_id={n}")
    query = state.stateful_work_list(stream, ["model", "question", "share"], fits).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", kept).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 1024
    told, newest, want = {}, {}, []
    for n, rows in enumerate((first, second)):
        for *k, kind, ts, value in rows:
            k = tuple(map(str, k))
            newest.setdefault(k, {})[kind] = max((ts, value), newest.setdefault(k, {}).get(kind, ("", "")))
        for k in {tuple(map(str, r[:3])) for r in rows}:
            response, analysis = newest[k].get("response"), newest[k].get("analysis")
            why = "missing" if analysis is None else "stale" if response[0] > analysis[0] else "" if fits(response[1], analysis[1]) else "unfit"
            now = (response[0], why)
            if now != told.get(k) and (why or k in told):
                told[k] = now
                want.append((n, *k, *now))
    got = spark.read.option("recursiveFileLookup", "true").parquet(sink).collect()
    assert len(want) > 4000
    assert sorted((r.batch, str(r.model), str(r.question), str(r.share), str(r.response_ts), r.reason) for r in got) == sorted(want)
