"""Streams that keep state by key: the work list, late and replaced rows, and the breaker on runs of errors."""

from __future__ import annotations

import pickle
import sys
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Parts that a work list's keys are dealt to.
PARTS = 1 << 10
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application, with the caller's settings, whose streams keep state in RocksDB; the caller's stay as they are."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


# -- work list ---------------------------------------------------------------------------------------------------------


def _newer(row: tuple, known: tuple | None) -> bool:
    """By time, then value; nulls come last, as in a window's order that puts them there."""
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    return known is None or order(row) > order(known)


def _plain(column: pd.Series) -> list:
    return column.astype(object).where(column.notna(), None).tolist()


def _as_text(key: str, kind: T.DataType) -> Column:
    """A key as pandas keeps it whole beside nulls: numbers and dates as their text, which casts back to them."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (F.col(key) + F.lit(0.0)).cast("string").alias(key)
    return F.col(key).cast("string").alias(key) if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType)) else F.col(key)


def stateful_work_list(stream: DataFrame, keys: list[str], fits: Callable[[str, str], bool], *, late: str = "", grace_ms: int = 0, parts: int = PARTS) -> DataFrame:
    """Section 2.12: keys, response_ts and reason ('missing', 'stale', 'unfit', '' when settled) as work becomes due.

    `stream` has the keys (of atomic types), kind ('response' or 'analysis'), ts and value: a response's status or an
    analysis's label.  State is the newest response and analysis and what was told last for each key, whatever the number
    of rows; a key's rows of a micro-batch may come in any order.  With a grace, `late` is the watermark, and a response
    without a fitting analysis is due only when the watermark has passed its time by that much.

    Keys are dealt to `parts` parts by hash.  A part is one group to Spark: a micro-batch makes a call, and writes a state,
    for each part that it touches, not for each key, and a part's keys are held in memory meanwhile.  The number belongs to
    the checkpoint.
    """

    def reason(response: tuple, analysis: tuple | None) -> str:
        if analysis is None:
            return "missing"
        if response[0] > analysis[0]:
            return "stale"
        return "" if fits(response[1], analysis[1]) else "unfit"

    def step(_: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        # by key: newest response, newest analysis, what was told, and the time from which a response is due
        known: dict[tuple, list] = pickle.loads(kept.get[0]) if kept.exists else {}
        touched = {}
        if not kept.hasTimedOut:
            for frame in frames:
                for *key, kind, us, value in zip(*(_plain(frame[c]) for c in (*keys, "kind", "us", "value")), strict=True):
                    key = tuple(key)
                    one = touched[key] = known.setdefault(key, [None, None, None, None])
                    row = (None if us is None else int(us), value if value is None else sys.intern(value))
                    at = 0 if kind == "response" else 1
                    if _newer(row, one[at]):
                        one[at] = row
                        if grace_ms and not at:
                            one[3] = row[0] // 1000 + grace_ms
        expired = set()
        if grace_ms:
            mark = kept.getCurrentWatermarkMs()
            expired = {key for key, one in known.items() if one[3] is not None and one[3] <= mark}
        told = []
        for key in (*touched, *(expired - touched.keys())):
            one = known[key]
            response, analysis, before, _ = one
            if key in expired:
                one[3] = None
            if response is not None and (key in expired or not grace_ms or before):
                now = (response[0], reason(response, analysis))
                if now != before and (now[1] or before):
                    one[2] = now
                    told.append((*key, *now))
        if told:
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip((*keys, "response_us", "reason"), zip(*told, strict=True), strict=True)})
        kept.update((pickle.dumps(known, pickle.HIGHEST_PROTOCOL),))
        timers = [one[3] for one in known.values() if one[3] is not None]
        if timers:
            kept.setTimeoutTimestamp(min(timers))

    kinds = {k: stream.schema[k].dataType for k in keys}
    source = stream.withWatermark("ts", late) if grace_ms else stream
    rows = source.select(*[_as_text(k, t) for k, t in kinds.items()], "kind", *["ts"] * bool(grace_ms), F.unix_micros("ts").alias("us"), "value")
    grouped = rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts))).groupBy("_part")
    result = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in keys], T.StructField("response_us", T.LongType()), T.StructField("reason", T.StringType())])
    told = grouped.applyInPandasWithState(step, result, "known binary", "append" if grace_ms else "update", GroupStateTimeout.EventTimeTimeout if grace_ms else GroupStateTimeout.NoTimeout)
    return told.select(*[F.col(k).cast(t).alias(k) for k, t in kinds.items()], F.timestamp_micros("response_us").alias("response_ts"), "reason")


def work_now(told: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The work that is due now: the last word on each key in what the stream has written."""
    last = told.groupBy(*keys).agg(F.max_by(F.struct("response_ts", "reason"), order).alias("_l"))
    return last.filter(F.col("_l.reason") != "").select(*keys, "_l.response_ts", "_l.reason")


# -- late and replaced rows --------------------------------------------------------------------------------------------


def split_late(source: DataFrame, ts: str, late: str, sink: str, state: str, once: bool = True) -> StreamingQuery:
    """Write each micro-batch's rows to `sink`/on_time or, where they are not newer than the watermark, to `sink`/late.

    The watermark of a batch is the newest time of all batches before it less the delay; each batch writes its newest
    time to `sink`/marks, so that a batch that is run again finds the same watermark.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/marks")
        known = None
        if number and there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            known = spark.read.schema("mark timestamp, batch long").parquet(f"{sink}/marks").filter(F.col("batch") < number).agg((F.max("mark") - F.expr(f"INTERVAL {late}")).alias("w")).first()["w"]
        is_late = F.coalesce(F.col(ts) <= F.lit(known), F.lit(False)) if known else F.lit(False)
        batch.select("*", is_late.alias("is_late"), F.lit(number).cast("long").alias("arrived")).write.mode("overwrite").partitionBy("is_late").parquet(f"{sink}/rows/batch_id={number}")
        batch.agg(F.max(ts).alias("mark"), F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{sink}/marks/batch_id={number}")

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def answered(responses: DataFrame, analyses: DataFrame, keys: list[str], late: str, within: str) -> DataFrame:
    """Section 2.12: each response with the analyses made `within` its time, both sides streams with a watermark.

    responses have keys and response_ts, analyses keys and analysis_ts.  A response that is sent again within the
    watermark is one; state of either side goes when the watermark has passed what it could still meet.
    """
    first = responses.withWatermark("response_ts", late).dropDuplicatesWithinWatermark([*keys, "response_ts"])
    second = analyses.withWatermark("analysis_ts", late).select(*[F.col(k).alias(f"_{k}") for k in keys], "analysis_ts")
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    near = F.expr(f"analysis_ts >= response_ts AND analysis_ts <= response_ts + INTERVAL {within}")
    on = near
    for s in same:
        on = on & s
    return first.join(second, on).drop(*[f"_{k}" for k in keys])


# -- breaker -----------------------------------------------------------------------------------------------------------


def error_runs(stream: DataFrame, key: str, ts: str, tie: str, error: Column) -> DataFrame:
    """key, n, longest: after each micro-batch, the longest run of errors of each key of the batch, runs before it counted on.

    State is the length of a key's current run.  A key's rows of one micro-batch are sorted in memory (null times last);
    the source's limit of files or bytes a trigger bounds them.
    """

    def step(of: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["us", "tie"], kind="stable")
        bad = rows["error"].to_numpy(bool)
        at = np.arange(len(bad))
        last_good = np.maximum.accumulate(np.where(bad, -1 - (kept.get[0] if kept.exists else 0), at))
        run = np.where(bad, at - last_good, 0)
        kept.update((int(run[-1]),))
        yield pd.DataFrame({key: pd.Series([of[0]], dtype=object), "n": [len(bad)], "longest": [int(run.max())]})

    result = T.StructType([stream.schema[key], T.StructField("n", T.LongType()), T.StructField("longest", T.LongType())])
    rows = stream.select(key, F.unix_micros(ts).alias("us"), F.col(tie).alias("tie"), F.coalesce(error, F.lit(False)).alias("error"))
    return rows.groupBy(key).applyInPandasWithState(step, result, "run long", "update", GroupStateTimeout.NoTimeout)


class Breaker(StreamingQueryListener):
    """Stops a query when a batch reports a run of `limit` errors, before it goes on to the next.

    The query reports by `observe(name, ...)` with a metric `longest`.  The listener hears of a batch after it has ended
    and while the next may have begun; so the next batch's sink asks `open_for` first, which waits for the report.
    """

    def __init__(self, name: str, limit: int, patience: float = 60.0) -> None:
        self.name, self.limit, self.patience = name, limit, patience
        self.tripped: int | None = None
        self.heard: dict[int, int] = {}
        self._news = threading.Condition()

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        metrics = event.progress.observedMetrics.get(self.name)
        if metrics is None:
            return
        with self._news:
            self.heard[event.progress.batchId] = metrics.longest or 0
            if (metrics.longest or 0) >= self.limit and self.tripped is None:
                self.tripped = event.progress.batchId
            self._news.notify_all()

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        with self._news:
            self._news.notify_all()

    def wait_for(self, batch: int) -> None:
        """Until the report of a batch that this listener has seen starting has come."""
        with self._news:
            if not self._news.wait_for(lambda: batch in self.heard, self.patience):
                raise TimeoutError(f"no report of batch {batch}")

    def open_for(self, batch: int, first: int) -> bool:
        if batch > first:
            self.wait_for(batch - 1)
        return self.tripped is None


def guarded(runs: DataFrame, breaker: Breaker, write: Callable[[DataFrame, int], None], state: str, *, once: bool = True) -> StreamingQuery:
    """Start a query over `error_runs` that `breaker` (added to the session's streams) stops.

    `write` gets each batch before the breaker has tripped, and none after it.
    """
    began: list[int] = []

    def step(batch: DataFrame, number: int) -> None:
        began.append(number)
        if not breaker.open_for(number, began[0]):
            raise RuntimeError(f"stopped: {breaker.limit} errors in a row in batch {breaker.tripped}")
        write(batch, number)

    observed = runs.observe(breaker.name, F.max("longest").alias("longest"))
    writer = observed.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
