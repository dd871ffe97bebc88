"""Following a growing set of responses with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.scratch import scratch_path


def work_list(batch: DataFrame, done: DataFrame, keys: list[str], ts: str, matches: Column | None = None) -> DataFrame:
    """Section 2.12, F2: responses without an analysis, with a stale one, or with one that doesn't fit their state.

    done has the keys and `analysed_at`, which the result has too; matches, if given, is true where an analysis fits.
    """
    newest = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))).filter("_r = 1").drop("_r")
    both = newest.join(done.groupBy(*keys).agg(F.max("analysed_at").alias("analysed_at")), keys, "left")
    todo = F.col("analysed_at").isNull() | (F.col("analysed_at") < F.col(ts))
    if matches is not None:
        todo = todo | ~F.coalesce(matches, F.lit(False))
    return both.filter(todo)


def follow(source: DataFrame, sink: str, judge: Callable[[DataFrame], DataFrame], keys: list[str], ts: str, state: str, once: bool = True) -> StreamingQuery:
    """Judge what is new in each micro-batch and append it to a Parquet sink.

    A batch that is run again after a failure finds its own rows in the sink, or writes the same batch folder again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(sink)
        fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
        todo = batch
        if fs.exists(there) and number:
            done = spark.read.parquet(sink).filter(F.col("batch") < number)
            todo = work_list(batch, done, keys, ts).drop("analysed_at")
        judge(todo).withColumn("analysed_at", F.col(ts)).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{sink}/batch_id={number}")

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def windowed_counts(stream: DataFrame, ts: str, window: str, late: str, *keys: str) -> DataFrame:
    """Extension: counts in tumbling event-time windows, late rows allowed up to a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(F.count(F.lit(1)).alias("n"))


def follow_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The follow loop's final pass over the events table: every user's labelled events, judged once."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    plain = spark.read.parquet(path)
    whole = len(plain.inputFiles()) == 1 and plain.inputFiles()[0].endswith("/events.parquet")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if whole else "*.parquet").parquet(folder if whole else path)
    sink, state = scratch_path(spark, "follow-sink"), scratch_path(spark, "follow-state")
    judge = lambda rows: rows.withColumn("label", F.when(F.col("event_type") == "error", "ERROR").when(F.col("value") > 20, "COMPLETE").otherwise("EVASIVE"))
    follow(stream, sink, judge, ["event_id"], "ts", state).awaitTermination()
    return spark.read.parquet(sink).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
