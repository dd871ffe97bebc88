"""JSON lines as a Spark data source: read by byte ranges with line numbers, replaced as a whole or not at all."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "jsonl_numbered"
RANGE_BYTES = 64 << 20
SCHEMA = "file string, start long, n long, offset long, line string"


def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class NumberedReader(DataSourceReader):
    """A line belongs to the range in which it begins, so ranges are read apart and no line is read twice or lost."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = _plain(path), size

    def partitions(self) -> list[ByteRange]:
        files = [self.path] if os.path.isfile(self.path) else sorted(e.path for e in os.scandir(self.path) if e.is_file() and e.name[0] not in "._")
        return [ByteRange(f, lo, min(lo + self.size, n)) for f in files for n in [os.path.getsize(f)] for lo in range(0, n, self.size)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        with open(partition.file, "rb") as source:
            at = partition.start
            if at:
                source.seek(at - 1)
                at += len(source.readline()) - 1
            n = 0
            while at < partition.end:
                line = source.readline()
                if not line:
                    return
                yield partition.file, partition.start, n, at, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                at, n = at + len(line), n + 1


class NumberedWriter(DataSourceWriter):
    """Tasks write beside the target; the commit puts the whole in its place under a lock, and an abort leaves nothing."""

    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.overwrite = _plain(path).rstrip("/"), overwrite
        self.column = schema.fieldNames().index("line")
        self.staged = f"{self.path}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        os.makedirs(self.staged, exist_ok=True)
        name, rows = f"part-{uuid.uuid4().hex}.jsonl", 0
        with open(f"{self.staged}/{name}", "w", encoding="utf-8", newline="\n") as sink:
            for row in iterator:
                line = row[self.column]
                if line is None or "\n" in line:
                    raise ValueError("a line is null or holds a line break")
                sink.write(line + "\n")
                rows += 1
            sink.flush()
            os.fsync(sink.fileno())
        return Part(name, rows)

    def commit(self, messages: list) -> None:
        os.makedirs(self.staged, exist_ok=True)
        lock = f"{self.path}.lock"
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            self.abort(messages)
            raise RuntimeError(f"{self.path} is being replaced by another writer; remove {lock} if none is at work") from None
        try:
            kept = {m.name for m in messages if m is not None}
            for name in os.listdir(self.staged):  # of attempts that failed
                if name not in kept:
                    os.remove(f"{self.staged}/{name}")
            old = f"{self.path}.old-{uuid.uuid4().hex}"
            there = os.path.exists(self.path)
            if there and not self.overwrite:
                for name in kept:
                    os.replace(f"{self.staged}/{name}", f"{self.path}/{name}")
                os.rmdir(self.staged)
                return
            if there:
                os.replace(self.path, old)
            os.replace(self.staged, self.path)
            shutil.rmtree(old, ignore_errors=True)
        finally:
            os.remove(lock)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


class NumberedSource(DataSource):
    """Options: path, and range_bytes for reading.  The path is a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NumberedReader:
        return NumberedReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> NumberedWriter:
        return NumberedWriter(self.options["path"], schema, overwrite)


def read_numbered(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """File, line_number from 1, line of every line under a path.

    Ranges number their own lines; the lines of the ranges before are counted and added.
    """
    spark.dataSource.register(NumberedSource)
    lines = spark.read.format(NAME).option("range_bytes", range_bytes).load(path)
    counts = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(counts.select("file", "start", before.alias("_before")), ["file", "start"]).select("file", (F.col("_before") + F.col("n") + 1).alias("line_number"), "line")


def replace_lines(lines: DataFrame, path: str) -> None:
    """The rows' `line` as files under the path, which holds either all of them or what it held before."""
    lines.sparkSession.dataSource.register(NumberedSource)
    lines.select("line").write.format(NAME).mode("overwrite").option("path", path).save()


def malformed(lines: DataFrame) -> DataFrame:
    """Lines of read_numbered that aren't blank and aren't JSON."""
    return lines.filter((F.trim("line") != "") & F.try_parse_json("line").isNull())
