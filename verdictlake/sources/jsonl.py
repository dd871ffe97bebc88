"""JSON-lines scans and sinks, key policies, discovery of files and whole-file checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

BAD = "_bad"
#: Blocks of files whose first lines' numbers are broadcast.
BROADCAST_BLOCKS = 100_000


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) is not None and len(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)) > 0


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, required: Sequence[str] = (), with_position: bool = False) -> DataFrame:
    """Lines as rows; blank and malformed lines and rows without a required field are left out, unknown fields too.

    A missing path gives an empty table.  with_position adds _file and _line, the line's number in its file, for policies
    that need an order; blocks of files are counted first, and lines are then numbered without a shuffle of the rows.
    """
    paths = [path] if isinstance(path, str) else path
    there = [p for p in paths if _exists(spark, p)]
    fields = T._parse_datatype_string(schema)
    if not there:
        extra = [T.StructField("_file", T.StringType()), T.StructField("_line", T.LongType())] if with_position else []
        return spark.createDataFrame([], T.StructType([*fields.fields, *extra]))
    lines = read_lines(spark, there)
    parsed = lines.filter(F.trim("value") != "").withColumn("_row", F.from_json("value", T.StructType([*fields.fields, T.StructField(BAD, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    good = parsed.filter(F.col("_row").isNotNull() & F.col(f"_row.{BAD}").isNull())
    for name in required:
        good = good.filter(F.col(f"_row.{name}").isNotNull())
    columns = [F.col(f"_row.{f.name}").alias(f.name) for f in fields.fields]
    return good.select(*columns, *(["_file", "_line"] if with_position else []))


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """value, _file, _line: each file's lines numbered from 1.

    Files are numbered in parallel; the lines of one file are counted in blocks, so that a single large file isn't one task.
    """
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    first = text.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = first.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = written(offsets, "line-offsets")  # a row for each block that a task reads
    return text.join(F.broadcast(offsets) if offsets.count() <= BROADCAST_BLOCKS else offsets, ["_file", "_block"]).select("value", "_file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("_line"))


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """File and line of every line that isn't JSON."""
    return read_lines(spark, [path]).filter((F.trim("value") != "") & F.expr("try_parse_json(value)").isNull()).select("_file", "_line")


def assert_decodes(spark: SparkSession, path: str) -> None:
    bad = malformed_lines(spark, path).orderBy("_file", "_line").limit(20).collect()
    if bad:
        raise ValueError("malformed lines: " + ", ".join(f"{r['_file']}:{r['_line']}" for r in bad))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Null fields are left out; overwriting replaces the folder when the job commits."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "true").json(path)


def load(df: DataFrame, keys: Sequence[str], policy: str, order: Sequence[str] = ("_file", "_line"), timestamp: str = "timestamp") -> DataFrame:
    """S3, S6 and the four policies for equal keys: last, first, latest, error.  Rows without a key are left out.

    latest takes the greatest timestamp as text, the first of equal ones, and reports the line of the key's first row.
    """
    for k in keys:
        df = df.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    if policy == "error":
        twice = duplicates(df, keys).limit(5).collect()
        if twice:
            raise ValueError(f"duplicate keys: {[tuple(r[k] for k in keys) for r in twice]}")
        return df
    by = Window.partitionBy(*keys)
    if policy == "latest":
        if "_line" in df.columns:
            df = df.withColumn("_line_first", F.min("_line").over(by))
        ordered = by.orderBy(F.col(timestamp).desc_nulls_last(), *order)
    elif policy in ("first", "last"):
        ordered = by.orderBy(*[F.desc(c) if policy == "last" else F.asc(c) for c in order])
    else:
        raise ValueError(policy)
    out = df.withColumn("_r", F.row_number().over(ordered)).filter("_r = 1").drop("_r")
    return out.withColumn("_line", F.col("_line_first")).drop("_line_first") if "_line_first" in out.columns else out


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def scan_with_reasons(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that no rule rejects, and how many each rule rejected; a row counts for the first rule that does."""
    reason = F.lit(None).cast("string")
    for name, rejects in reversed(rules):
        reason = F.when(F.coalesce(rejects, F.lit(False)), name).otherwise(reason)
    tagged = df.withColumn("_reason", reason)
    counts = tagged.filter(F.col("_reason").isNotNull()).groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return tagged.filter(F.col("_reason").isNull()).drop("_reason"), counts


def fetch(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows at wanted (_file, _line) places."""
    return lines.join(wanted.select("_file", "_line").distinct(), ["_file", "_line"], "left_semi")


def infer_question_set(files: DataFrame, sets: DataFrame) -> DataFrame:
    """File to the question set with the longest stem that its name starts with; files (file, name), sets (stem)."""
    best = Window.partitionBy("file").orderBy(F.length("stem").desc(), "stem")
    # sets has a row for each question file of a project; the join is by prefix, so the small side is sent if it is small
    return files.join(sets, F.startswith(F.col("name"), F.col("stem"))).withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def response_files(files: DataFrame, name: str = "name") -> DataFrame:
    """Files that aren't quarantine sidecars."""
    return files.filter(~F.lower(name).contains("quarantine"))


def quarantine_counts(rows: DataFrame) -> DataFrame:
    """Rows of quarantine sidecars by file and status; rows has _file and response_status."""
    return rows.filter(F.lower("_file").contains("quarantine")).groupBy("_file", "response_status").agg(F.count(F.lit(1)).alias("n"))


def artifact_policy(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Each path's decision and tag by the first rule, in order, whose pattern it matches; else include."""
    first = Window.partitionBy("path").orderBy("ordinal")
    hit = files.join(rules, F.rlike("path", F.col("pattern"))).withColumn("r", F.row_number().over(first)).filter("r = 1").select("path", "decision", "tag")
    return files.join(hit, "path", "left").withColumn("decision", F.coalesce("decision", F.lit("include")))


def write_csv(df: DataFrame, path: str) -> None:
    """S13."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def good_files(rows: DataFrame, expected_rows: int, label: str = "compliance") -> DataFrame:
    """Rows of files with exactly the expected rows, none of them an error or malformed (rows has _file)."""
    ok = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col(label).startswith("ERROR"), F.lit(True))).alias("bad")).filter((F.col("n") == expected_rows) & ~F.col("bad"))
    return rows.join(ok.select("_file"), "_file", "left_semi")


def survey_problems(surveys: DataFrame) -> DataFrame:
    """Survey name and problem: empty range, labels outside the range, item ids that repeat."""
    low, high = F.col("scale.min"), F.col("scale.max")
    ids = F.transform("items", lambda i: i["id"])
    problems = F.array(
        F.when(~(low < high), "empty range"),
        F.when(F.exists(F.map_keys("scale.labels"), lambda k: ~F.coalesce(F.try_to_number(k, F.lit("S999999")).between(low, high), F.lit(False))), "label outside range"),
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated item id"),
    )
    return surveys.select("name", F.explode(F.array_compact(problems)).alias("problem"))


def resolve_model(catalog: DataFrame, name: Column, provider: Column | None = None) -> DataFrame:
    """The provider entry of a model: the named provider's, else the one of highest priority."""
    entries = catalog.filter(F.col("canonical_name") == name).select("canonical_name", F.explode("providers").alias("p"))
    if provider is not None:
        entries = entries.filter(F.col("p.provider_name") == provider)
    return entries.groupBy("canonical_name").agg(F.max_by("p", F.struct(F.col("p.priority"), F.col("p.provider_name"))).alias("p")).select("canonical_name", "p.*")


def uncached(work: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose md5 key isn't in the cache table yet, with the key."""
    key = F.md5(F.concat_ws(":", *[F.col(k) for k in keys]))
    return work.withColumn("cache_key", key).join(cache.select("cache_key"), "cache_key", "left_anti")


def in_former_order(rows: DataFrame, former: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows in the order of former ones, new keys after them in their own order."""
    place = former.select(key, F.col(ordinal).alias("_former"))
    return rows.join(place, key, "left").orderBy(F.col("_former").asc_nulls_last(), ordinal).drop("_former")


def restored(current: DataFrame, original: DataFrame, key: str) -> DataFrame:
    """Current rows and the original ones that are missing from them."""
    return current.unionByName(original.join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def metric_total(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sum of Prometheus samples by name; a `_total` at the end doesn't count."""
    bare = F.regexp_replace(F.regexp_extract("value", r"^([A-Za-z_:][A-Za-z0-9_:]*)", 1), "_total$", "")
    number = F.regexp_extract("value", r"\s([-+0-9.eE]+)(?:\s+\d+)?\s*$", 1)
    return lines.filter(~F.col("value").startswith("#")).select(bare.alias("name"), F.when(number != "", number.cast("double")).alias("v")).filter(F.col("name").isin([n.removesuffix("_total") for n in names])).groupBy("name").agg(F.sum("v").alias("total"))


def timing_segments(rows: DataFrame) -> DataFrame:
    """Rows and seconds of each run's segments."""
    return rows.groupBy("run", "segment").agg(F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"))


def round_trip(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows lost and gained between two tables, on their common columns, and columns only one has."""
    common = [c for c in before.columns if c in after.columns]
    lost = before.select(common).exceptAll(after.select(common)).agg(F.count(F.lit(1)).alias("lost"))
    gained = after.select(common).exceptAll(before.select(common)).agg(F.count(F.lit(1)).alias("gained"))
    only = sorted(set(before.columns) ^ set(after.columns))
    return lost.crossJoin(gained).withColumn("unknown_fields", F.lit(len(only)).cast("long"))


def schema_profile(df: DataFrame, json: str) -> DataFrame:
    """How many rows have each key of a JSON object."""
    return df.select(F.explode(F.json_object_keys(json)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def field_values_of(df: DataFrame, json: str, field: str) -> DataFrame:
    """How often each value of a field stands; [missing], [dict] and [list] stand for such values."""
    value = F.get_json_object(json, f"$.{field}")
    shown = F.when(value.isNull(), "[missing]").when(value.rlike(r"^\s*\{"), "[dict]").when(value.rlike(r"^\s*\["), "[list]").otherwise(value)
    return df.groupBy(shown.alias("value")).agg(F.count(F.lit(1)).alias("n"))
