"""Readers that keep what cannot be parsed, and small formats of logs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import locale_number
from tessera.functions.text import strip
from tessera.session import map_arrow, materialise, ship
from tessera.sources.jsonl import json_lines


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 1 in each file. Lines are numbered within the pieces in which Spark
    reads a file, and the pieces' sums are added, so no task sees a whole file."""
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    lines = materialise(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at")), "lines")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = blocks.select("file", "block", "least", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    return lines.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("least") + 1).alias("line"), "value")


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors): errors has a row (file, line, value, error, reason) for each blank line and each line that is no JSON object; records have
    their keys, file and line, too. Of a repeated key the last one counts, and NaN is a number."""
    text = json_lines(spark, path)
    good = text.where("error is null").select(F.from_json("value", schema).alias("r"), "keys", "file", "line")
    return good.select("r.*", "keys", "file", "line"), text.where("error is not null").select("file", "line", "value", "error", "reason")


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; any other line that is no JSON object fails the read and is named."""
    rows = json_lines(spark, path).where("error is null or error <> 'Empty line'")
    where = F.concat(F.lit("invalid JSON in "), F.col("file"), F.lit(", line "), F.col("line").cast("string"), F.lit(": "), F.col("reason"))
    checked = rows.select(F.when(F.col("error").isNotNull(), F.raise_error(where).cast("string")).otherwise(F.col("value")).alias("value"))
    return checked.select(F.from_json("value", schema).alias("r")).select("r.*")


def plain_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records as Spark reads them: blank lines are skipped, bad ones give nulls."""
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """One row from a file that is one JSON document, with or without a byte order mark."""
    return spark.read.option("multiLine", True).json(path)


def split_sets(spark: SparkSession, paths: dict[str, str], schema: str, label: str = "split") -> DataFrame:
    """The records of several files, each with the name of its part."""
    parts = [plain_jsonl(spark, path, schema).drop(label).withColumn(label, F.lit(name)) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def locale_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """Quoted CSV with a header, in which a quote within quotes is doubled; the named columns have decimal commas or points."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.withColumns({c: locale_number(F.col(c)) for c in numbers})


def process_status(lines: DataFrame) -> DataFrame:
    """(name, kib, mib, gib) of the lines VmRSS and VmHWM."""
    found = lines.where(F.col("value").rlike(r"^Vm(RSS|HWM):"))
    kib = F.regexp_extract("value", r":\s*([0-9]+)", 1).cast("long")
    return found.select(F.regexp_extract("value", r"^(\w+):", 1).alias("name"), kib.alias("kib"), F.round(kib / 1024, 3).alias("mib"), F.round(kib / 1024 / 1024, 3).alias("gib"))


#: The measures of a metric line, in order, and their types.
METRICS = {"prompt_tokens": "int", "generated_tokens": "int", "ttft_ms": "double", "prompt_decode_ms": "double", "generation_ms": "double", "total_ms": "double", "throughput_tok_s": "double", "eog": "string"}


def metric_lines(lines: DataFrame, marker: str = "METRICS ") -> DataFrame:
    """The measures of each line with the marker and all measures; other lines are skipped."""
    values = {name: F.regexp_extract("value", rf"\b{name}=([^ ]+)", 1) for name in METRICS}
    found = lines.where(F.contains("value", F.lit(marker))).select(*(v.alias(k) for k, v in values.items()))
    return found.where(" and ".join(f"{k} != ''" for k in METRICS)).select(*(F.col(k).try_cast(kind).alias(k) for k, kind in METRICS.items()))


def last_value(lines: DataFrame, marker: str, pattern: str, seq: str, by: list[str] | None = None) -> DataFrame:
    """(by, value): the number after ``pattern`` (one group) in the last line with the marker; null if that line lacks it or there is none."""
    own = F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).try_cast("double")
    return lines.groupBy(*(by or [])).agg(F.max_by(own, F.when(F.contains("value", F.lit(marker)), F.col(seq))).alias("value"))


def first_values(lines: DataFrame, names: list[str], seq: str, by: list[str] | None = None) -> DataFrame:
    """(by, names): what follows ``name:`` in the first line that begins with it, trimmed; null without such a line."""
    found = F.regexp_extract("value", r"^\s*([A-Za-z_ ]+?)\s*:", 1)
    own = strip(F.regexp_extract("value", r":(.*)$", 1))
    return lines.groupBy(*(by or [])).agg(*(F.min_by(own, F.when(found == name, F.col(seq))).alias(name) for name in names))


def battery_state(lines: DataFrame, seq: str, by: list[str] | None = None) -> DataFrame:
    """(by, level, temperature_c, status) of a report of a battery, which gives temperatures in tenths of a degree."""
    found = first_values(lines, ["level", "temperature", "status"], seq, by)
    return found.select(*(by or []), F.col("level").try_cast("int").alias("level"), F.round(F.col("temperature").try_cast("double") / 10, 1).alias("temperature_c"), "status")


# The patterns of a thermal state, in the order in which they are tried.
THERMAL = [r"(?i)Thermal Status:\s*(\d+)", r"(?i)mStatus\s*[=:]\s*(\d+)", r"(?i)status\s*[=:]\s*(\d+)"]


def cascade(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that occurs in the text; null if none does."""
    return F.coalesce(*(F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in patterns))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """(step, epoch, loss, eval_loss, learning_rate, grad_norm) of each entry of a trainer's state; entries of training have no eval_loss, and those of evaluation no loss."""
    entry = "step long, epoch double, loss double, eval_loss double, learning_rate double, grad_norm double"
    state = spark.read.option("multiLine", True).schema(f"log_history array<struct<{entry.replace(' long', ':bigint').replace(' double', ':double')}>>").json(path)
    return state.select(F.explode("log_history").alias("e")).select("e.*")


def calendar_range(events: DataFrame, start: Column | None = None, days: int = 90, begin: str = "startMillis") -> DataFrame:
    """The events that begin from ``start`` (milliseconds; now, if none is given) up to ``days`` days later, by their beginning."""
    start = F.unix_millis(F.current_timestamp()) if start is None else start
    return events.where((F.col(begin) >= start) & (F.col(begin) <= start + days * 86_400_000)).select("id", "calendarName", "title", begin, "endMillis", "allDay").orderBy(begin, "id")


#: Bytes of a file beyond which it is not read as one value.
WHOLE_FILE = 64 << 20


def fingerprints(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """(path, bytes, sha256) of files. Larger files than ``whole`` are read in pieces, by tasks that can open them where they lie, so a file may have any size."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        for batch in batches:
            found = []
            for uri in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                digest = hashlib.sha256()
                with system.open_input_stream(place) as stream:
                    while piece := stream.read(8 << 20):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["path", "bytes", "sha256"])

    # the content of these is not asked for, so it is not loaded
    large = files.where(F.col("length") > whole).select("path", F.col("length").alias("bytes"))
    return small.unionByName(large.transform(map_arrow, run, "path string, bytes long, sha256 string"))
