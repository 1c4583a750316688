"""Writers of rows, reports and summaries. They refuse to write over what is there unless told to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str], overwrite: bool = False) -> None:
    """A summary of bounded size as one file."""
    rows.select(*columns).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def _document(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with a struct for each one-row frame."""
    return reduce(DataFrame.crossJoin, (part.select(F.struct("*").alias(name)) for name, part in parts.items()))


def report(**parts: DataFrame) -> DataFrame:
    """One JSON document of one-row frames."""
    return _document(parts).select(F.to_json(F.struct(*parts)).alias("report"))


def write_report(path: str, overwrite: bool = False, **parts: DataFrame) -> None:
    """One JSON document of one-row frames as a file, indented, with its nulls."""
    pretty = _document(parts).select(F.to_json(F.struct(*parts), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    pretty.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def text_report(rows: DataFrame, template: str, columns: list[str], name: str = "value") -> DataFrame:
    """A line of text for each row of a summary, by a template as of ``printf``."""
    return rows.select(F.format_string(template, *columns).alias(name))


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key is not yet in the output."""
    return work.join(done.select(key), key, "left_anti")


def resumed(work: DataFrame, done: DataFrame, index: str, prompt: str) -> DataFrame:
    """Work that is left after an interrupted run. Refuses, at once, an output that is not a beginning of this work: one whose index is not in it, whose prompt at an
    index differs, or that leaves out an index before its last."""
    last = done.agg(F.coalesce(F.max(index), F.lit(-1)).alias("_last"))
    own = done.select(index, F.col(prompt).alias("_done"), F.lit(1).alias("_there"))
    both = work.join(own, index, "full").join(F.broadcast(last))
    there = F.col("_there").isNotNull()
    wrong = F.when(there & F.col(prompt).isNull(), "is not in the work").when(there & (F.col("_done") != F.col(prompt)), "has another prompt").when(~there & (F.col(index) <= F.col("_last")), "is missing")
    bad = both.select(index, wrong.alias("_wrong")).where("_wrong is not null").orderBy(index).first()
    if bad:
        raise ValueError(f"the output at {bad[0]} {bad[1]}")
    return remaining(work, done, index)
