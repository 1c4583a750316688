"""All counts of a report from one scan: each row gives its keys of every part, and one grouping counts them all.

A part is a name for a column whose values are counted, or for a number that is summed up. Rows are added up in the tasks that read them, so only a row for each different key is shuffled, and
what constraints and reports need afterwards is read from that table.

Defined cases: a null key is a key, unless its part says otherwise; a part without rows has no rows; null numbers are left out; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.session import materialise


def tallies(rows: DataFrame, keys: dict[str, Column], numbers: dict[str, Column] | None = None, seq: str | None = None, only: dict[str, Column] | None = None) -> DataFrame:
    """(part, key, n, first, least, most, total): how often each key of each part occurs and where first (by ``seq``), and of each number, with a null key, how many there are, the
    smallest, the largest and the sum. only: conditions under which a row counts for a part. The result is written, so that many can read it."""
    numbers, only = numbers or {}, only or {}
    none = F.lit(None).cast("double")
    entry = lambda part, key, x: F.struct(F.lit(part).alias("part"), key.cast("string").alias("key"), x.alias("x"))
    counted = [F.when(F.coalesce(only.get(p, F.lit(True)), F.lit(False)), entry(p, c, none)) for p, c in keys.items()]
    summed = [F.when(c.isNotNull() & F.coalesce(only.get(p, F.lit(True)), F.lit(False)), entry(p, F.lit(None), c.cast("double"))) for p, c in numbers.items()]
    each = rows.select(F.explode(F.array_compact(F.array(*counted, *summed))).alias("e"), (F.col(seq) if seq else F.lit(None).cast("long")).alias("seq"))
    found = each.groupBy("e.part", "e.key").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.min("e.x").alias("least"), F.max("e.x").alias("most"), F.sum("e.x").alias("total"))
    return materialise(found, "tallies")


def report_of(tally: DataFrame, shown: int = 1000) -> DataFrame:
    """One row, ``report``: a JSON object with an entry for each part, its number of rows and of different keys and its ``shown`` most frequent keys with their counts, or the count, minimum, maximum and mean of a number."""
    number = F.col("least").isNotNull()
    sums = tally.groupBy("part").agg(F.sum("n").alias("rows"), F.count("*").alias("different"), F.max(number).alias("number"), F.min("least").alias("min"), F.max("most").alias("max"), (F.sum("total") / F.sum("n")).alias("mean"))
    # of each part a few keys stay in each task, before one sees them
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "key", "n"))), 1, shown)
    some = tally.where(~number).withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(16))).groupBy("part", "deal").agg(top.alias("top"))
    some = some.select("part", F.explode("top").alias("t")).select("part", "t.key", "t.n").groupBy("part").agg(top.alias("top"))
    whole = sums.join(some, "part", "left")
    counts = F.map_from_entries(F.transform("top", lambda t: F.struct(F.coalesce(t["key"], F.lit("null")), t["n"])))
    entry = F.when(F.col("number"), F.to_json(F.struct(F.col("rows").alias("n"), "min", "max", "mean"))).otherwise(F.to_json(F.struct("rows", "different", counts.alias("counts"))))
    parts = whole.agg(F.array_sort(F.collect_list(F.concat(F.to_json(F.struct(F.col("part").alias("p"))), F.lit("\x01"), entry))).alias("parts"))
    pair = lambda x: F.concat(F.regexp_replace(F.substring_index(x, "\x01", 1), r'^\{"p":(.*)\}$', "$1"), F.lit(":"), F.substring_index(x, "\x01", -1))
    return parts.select(F.concat(F.lit("{"), F.array_join(F.transform("parts", pair), ","), F.lit("}")).alias("report"))


def written_and_observed(rows: DataFrame, write: Callable[[DataFrame], None], /, **measures: Column) -> dict:
    """Write rows by ``write`` and return aggregates of them that were taken on the way, in the same scan."""
    seen = Observation("written")
    write(rows.observe(seen, *(c.alias(name) for name, c in measures.items())))
    return seen.get
