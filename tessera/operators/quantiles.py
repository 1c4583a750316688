"""Exact quantiles of groups of any size by radix selection.

A number becomes a whole number of 64 bits that keeps its order. A histogram of the leading bits tells in which bucket a wanted rank lies and what rank it has there; only the rows of such buckets are counted by the
next bits, until all bits of the wanted values are known. Histograms are counted in the tasks that read the rows, and a task of a group sees at most 2^BITS buckets of each level, never the group's rows or
its different values, so a group may hold all rows of a table.

Defined cases: nulls are left out, a group without numbers has nulls; NaN comes after all other numbers and -0.0 is 0.0; a null key is a group; between two ranks the value is interpolated; an empty table gives no rows, and
one row of nulls if there are no keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from tessera.session import materialise, ship

#: Bits of a level.
BITS = 16


@F.arrow_udf(LongType())
def ordered_key(numbers: pa.Array) -> pa.Array:
    """A whole number for each number, in the same order."""
    x = numbers.to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits), mask=numbers.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(DoubleType())
def number_of_key(keys: pa.Array) -> pa.Array:
    bits = keys.fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64), mask=keys.is_null().to_numpy(zero_copy_only=False))


def _found(buckets: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Targets (keys, rank, left) in the bucket in which they lie, with the rank that they have there. buckets: (keys, part, n)."""
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("part")) - F.col("n")
    placed = buckets.withColumn("before", before)
    hit = placed.join(targets, keys).where((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n")))
    return hit.select(*keys, "part", "rank", (F.col("left") - F.col("before")).alias("left"))


def selected(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(g, rank, value): the numbers at ranks from 0 among the rows (g, key) of each group. targets: (g, rank)."""
    where = targets.select("g", F.lit(0).cast("long").alias("path"), "rank", F.col("rank").alias("left"))
    for level in range(64 // BITS):
        low = 64 - BITS * (level + 1)
        # the first bits with their sign, so that they keep the order of all numbers
        part = F.shiftright("key", low) if level == 0 else F.shiftright("key", low).bitwiseAND((1 << BITS) - 1)
        path = F.lit(0).cast("long") if level == 0 else F.shiftright("key", low + BITS)
        own = rows.select("g", path.alias("path"), part.alias("part"))
        if level:
            own = own.join(where.select("g", "path").distinct(), ["g", "path"], "left_semi")
        counts = own.groupBy("g", "path", "part").agg(F.count("*").alias("n"))
        hit = _found(counts, where, ["g", "path"])
        whole = F.col("part") if level == 0 else F.shiftleft("path", BITS).bitwiseOR(F.col("part"))
        where = hit.select("g", whole.alias("path"), "rank", "left")
    return where.select("g", "rank", number_of_key("path").alias("value"))


def exact_quantiles(rows: DataFrame, by: list[str], measures: list[str], wanted: Sequence[float]) -> DataFrame:
    """(by, each measure): an array of the wanted quantiles, 0 to 1, of each measure in each group, interpolated between ranks."""
    ship(rows.sparkSession)
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("x")) for m in measures)))
    long = rows.select(F.struct(F.lit(0).alias("_"), *by).alias("keys"), pairs.alias("p")).where("p.x is not null")
    keyed = materialise(long.select(F.struct("keys", "p.m").alias("g"), ordered_key("p.x").alias("key")), "keys")
    sizes = keyed.groupBy("g").agg(F.count("*").alias("size"))
    place = [(F.col("size") - 1) * F.lit(float(q)) for q in wanted]
    ranks = sizes.select("g", "size", F.posexplode(F.array(*place)).alias("q", "at"))
    ranks = ranks.select("g", "q", "at", F.floor("at").alias("low"), F.least(F.floor("at") + 1, F.col("size") - 1).alias("high"))
    asked = ranks.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct()
    values = materialise(selected(keyed, asked), "values")
    of = lambda name: values.select("g", F.col("rank").alias(name), F.col("value").alias(f"{name}_value"))
    met = ranks.join(of("low"), ["g", "low"]).join(of("high"), ["g", "high"])
    share = F.col("at") - F.col("low")
    value = F.when((share == 0) | (F.col("low_value") == F.col("high_value")), F.col("low_value")).otherwise(F.col("low_value") + (F.col("high_value") - F.col("low_value")) * share)
    arrays = met.groupBy("g.keys").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("g.m") == m, F.struct("q", value.alias("v"))))), lambda x: x["v"]).alias(f"_{k}") for k, m in enumerate(measures)))
    groups = rows.select(F.struct(F.lit(0).alias("_"), *by).alias("keys")).distinct() if by else rows.sparkSession.range(1).select(F.struct(F.lit(0).alias("_")).alias("keys"))
    none = F.array_repeat(F.lit(None).cast("double"), len(wanted))
    found = groups.join(arrays, "keys", "left")
    return found.select(*(F.col(f"keys.{c}").alias(c) for c in by), *(F.when(F.size(f"_{k}") > 0, F.col(f"_{k}")).otherwise(none).alias(m) for k, m in enumerate(measures)))


def with_quantiles(sums: DataFrame, rows: DataFrame, by: list[str], measures: list[str], wanted: Sequence[float]) -> DataFrame:
    """``sums``, which has a row for each group, with an array ``_q_measure`` of the wanted quantiles of each measure."""
    found = exact_quantiles(rows, by, measures, wanted).select(F.struct(F.lit(0).alias("_"), *by).alias("_keys"), *(F.col(m).alias(f"_q_{m}") for m in measures))
    return sums.withColumn("_keys", F.struct(F.lit(0).alias("_"), *by)).join(found, "_keys").drop("_keys")
