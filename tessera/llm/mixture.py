"""Mixing sources to target weights by hash-threshold histograms.

The total of all sizes is dealt to the sources by weight; a source's target stops at ``most`` times its size and what it leaves is
dealt to the others by weight. A source whose target exceeds its size is taken whole as often as it fits. What is left of its
target is a budget for one more copy of some documents: sizes are summed by source and bucket of a hash, the bucket in which
the running sum passes the budget is found, only that bucket is summed again by the next bits, and so on; documents with
hashes below the threshold are taken. What the first document beyond the threshold is too large for is a smaller, nested
budget for smaller documents with larger hashes, LEVELS times; what is left then is less than the size of each document that came first beyond
a threshold. So no documents are sorted, and a document's copies follow from its own row and a table with a row for each source.

Defined cases: a null or empty text has size 0 and is taken with 0 words; a null source is a source, the last; rows that are
equal in id and text have one hash, and where the threshold falls on them as many are taken as the budget holds, which of them is decided by their
place; a null id is an id; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import fresh, materialise

#: Bits of the hash that one histogram tells apart, and how often the boundary bucket is refined.
BITS, REFINED = 12, 2
#: Nested budgets.
LEVELS = 4


def word_number(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], most: float) -> DataFrame:
    """(source, source_size, target) from rows (source, size). Sources by code point, null last, have the weights in turn."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    # sources reach their caps in the order of cap / weight; the rest share what is left in proportion to weight
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("rate", F.col("left") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("place", F.row_number().over(order))
    rate = F.min_by(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("rate")), F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("place"))).over(Window.partitionBy())
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(rate, F.lit(0.0)) * F.col("weight")).alias("target"))


def _threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, end, used, tied) for each source of ``budgets`` (source, low, cap, budget) that has documents of sizes up to ``cap`` and hashes from
    ``low`` on: ``end`` is the first hash at which the running sum of sizes would pass the budget, ``tied`` as many of the rows of that hash as it
    still holds, and ``used`` the sum of all these. If the budget is not passed, ``end`` is the largest number.

    Each histogram is a query of its own over one scan, and what it finds for each source is written: in one plan every refinement would
    hold all those before it twice, which the driver plans and keeps."""
    limits = budgets.select(F.col("source").alias("s"), "low", "cap", "budget", F.lit(0.0).alias("spent")).where("budget >= 1")
    held = rows.join(limits, rows["source"].eqNullSafe(limits["s"])).where("size > 0 and size <= cap and h >= low")
    shift, every = 63, None
    for _ in range(REFINED):
        shift -= BITS
        bucket = F.shiftright("h", shift)
        limit = [F.first(c).alias(c) for c in ("low", "cap", "budget", "spent")]
        sums = held.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("sum"), *limit)
        run = F.col("spent") + F.sum("sum").over(Window.partitionBy("source").orderBy("bucket"))
        past = F.when(F.col("run") > F.col("budget"), F.col("bucket"))
        found = sums.withColumn("run", run).groupBy(F.col("source").alias("s")).agg(*limit[:3], F.min_by(F.col("run") - F.col("sum"), past).alias("spent"), F.min(past).alias("at"), F.sum("sum").cast("double").alias("all"))
        limits = materialise(found, "passed")
        every = every if every is not None else limits.select("s", "all")
        held = rows.join(limits, rows["source"].eqNullSafe(limits["s"])).where((F.col("size") > 0) & (F.col("size") <= F.col("cap")) & (F.col("h") >= F.col("low")) & (bucket == F.col("at")))
    # the refined bucket of a source holds a few hashes; rows of one hash are of one size
    hashes = held.groupBy("source", "h").agg(F.sum("size").alias("sum"), F.max("size").alias("size"), F.first("budget").alias("budget"), F.first("spent").alias("spent"))
    before = F.col("spent") + F.sum("sum").over(Window.partitionBy("source").orderBy("h")) - F.col("sum")
    last = hashes.withColumn("before", before).where("before + sum > budget").groupBy("source").agg(F.min_by(F.struct("h", "before", "size", "budget"), "h").alias("b"))
    tied = F.floor((F.col("b.budget") - F.col("b.before")) / F.col("b.size"))
    last = last.select("source", F.col("b.h").alias("end"), tied.alias("tied"), (F.col("b.before") + tied * F.col("b.size")).alias("used"))
    out = every.join(last, every["s"].eqNullSafe(last["source"]), "left")
    return out.select(F.col("s").alias("source"), F.coalesce("end", F.lit((1 << 63) - 1)).alias("end"), F.coalesce("used", "all").alias("used"), F.coalesce("tied", F.lit(0)).cast("long").alias("tied"))


def plan_mix(sizes: DataFrame, weights: list[float], most: int = 3) -> DataFrame:
    """(source, source_size, target, whole, rules) from rows (source, size, h): every document is taken ``whole`` times, and once more
    under a rule (cap, low, end, tied): its size is at most cap, and its hash is in [low, end), or it is one of the ``tied`` first rows with the hash end."""
    plan = materialise(source_targets(sizes, weights, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    plan = plan.withColumn("whole", whole)
    none = "array<struct<cap:double,low:bigint,end:bigint,tied:bigint>>"
    state = plan.select("*", (F.when(F.col("whole") < most, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)).alias("budget"), F.lit(0).cast("long").alias("low"), F.array().cast(none).alias("rules"))
    for level in range(LEVELS):
        # at first any document may be taken
        cap = F.lit(float("inf")) if level == 0 else F.col("budget")
        found = _threshold(sizes, state.select("source", "low", cap.alias("cap"), "budget")).select(F.col("source").alias("s"), "end", "used", "tied")
        rule = F.when(F.col("end").isNotNull(), F.concat("rules", F.array(F.struct(cap.alias("cap"), "low", "end", "tied")))).otherwise(F.col("rules"))
        joined = state.join(found, state["source"].eqNullSafe(found["s"]), "left").withColumn("rules", rule.cast(none))
        joined = joined.withColumn("budget", F.when(F.col("end").isNotNull(), F.col("budget") - F.col("used")).otherwise(F.lit(0.0)))
        state = materialise(joined.withColumn("low", F.coalesce("end", "low")).drop("s", "end", "used", "tied"), "mix")
    return state.select("source", "source_size", "target", "whole", "rules")


def with_copies(docs: DataFrame, weights: list[float], most: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", name: str = "mix") -> DataFrame:
    """The rows of ``docs`` with a struct column ``name`` (in place of one of that name): size, source_size, target and copies, how often the row is taken.
    Other columns stay as they are, whatever their names."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1)
    own = docs.withColumn(name, F.struct(F.col(source_col).cast("string").alias("source"), word_number(F.col(text_col)).alias("size"), h.alias("h")))
    plan = plan_mix(materialise(own.select(f"{name}.source", f"{name}.size", f"{name}.h"), "sizes"), weights, most)
    p = fresh(own, "plan")
    joined = own.join(plan.select(F.struct("*").alias(p)), F.col(f"{name}.source").eqNullSafe(F.col(f"{p}.source")))
    size, place = F.col(f"{name}.size"), F.col(f"{name}.h")
    under = F.exists(f"{p}.rules", lambda r: (size <= r["cap"]) & (place >= r["low"]) & (place < r["end"]))

    def done(rows: DataFrame, also: Column) -> DataFrame:
        mix = F.struct(size.alias("size"), F.col(f"{p}.source_size").alias("source_size"), F.col(f"{p}.target").alias("target"), (F.col(f"{p}.whole") + also.cast("int")).alias("copies"))
        return rows.withColumn(name, mix).select(*(F.col(f"`{c}`") for c in docs.drop(name).columns), name)

    if plan.where(F.exists("rules", lambda r: r["tied"] > 0)).isEmpty():
        return done(joined, under)
    # the rows on which a threshold falls are numbered: in the tasks, and the tasks' sums over them
    tied = F.coalesce(F.array_max(F.transform(F.filter(f"{p}.rules", lambda r: (size <= r["cap"]) & (place == r["end"])), lambda r: r["tied"])), F.lit(0))
    t = fresh(joined, "tie")
    kept = joined.where(tied > 0).withColumn(t, F.struct(F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), F.xxhash64(f"{name}.source", f"{name}.h").alias("group")))
    kept = materialise(kept, "ties")
    sums = kept.groupBy(F.col(f"{t}.group").alias("group"), F.col(f"{t}.task").alias("task")).agg(F.count("*").alias("n"))
    before = sums.select(F.struct("group", "task", (F.sum("n").over(Window.partitionBy("group").orderBy("task")) - F.col("n")).alias("before")).alias(b := fresh(kept, "before")))
    within = F.row_number().over(Window.partitionBy(F.col(f"{t}.group"), F.col(f"{t}.task")).orderBy(F.col(f"{t}.at")))
    counted = kept.withColumn(t, F.struct(f"{t}.group", f"{t}.task", within.alias("number")))
    counted = counted.join(before, (F.col(f"{t}.group") == F.col(f"{b}.group")) & (F.col(f"{t}.task") == F.col(f"{b}.task")))
    return done(joined.where(tied == 0), under).unionByName(done(counted, under | (F.col(f"{b}.before") + F.col(f"{t}.number") <= tied)))


def mixed(docs: DataFrame, weights: list[float], **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with all its columns, whatever their names. Documents without words carry nothing towards a
    target and are left out; an empty table gives no rows."""
    name = fresh(docs, "mix")
    rows = with_copies(docs, weights, name=name, **options).where((F.col(f"{name}.size") > 0) & (F.col(f"{name}.copies") > 0))
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies")))).drop(name)
