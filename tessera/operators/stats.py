"""Descriptive statistics of runs and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.grams import text_scores
from tessera.functions.numbers import pct_change
from tessera.functions.text import ngrams, tokens
from tessera.operators.quantiles import with_quantiles
from tessera.session import materialise


def described(rows: DataFrame, by: list[str], measures: list[str], *first: Column) -> DataFrame:
    """(by, first, runs, and of each measure mean, median, p95, min, max and sample deviation, 0 of a single value), six decimals. The quantiles are exact, whatever a group's size."""
    sums = {"mean": F.avg, "min": F.min, "max": F.max, "std_dev": lambda m: F.coalesce(F.stddev_samp(m), F.lit(0.0))}
    found = rows.groupBy(*by).agg(*first, F.count("*").alias("runs"), *(f(m).alias(f"{m}_{name}") for m in measures for name, f in sums.items()))
    found = with_quantiles(found, rows, by, measures, [0.5, 0.95])
    out = [F.round(F.col(f"_q_{m}")[0 if k == "median" else 1] if k in ("median", "p95") else F.col(f"{m}_{k}"), 6).alias(f"{m}_{k}") for m in measures for k in ("mean", "median", "p95", "min", "max", "std_dev")]
    return found.select(*found.columns[: len(by) + len(first) + 1], *out)


def describe_by(rows: DataFrame, key: str, measures: list[str]) -> DataFrame:
    return described(rows, [key], measures)


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with their number from 1 in an order of all rows. Ranges of the order are sorted apart and written; only the number of rows of each
    range is summed up, so no task sees all rows, and a lost executor cannot shift ranges. Keys that tie are numbered in any order."""
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = materialise(sorted_rows.select("*", F.spark_partition_id().alias("_range"), at.alias("_at")), "ordinals")
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return kept.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def with_ordinals(rows: DataFrame, order: list[str], cycle: int = 6) -> DataFrame:
    """run from 1, its cycle, and its place in the cycle."""
    found = numbered(rows, order, "run")
    return found.withColumn("cycle", F.ceil(F.col("run") / cycle).cast("int")).withColumn("place", ((F.col("run") - 1) % cycle).cast("int"))


def first_last(rows: DataFrame, seq: str, measures: list[str], k: int, by: list[str] | None = None) -> DataFrame:
    """Mean of the first and of the last ``k`` rows of each measure and the change in per cent (null from nought). Each task keeps ``k`` rows of a group
    before anything is shuffled."""
    by, ends = by or [], []
    for end, order in (("first", F.col(seq).asc()), ("last", F.col(seq).desc())):
        top = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(f"_place <= {k}") if by else rows.orderBy(order).limit(k)
        ends.append(top.select(*by, *measures, F.lit(end).alias("_end")))
    of = lambda m, end: F.avg(F.when(F.col("_end") == end, F.col(m))).alias(f"{m}_{end}")
    sums = ends[0].unionByName(ends[1]).groupBy(*by).agg(*(of(m, end) for m in measures for end in ("first", "last")))
    return sums.select(*by, *(x for m in measures for x in (F.round(f"{m}_first", 6).alias(f"{m}_first"), F.round(f"{m}_last", 6).alias(f"{m}_last"), F.round(pct_change(F.col(f"{m}_first"), F.col(f"{m}_last")), 6).alias(f"{m}_change_pct"))))


def even_sample(rows: DataFrame, id_col: str, seq: str, known: list[str], n: int) -> DataFrame:
    """(id, known): a sample of ``n`` rows, numbered from 1 by ``seq``. Known ids come first, in their order; then rows at even distances, of which three
    times as many as needed and ten more are named and the first are taken, so controls are from the first part; then the first other rows."""
    spark, is_known = rows.sparkSession, F.coalesce(F.col(id_col).isin(known), F.lit(False))
    own = rows.select(id_col, seq, is_known.alias("known"))
    order = F.array_position(F.array(*(F.lit(x) for x in known)) if known else F.array().cast("array<string>"), F.col(id_col))
    first = own.where("known").orderBy(order).limit(n)
    sizes = own.agg(F.max(seq).alias("total"), F.count_if("known").alias("found")).first()
    total, needed = sizes.total or 0, max(0, n - sizes.found)
    last = needed * 3 + 9
    points = spark.range(last + 1).select((F.bround(F.col("id") * (total - 1) / last).cast("long") + 1).alias(seq)) if needed != 1 else spark.range(1).select(F.lit(total // 2 + 1).alias(seq))
    even = own.join(F.broadcast(points.distinct()), seq).where("not known").select(id_col, seq, F.lit(1).alias("turn"))
    other = own.where("not known").orderBy(seq).limit(2 * n).select(id_col, seq, F.lit(2).alias("turn"))
    controls = even.unionByName(other).groupBy(id_col, seq).agg(F.min("turn").alias("turn")).orderBy("turn", seq).limit(needed)
    return first.select(id_col, "known").unionByName(controls.select(id_col, F.lit(False).alias("known")))


def slopes(rows: DataFrame, seq: str, measures: list[str], by: list[str] | None = None) -> DataFrame:
    """Least-squares slope of each measure over ``seq``; 0 if it has none."""
    return rows.groupBy(*(by or [])).agg(*(F.round(F.coalesce(F.regr_slope(m, seq), F.lit(0.0)), 6).alias(f"{m}_slope") for m in measures))


def means_by(rows: DataFrame, key: str, measures: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(*(F.round(F.avg(m), 6).alias(f"{m}_mean") for m in measures))


def series_summary(rows: DataFrame, seq: str, value: str, status: str, by: str) -> DataFrame:
    """First, last, least and largest value, the number of samples, and the sorted states."""
    found = rows.groupBy(by).agg(F.count("*").alias("samples"), F.min_by(value, seq).alias("first_value"), F.max_by(value, seq).alias("last_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.array_join(F.array_sort(F.collect_set(F.col(status).cast("string"))), ",").alias("states"))
    return found


def cold_warm(rows: DataFrame, condition: str, value: str) -> DataFrame:
    """The first value when cold, statistics when warm, and the saving in per cent."""
    own = rows.select(*(F.when(F.col(condition) == x, F.col(value)).alias(x) for x in ("cold", "warm")))
    found = own.agg(F.max("cold").alias("cold"), F.avg("warm").alias("warm_mean"), F.min("warm").alias("warm_min"), F.max("warm").alias("warm_max"))
    found = with_quantiles(found, own, [], ["warm"], [0.5])
    return found.select("cold", "warm_mean", F.col("_q_warm")[0].alias("warm_median"), "warm_min", "warm_max", (100 * (F.col("cold") - F.col("warm_mean")) / F.col("cold")).alias("saving_pct"))


def amount_profile(rows: DataFrame, amount: str, by: str) -> DataFrame:
    found = rows.groupBy(by).agg(F.count(amount).alias("n"), F.round(F.min(amount), 2).alias("min_amount"), F.round(F.max(amount), 2).alias("max_amount"), F.round(F.avg(amount), 4).alias("avg_amount"))
    found = with_quantiles(found, rows, [by], [amount], [0.1, 0.5, 0.9])
    return found.select(by, "n", "min_amount", "max_amount", "avg_amount", *(F.round(F.col(f"_q_{amount}")[k], 4).alias(name) for k, name in enumerate(("p10", "median_amount", "p90"))))


def word_lengths(rows: DataFrame, text: str, by: str) -> DataFrame:
    """(by, n, min_words, max_words, mean_words, median_words): lengths of texts in words; six decimals."""
    own = rows.select(by, F.size(tokens(F.col(text))).alias("k"))
    found = own.groupBy(by).agg(F.count("*").alias("n"), F.min("k").alias("min_words"), F.max("k").alias("max_words"), F.round(F.avg("k"), 6).alias("mean_words"))
    found = with_quantiles(found, own, [by], ["k"], [0.5])
    return found.select(by, "n", "min_words", "max_words", "mean_words", F.round(F.col("_q_k")[0], 6).alias("median_words"))


def best_checkpoint(log: DataFrame) -> DataFrame:
    """(step, eval_loss) of the smallest loss; of equal ones the first step's."""
    return log.where("eval_loss is not null").agg(F.min_by("step", F.struct("eval_loss", "step")).alias("step"), F.min("eval_loss").alias("eval_loss"))


def grouped_means(rows: DataFrame, measures: list[str], key: str) -> DataFrame:
    """Means of all rows and of each group; null measures are skipped, booleans count as numbers."""
    found = rows.groupingSets([[], [F.col(key)]], key).agg(F.grouping_id().alias("level"), F.count("*").alias("records"), *(F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in measures))
    return found.select(F.when(F.col("level") == 0, F.col(key)).otherwise("ALL").alias(key), "records", *measures)


#: Bytes of a text beyond which its n-grams are counted in groups instead of in its row.
LONG_TEXT = 8 << 20


def rouge_rows(rows: DataFrame, keys: list[str], prediction: str, reference: str, n: int, name: str, long: int = LONG_TEXT) -> DataFrame:
    """(keys, name): F1 of common n-grams of two texts with multiplicity, six decimals. Texts are scored in their rows; only those of more than ``long`` bytes
    have their grams dealt to groups, with the same result, so a text may be of any length. Keys tell rows apart."""
    fits = F.coalesce(F.greatest(F.octet_length(prediction), F.octet_length(reference)) <= long, F.lit(True))
    short = rows.where(fits).select(*keys, F.round(text_scores(F.col(prediction), F.col(reference), [n])[f"rouge{n}"], 6).alias(name))
    return short.unionByName(_rouge_of_long_texts(rows.where(~fits), keys, prediction, reference, n, name))


def _rouge_of_long_texts(rows: DataFrame, keys: list[str], prediction: str, reference: str, n: int, name: str) -> DataFrame:
    grams = lambda c, p, r: F.transform(ngrams(tokens(F.col(c)), n), lambda g: F.struct(g.alias("gram"), F.lit(p).alias("p"), F.lit(r).alias("r")))
    each = rows.select(*keys, F.explode(F.concat(grams(prediction, 1, 0), grams(reference, 0, 1))).alias("g"))
    counts = each.groupBy(*keys, "g.gram").agg(F.sum("g.p").alias("p"), F.sum("g.r").alias("r"))
    sums = counts.groupBy(*keys).agg(F.sum(F.least("p", "r")).alias("both"), F.sum("p").alias("p"), F.sum("r").alias("r"))
    found = rows.select(*keys).join(sums, keys, "left")
    return found.select(*keys, F.round(F.when((F.col("p") > 0) & (F.col("r") > 0), 2.0 * F.col("both") / (F.col("p") + F.col("r"))).otherwise(0.0), 6).alias(name))


def amount_stats(rows: DataFrame, amount: str) -> DataFrame:
    """(min, max, avg) of amounts given as text or numbers, two decimals; what is no number is left out. One row, of nulls without numbers."""
    own = F.col(amount).cast("string").try_cast("double")
    return rows.select(own.alias("a")).where("a is not null and not isnan(a)").agg(F.min("a").alias("min"), F.max("a").alias("max"), F.round(F.avg("a"), 2).alias("avg"))


def describe_by_prompt(rows: DataFrame, key: str, seq: str, task: str, measures: list[str]) -> DataFrame:
    """``describe_by`` with the task of each key's first row."""
    return described(rows, [key], measures, F.min_by(task, seq).alias(task))


def first_last_medians(rows: DataFrame, seq: str, measures: list[str], k: int, by: list[str] | None = None) -> DataFrame:
    """Medians of the first and last ``k`` rows of each measure and the change in per cent. Each task keeps ``k`` rows of a group before anything is shuffled."""
    by, ends = by or [], []
    for end, order in (("first", F.col(seq).asc()), ("last", F.col(seq).desc())):
        top = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(f"_place <= {k}") if by else rows.orderBy(order).limit(k)
        ends.append(top.select(*by, *measures, F.lit(end).alias("_end")))
    of = lambda m, end: F.median(F.when(F.col("_end") == end, F.col(m))).alias(f"{m}_{end}_median")
    found = ends[0].unionByName(ends[1]).groupBy(*by).agg(*(of(m, end) for m in measures for end in ("first", "last")))
    change = {f"{m}_median_change_pct": F.round(pct_change(F.col(f"{m}_first_median"), F.col(f"{m}_last_median")), 6) for m in measures}
    return found.select(*by, *(F.round(f"{m}_{end}_median", 6).alias(f"{m}_{end}_median") for m in measures for end in ("first", "last")), *(c.alias(name) for name, c in change.items()))


def elapsed(rows: DataFrame, ts: str, name: str = "elapsed_s") -> DataFrame:
    """``rows`` with the seconds since the first sample, three decimals. The first is found by an aggregate and sent around as one row."""
    first = rows.agg(F.min(ts).alias("_first"))
    return rows.join(F.broadcast(first)).withColumn(name, F.round((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))) / 1e6, 3)).drop("_first")


def thermal_summary(samples: DataFrame, seq: str, elapsed_col: str, temperature: str, battery: str, status: str) -> DataFrame:
    """One row: samples, duration, first, last, least and largest temperature, first and last battery level, the highest and all states. Blank measures are skipped."""
    has = lambda c, of: F.when(F.col(c).isNotNull(), F.col(of))
    return samples.agg(
        F.count("*").alias("samples"), F.max_by(elapsed_col, seq).alias("duration_s"),
        F.min_by(temperature, has(temperature, seq)).alias("first_temperature"), F.max_by(temperature, has(temperature, seq)).alias("last_temperature"), F.min(temperature).alias("min_temperature"), F.max(temperature).alias("max_temperature"),
        F.min_by(battery, has(battery, seq)).alias("first_battery"), F.max_by(battery, has(battery, seq)).alias("last_battery"),
        F.max(status).alias("max_status"), F.array_join(F.array_sort(F.collect_set(status)), ",").alias("states"),
    )


#: The measures of a scored record: numbers as they are, flags as shares; a null is skipped.
SCORES = ["rouge1_f1", "rouge2_f1", "bertscore_f1", "normalized_exact_match"]
FLAGS = {
    "two_distinct_alternatives": "two_distinct_alternatives_rate", "structured_consistent": "automatic_structured_consistency_rate", "currency_consistent": "currency_consistency_rate",
    "amount_consistent": "amount_consistency_rate", "temporal_consistent": "temporal_consistency_rate", "beneficiary_mentioned": "beneficiary_mention_rate", "calendar_reflected": "calendar_context_reflection_rate",
}


def evaluation_metrics(scored: DataFrame, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """records and all means of scored records in grouping sets, as [["model", "test_set"], ["model", "test_set", "activity_type"]]; a key that a set
    leaves out is ``ALL``. Measures that the rows do not have are null."""
    have = set(scored.columns)
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6) if c in have else F.lit(None).cast("double")
    means = [mean(c).alias(c) for c in SCORES] + [mean(c).alias(name) for c, name in FLAGS.items()]
    levels = [F.grouping(k).alias(f"_g_{k}") for k in keys]
    found = scored.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.count("*").alias("records"), *levels, *means)
    return found.select(*(F.when(F.col(f"_g_{k}") == 0, F.col(k)).otherwise("ALL").alias(k) for k in keys), "records", *SCORES, *FLAGS.values())


def variant_summary(rows: DataFrame, variant: str, means: list[str], flags: list[str]) -> DataFrame:
    """For each variant: records, means, and for each flag the count and per cent of rows; nought, not null, where nothing is there."""
    found = rows.groupBy(variant).agg(F.count("*").alias("records"), *(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(f"avg_{m}") for m in means), *(F.count_if(F.col(f)).alias(f) for f in flags))
    return found.withColumns({f"{f}_pct": F.round(F.coalesce(100.0 * F.col(f) / F.nullif(F.col("records"), F.lit(0)), F.lit(0.0)), 6) for f in flags})


def review_first(scored: DataFrame, consistent: str, distinct: str, scores: list[str], order: list[str], most: int = 60) -> DataFrame:
    """The ``most`` records to be looked at first: ten points if inconsistent, five if their alternatives are not distinct; then those with the lowest of the first score
    that is not null, then in ``order``."""
    no = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), 0).otherwise(1)
    ranked = scored.withColumn("priority", 10 * no(consistent) + 5 * no(distinct)).withColumn("score", F.coalesce(*scores))
    return ranked.orderBy(F.desc("priority"), F.col("score").asc_nulls_last(), *order).limit(most)


def sorted_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The groups by name, with their sizes."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys)
