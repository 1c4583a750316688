"""Comparisons of outputs: variants of a model pair by pair, two runs side by side, sizes, and constraints on whole sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.grams import runs, runs_overlap, text_scores
from tessera.functions.text import bound, exact_ci, ngrams, strip, tokens


def variant_pairs(outputs: DataFrame, key: str, variant: str, order: str, text: str) -> DataFrame:
    """(key, pair, text_a, text_b) of each two variants of a record, in their order. A record has few variants, so a pair of rows for each two is no
    more than the summary needs."""
    a, b = (outputs.select(key, F.col(variant).alias(f"v_{x}"), F.col(order).alias(f"o_{x}"), F.col(text).alias(f"text_{x}")) for x in ("a", "b"))
    return a.join(b, key).where("o_a < o_b").select(key, F.concat("v_a", F.lit("-"), "v_b").alias("pair"), "text_a", "text_b")


def scored_pairs(outputs: DataFrame, key: str, variant: str, order: str, text: str) -> DataFrame:
    """(key, pair, same, rouge1, rouge2) of each two variants of a record, in their order: whether they are the same, and F1 of their words and word pairs. A record's
    few variants are brought together once; each is written as runs of grams once, and the runs are merged for each pair, all in the record's row."""
    # much work for little data, so that small partitions are not put together
    dealt = outputs.repartition(int(outputs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    some = dealt.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(variant).alias("v"), F.col(text).alias("t")))).alias("all"))
    told = lambda x: bound(tokens(x["t"]), lambda w: F.struct(x["o"].alias("o"), x["v"].alias("v"), F.lower(strip(x["t"])).alias("t"), runs(w).alias("r1"), runs(ngrams(w, 2)).alias("r2")))
    some = some.select(key, F.explode(F.array(F.transform("all", told))).alias("all"))  # once, not for each use
    pair = lambda a, b: F.struct(F.concat(a["v"], F.lit("-"), b["v"]).alias("pair"), (a["t"] == b["t"]).cast("int").alias("same"), *(F.round(runs_overlap(b[f"r{n}"], a[f"r{n}"]), 6).alias(f"rouge{n}") for n in (1, 2)))
    pairs = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: a["o"] < b["o"]), lambda b: pair(a, b))))
    return some.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def pair_summary(pairs: DataFrame, key: str) -> DataFrame:
    """For each pair of variants: records, mean F1 of words and of word pairs, and how many outputs are the same. pairs: as of ``variant_pairs`` or ``scored_pairs``."""
    if "rouge1" not in pairs.columns:
        scores = text_scores(F.col("text_b"), F.col("text_a"), [1, 2])
        pairs = pairs.select("pair", exact_ci(F.col("text_a"), F.col("text_b")).cast("int").alias("same"), scores.alias("s"))
        pairs = pairs.select("pair", "same", *(F.round(f"s.rouge{n}", 6).alias(f"rouge{n}") for n in (1, 2)))
    found = pairs.groupBy("pair").agg(F.count("*").alias("n"), F.round(F.avg("rouge1"), 5).alias("rouge1"), F.round(F.avg("rouge2"), 5).alias("rouge2"), F.sum("same").alias("same"))
    return found.withColumn("same_pct", F.round(100.0 * F.col("same") / F.col("n"), 6))


def run_summary(rows: DataFrame, by: list[str], equal: Column, flags: dict[str, Column]) -> DataFrame:
    """For each group: rows, equal ones and their rate, and how many rows have each flag."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(equal).alias("equal"), *(F.count_if(flag).alias(name) for name, flag in flags.items()))
    return found.withColumn("equal_rate", F.round(F.col("equal") / F.col("n"), 6))


def size_reduction(files: DataFrame, variant: str, size: str, base: str) -> DataFrame:
    """MiB and GiB of each file and its saving against the base in per cent; null without a base."""
    own = files.agg(F.max(F.when(F.col(variant) == base, F.col(size))).alias("_base"))
    return files.join(own).select(variant, F.round(F.col(size) / 1024**2, 3).alias("mib"), F.round(F.col(size) / 1024**3, 6).alias("gib"), F.round(100 * (1 - F.col(size) / F.nullif("_base", F.lit(0))), 6).alias("saving_pct"))


def quotas(rows: DataFrame, key: str, wanted: dict[str, int]) -> DataFrame:
    """(key, expected, n, met) for each expected value, also those without rows."""
    spark = rows.sparkSession
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return spark.createDataFrame(list(wanted.items()), f"{key} string, expected long").join(counts, key, "left").select(key, "expected", F.coalesce("n", F.lit(0)).alias("n")).withColumn("met", F.col("n") == F.col("expected"))


def diversity(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Distinct values of each group, their share of its rows, and the most rows of one value; counted per value first, so a frequent value is no hot key."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("k"))
    found = counts.groupBy(by).agg(F.count(value).alias("distinct_values"), F.sum("k").alias("n"), F.max("k").alias("most"))
    return found.withColumn("ratio", F.round(F.col("distinct_values") / F.col("n"), 6))


def split_overlaps(rows: DataFrame, id_col: str, split: str = "split") -> DataFrame:
    """Ids that are in more than one split, with those splits."""
    return rows.groupBy(id_col).agg(F.array_sort(F.collect_set(split)).alias("splits")).where("size(splits) > 1").select(id_col, F.array_join("splits", ",").alias("splits"))


def side_by_side(outputs: DataFrame, key: str, variant: str, text: str, variants: list[str]) -> DataFrame:
    """One row for each key with a column for each variant's output, null where it has none; one shuffle, whatever the number of variants."""
    return outputs.groupBy(key).pivot(variant, variants).agg(F.first(text))


def run_pairs(a: DataFrame, b: DataFrame, key: list[str], measures: list[str]) -> DataFrame:
    """Two runs over the same records joined by key: ``key``, and each measure of both (``_a``, ``_b``), and whether the raw texts are equal (``same``). The
    first measure is the raw text."""
    left, right = (rows.select(*key, *(F.col(m).alias(f"{m}_{x}") for m in measures)) for rows, x in ((a, "a"), (b, "b")))
    return left.join(right, key).withColumn("same", F.col(f"{measures[0]}_a").eqNullSafe(F.col(f"{measures[0]}_b")))


def audit_summary(pairs: DataFrame, by: list[str], text: str, distinct: str, hit: str) -> DataFrame:
    """For each group of ``run_pairs``: records, equal ones and their rate, and for either run how many outputs are empty, have two distinct alternatives, or
    went on to the limit."""
    flags = {}
    for x in ("a", "b"):
        flags |= {f"empty_{x}": F.length(F.trim(F.coalesce(F.col(f"{text}_{x}"), F.lit("")))) == 0, f"two_distinct_{x}": F.col(f"{distinct}_{x}"), f"hit_max_{x}": F.col(f"{hit}_{x}")}
    return run_summary(pairs, by, F.col("same"), flags)
