"""Token ids of prompts and completions: labels, limits and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.quantiles import with_quantiles

IGNORED = -100


def with_end(ids: Column, end: int) -> Column:
    """The ids with the end id, unless they end with it."""
    return F.when(F.coalesce(F.try_element_at(ids, F.lit(-1)) == end, F.lit(False)), ids).otherwise(F.concat(ids, F.array(F.lit(end))))


def labels(prompt: Column, completion: Column, end: int) -> Column:
    """Labels that train on the completion alone."""
    return F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), with_end(completion, end))


def before_end(ids: Column, end: int) -> Column:
    """The ids before the first end id."""
    at = F.array_position(ids, F.lit(end)).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), at - 1)).otherwise(ids)


def seen_end(ids: Column, end: int) -> Column:
    """Whether the end id occurs at all."""
    return F.coalesce(F.array_contains(ids, F.lit(end)), F.lit(False))


def within_limit(rows: DataFrame, prompt: str, completion: str, limit: int, name: str) -> DataFrame:
    """The rows as they are. Refuses, at once, a set in which a sequence exceeds the limit, and names up to five of them."""
    long = rows.select(name, (F.size(prompt) + F.size(completion)).alias("_n")).where(F.col("_n") > limit)
    found = long.orderBy(name).limit(5).collect()
    if found:
        raise ValueError(f"sequences beyond {limit} tokens: " + ", ".join(f"{r[0]} ({r[1]})" for r in found))
    return rows


def trainable(ids: Column, own: Column) -> Column:
    """As many labels as ids, and one at least that is not ignored."""
    return F.coalesce((F.size(ids) == F.size(own)) & F.exists(own, lambda x: x != IGNORED), F.lit(False))


def length_stats(rows: DataFrame, prompt: str, completion: str, limit: int) -> DataFrame:
    """One row on the lengths of the sequences, prompts and completions, and how many sequences exceed the limit."""
    sizes = rows.select(F.size(prompt).alias("p"), F.size(completion).alias("c")).withColumn("s", F.col("p") + F.col("c"))
    found = sizes.agg(F.count("*").alias("n"), F.min("s").alias("min_length"), F.max("s").alias("max_length"), F.max("p").alias("max_prompt"), F.max("c").alias("max_completion"), F.count_if(F.col("s") > limit).alias("over_limit"))
    found = with_quantiles(found, sizes, [], ["s"], [0.5, 0.95])
    return found.select("n", "min_length", *(F.round(F.col("_q_s")[k], 6).alias(name) for k, name in enumerate(("median_length", "p95_length"))), "max_length", "max_prompt", "max_completion", "over_limit")


def chat(shots: list[tuple[str, str]], prompt: Column) -> Column:
    """The messages of a chat: fixed ones, then the user's prompt."""
    message = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    return F.array(*(message(F.lit(role), F.lit(text)) for role, text in shots), message(F.lit("user"), prompt))
