"""What two lists have in common with multiplicity, within a row: each list is sorted once and written as runs, and the runs of both are merged in order. No list is exploded, nothing is shuffled.

Defined cases: a null list is an empty one; an empty list has nothing in common and scores 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound, ngrams, tokens


def runs(items: Column) -> Column:
    """(g, n): the different items in order, and how often each occurs."""

    def of(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, k: F.when((k == 0) | (F.get(s, k - 1) != x), k)), lambda k: k.isNotNull())
        between = lambda h: F.transform(F.slice(h, F.lit(1), F.size(h) - 1), lambda k, j: F.struct(F.get(s, k).alias("g"), (F.get(h, j + 1) - k).alias("n")))
        return bound(F.concat(starts, F.array(F.size(s))), between)

    return bound(F.array_sort(F.coalesce(items, F.array().cast("array<string>"))), of)


def common(a: Column, b: Column) -> Column:
    """How many items the lists of two runs have in common."""
    # of an item that both have, the smaller number comes first
    met = lambda z: F.aggregate(F.transform(z, lambda x, k: F.when(F.get(z, k + 1)["g"] == x["g"], x["n"]).otherwise(0)), F.lit(0), lambda total, n: total + n)
    return bound(F.array_sort(F.concat(a, b)), met)


def runs_overlap(a: Column, b: Column) -> Column:
    """F1 of the items that the lists of two runs have in common."""
    total = lambda r: F.aggregate(F.transform(r, lambda x: x["n"]), F.lit(0), lambda t, n: t + n)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * common(a, b) / (total(a) + total(b))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """F1 of the items that two lists have in common."""
    return bound(F.struct(runs(a).alias("a"), runs(b).alias("b")), lambda v: runs_overlap(v["a"], v["b"]))


def gram_scores(a: Column, b: Column, sizes: list[int]) -> Column:
    """A struct (rouge1, rouge2, ...): F1 of the common n-grams of two lists of words, for each n."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda w: F.struct(*(overlap(ngrams(w["a"], n), ngrams(w["b"], n)).alias(f"rouge{n}") for n in sizes)))


def text_scores(prediction: Column, reference: Column, sizes: list[int]) -> Column:
    """``gram_scores`` of the words of two texts."""
    return gram_scores(tokens(prediction), tokens(reference), sizes)
