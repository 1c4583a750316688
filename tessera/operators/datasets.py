"""Constraints on whole sets of records, splits of a set, and the alignment of raw, rendered and predicted rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.mentions import times
from tessera.functions.text import bound, normalised, normalised_items, strip
from tessera.operators.profile import tallies
from tessera.operators.records import ACTIVITIES, references_contained
from tessera.operators.stats import numbered


def _errors(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), detail.alias("detail"))


def missing_names(rows: DataFrame, id_col: str, last: int, prefix: str = "EX", digits: int = 4) -> DataFrame:
    """Ids from 1 to ``last``, padded with noughts to ``digits``, that no row has. Further ids are not reported."""
    wanted = rows.sparkSession.range(1, last + 1).select(F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), F.greatest(F.lit(digits), F.length(F.col("id").cast("string"))), "0")).alias(id_col))
    return wanted.join(rows.select(id_col), id_col, "left_anti")


def dataset_errors(records: DataFrame, total: int, activities: dict[str, int], with_calendar: int, without_calendar: int, seq: str = "seq", least_categories: int = 25, share: float = 0.1, shown: int = 20, digits: int = 4) -> DataFrame:
    """(rule, detail): a row for each constraint on the whole set that does not hold. The records are read once, into counts of all that is constrained; lists of ids show the
    first ``shown``. A null category is a category."""
    generation = F.col("activity_type") == "GENERATION"
    keys = {"all": F.lit(""), "id": F.col("id_example"), "activity": F.col("activity_type"), "category": F.col("operation_category"), "calendar": F.when(F.col("calendar_context").isNotNull(), "with").otherwise("without")}
    counts = tallies(records, keys, seq=seq, only={"calendar": generation})
    part = lambda name: counts.where(F.col("part") == name)
    count = lambda name, key: F.coalesce(F.sum(F.when((F.col("part") == name) & (F.col("key") == key), F.col("n"))), F.lit(0))
    sums = counts.agg(count("all", "").alias("n"), count("calendar", "with").alias("with"), count("calendar", "without").alias("without"), F.count_if(F.col("part") == "category").alias("categories"))
    expected = lambda c, n: F.format_string(f"expected {n}, found %d", F.col(c))
    out = [_errors(sums.where(F.col(c) != n), rule, expected(c, n)) for rule, c, n in (("total_count", "n", total), ("calendar_quota_with", "with", with_calendar), ("calendar_quota_without", "without", without_calendar))]
    listed = lambda rows: rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]), ", ").alias("ids")).where("ids != ''")
    ids = part("id").select(F.col("key").alias("id_example"), "n", "first")
    repeated = ids.where("n > 1").orderBy("first").limit(shown).select(F.struct("first", F.col("id_example").alias("id")).alias("x"))
    out.append(_errors(listed(repeated), "duplicate_ids", F.col("ids")))
    missing = missing_names(ids, "id_example", total, digits=digits).orderBy("id_example").limit(shown).select(F.struct(F.col("id_example").alias("id")).alias("x"))
    out.append(_errors(listed(missing), "missing_ids", F.col("ids")))
    wanted = records.sparkSession.createDataFrame(list(activities.items()), "key string, expected long").join(part("activity").select("key", "n"), "key", "left").select("key", "expected", F.coalesce("n", F.lit(0)).alias("n"))
    out.append(_errors(wanted.where("n <> expected"), "activity_quota", F.format_string("%s: expected %d, found %d", "key", "expected", "n")))
    out.append(_errors(sums.where(F.col("categories") < least_categories), "min_categories", F.format_string(f"expected {least_categories} at least, found %d", "categories")))
    out.append(_errors(part("category").where(F.col("n") > share * total), "category_cap", F.format_string("%s: %d", "key", "n")))
    return reduce(DataFrame.unionByName, out)


def validation_passed(unreadable: DataFrame, errors: DataFrame, copies: DataFrame) -> DataFrame:
    """One row: whether no line was unreadable, no rule broken and no record a copy; near copies do not count."""
    number = lambda rows, name: rows.agg(F.count("*").alias(name))
    return _passed(number(unreadable, "unreadable").join(number(errors, "errors")), copies)


def lines_passed(lines: DataFrame, copies: DataFrame) -> DataFrame:
    """As ``validation_passed``, of lines (readable, errors: how many it has), which are counted in one pass."""
    return _passed(lines.agg(F.count_if(~F.col("readable")).alias("unreadable"), F.coalesce(F.sum("errors").cast("long"), F.lit(0).cast("long")).alias("errors")), copies)


def _passed(found: DataFrame, copies: DataFrame) -> DataFrame:
    found = found.join(copies.agg(F.count("*").alias("copies")))
    return found.withColumn("passed", (F.col("unreadable") == 0) & (F.col("errors") == 0) & (F.col("copies") == 0))


def split_cover(original: DataFrame, parts: dict[str, DataFrame], id_col: str, label: str = "split") -> DataFrame:
    """(id, problem): ids of the set that no part has (``lost``), of parts that the set does not have (``stray``), in several parts (``shared``), and rows whose label
    is not their part's name (``label``)."""
    of_part = lambda k, name: (F.lit(None).cast("int").alias("there"), F.lit(k).alias("part"), (~F.col(label).eqNullSafe(F.lit(name))).cast("int").alias("wrong"))
    rows = [part.select(id_col, *of_part(k, name)) for k, (name, part) in enumerate(parts.items())]
    none = F.lit(None).cast("int")
    rows.append(original.select(id_col, F.lit(1).alias("there"), none.alias("part"), none.alias("wrong")))
    # one aggregation of numbers by id, without a join
    both = reduce(DataFrame.unionByName, rows).groupBy(id_col).agg(F.max("there").alias("there"), F.min("part").alias("first"), F.max("part").alias("last"), F.max("wrong").alias("wrong"))
    # null ids are not the same
    alone = lambda other: F.col(other).isNull() | F.col(id_col).isNull()
    lost, stray = F.col("there").isNotNull() & alone("first"), F.col("first").isNotNull() & alone("there")
    problem = F.array_compact(F.array(F.when(lost, "lost"), F.when(stray, "stray"), F.when(F.col("first") < F.col("last"), "shared"), F.when(F.col("wrong") == 1, "label")))
    return both.select(id_col, F.explode(problem).alias("problem"))


def final_shuffle(rows: DataFrame, id_col: str, seed: str = "42") -> DataFrame:
    """The rows in the order of a seeded digest of their ids, the same on every run."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col)


# -- alignment


def aligned(raw: DataFrame, other: DataFrame, key: str, *further: DataFrame) -> DataFrame:
    """Rows of several sets side by side by their key, which takes the place of their position. Fails, when it runs, on a key that a set lacks or repeats, so
    that sets of different sizes are not joined in silence."""
    sets = [raw, other, *further]
    counted = [rows.withColumn(f"_n{k}", F.lit(1)) for k, rows in enumerate(sets)]
    joined = reduce(lambda a, b: a.join(b, key, "full"), counted)
    fine = reduce(lambda a, b: a & b, (F.col(f"_n{k}").isNotNull() for k in range(len(sets))))
    checked = joined.withColumn(key, F.when(fine, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not in all sets: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))))
    return checked.drop(*(f"_n{k}" for k in range(len(sets))))


def contained_either_way(references: Column, completion: Column) -> Column:
    """Each reference is part of the completion or holds it, both normalised; empty references never are."""
    both = F.struct(normalised(completion).alias("text"), normalised_items(references).alias("refs"))
    return bound(both, lambda n: F.forall(n["refs"], lambda r: (r != "") & (F.contains(n["text"], r) | F.contains(r, n["text"]))))


def alignment_report(pairs: DataFrame, key: str, references: str = "expected_output", prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """(key, all_references, either_way, bad_prompt, bad_completion) of each pair of a raw and a rendered row."""
    bare = lambda c: F.col(c).isNull() | (F.length(strip(F.col(c))) == 0)
    two = F.size(references) == 2
    return pairs.select(key, (two & F.coalesce(references_contained(F.col(completion), F.col(references)), F.lit(False))).alias("all_references"), (two & F.coalesce(contained_either_way(F.col(references), F.col(completion)), F.lit(False))).alias("either_way"), bare(prompt).alias("bad_prompt"), bare(completion).alias("bad_completion"))


def alignment_stats(pairs: DataFrame, prompt: str = "prompt") -> DataFrame:
    """One row: pairs, prompts that end with a line break, and the longest prompt (0 without any)."""
    return pairs.agg(F.count("*").alias("records"), F.count_if(F.col(prompt).rlike(r"[\n\r]\z")).alias("prompts_with_trailing_newline"), F.coalesce(F.max(F.length(prompt)), F.lit(0)).alias("max_prompt_characters"))


def combinations(models: DataFrame, test_sets: DataFrame) -> DataFrame:
    """Each model with each test set: two short lists of names, not rows of data."""
    return models.crossJoin(test_sets)


def looked_up(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key is known. Each side may have any size; Spark sends the shorter one around only if it is small."""
    return rows.join(known.select(key).distinct(), key, "left_semi")


def with_names(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """The rows with the name of their key, empty if it has none. Of repeated keys the smallest name counts."""
    return rows.join(names.groupBy(key).agg(F.min(name).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit("")))


# -- contents


def pii_like(text: Column) -> Column:
    """Whether a text holds what looks like an account number (IBAN) or the number of a card."""
    iban = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
    card = r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])"
    return F.coalesce(text.rlike(iban) | text.rlike(card), F.lit(False))


def calendar_coherent(event_date: Column, year: Column, month: Column, quarter: Column) -> Column:
    """Whether an event falls into the period that a record names; null parts of the period, or no valid date, fit anything."""
    day = F.try_to_date(event_date, "yyyy-M-d")
    return F.coalesce(F.year(day) == year, F.lit(True)) & F.coalesce(F.month(day) == month, F.lit(True)) & F.coalesce(F.quarter(day) == quarter, F.lit(True))


def period_coherent(event_date: Column, period: Column) -> Column:
    """Whether an event falls into the period that a text names: into one of its months, quarters and years, of whichever of these it names any. No text, no named time, or no valid date fits anything."""
    day = F.try_to_date(event_date, "yyyy-M-d")
    own = {"month": F.month(day), "quarter": F.quarter(day), "year": F.year(day)}

    def fits(named: Column) -> Column:
        of = lambda kind: F.filter(named, lambda x: F.startswith(x, F.lit(f"{kind}:")))
        kinds = [(of(kind), F.concat(F.lit(f"{kind}:"), value.cast("string"))) for kind, value in own.items()]
        return reduce(lambda a, b: a & b, ((F.size(some) == 0) | F.array_contains(some, marker) for some, marker in kinds))

    return F.coalesce(bound(times(period, F.array().cast("array<int>")), fits), F.lit(True))


def events_in_order(events: DataFrame, day: str, ties: list[str], name: str) -> DataFrame:
    """The events with their place from 1 by day, those without one last. No task sorts all of them."""
    return numbered(events, [F.col(day).asc_nulls_last(), *(F.col(c).asc() for c in ties)], name)


def event_stats(records: DataFrame, calendar: str = "calendar_context") -> DataFrame:
    """One row: events, different titles and categories, and the first and last date."""
    c = lambda x: F.col(f"{calendar}.{x}")
    return records.where(F.col(calendar).isNotNull()).agg(F.count("*").alias("events"), F.count_distinct(c("event_title")).alias("titles"), F.count_distinct(c("event_category")).alias("categories"), F.min(c("event_date")).alias("first_date"), F.max(c("event_date")).alias("last_date"))


def runs_all_ok(runs: DataFrame, expected: int, end: str = "eog") -> DataFrame:
    """One row: runs, those that ended by themselves, and whether both are as many as expected."""
    found = runs.agg(F.count("*").alias("runs"), F.count_if(F.lower(end) == "yes").alias("ended"))
    return found.withColumn("ok", (F.col("runs") == expected) & (F.col("ended") == expected))


def form_error(beneficiary: Column, amount: Column, currency: Column, category: Column) -> Column:
    """The first of a form's required fields that is blank; null if none is."""
    fields = {"beneficiary": beneficiary, "amount": amount, "currency": currency, "category": category}
    return F.coalesce(*(F.when(c.isNull() | (F.length(strip(c)) == 0), name) for name, c in fields.items()))


def nonblank(rows: DataFrame, measure: str) -> DataFrame:
    """Samples in which the measure is not blank."""
    return rows.where(F.length(strip(F.coalesce(F.col(measure).cast("string"), F.lit("")))) > 0)


def first_rows(rows: DataFrame, seq: str, n: int | None) -> DataFrame:
    """The first ``n`` rows by their number from 0, after all were checked; all without a limit."""
    if n is not None and n <= 0:
        raise ValueError("a limit is positive")
    return rows if n is None else rows.where(F.col(seq) < n)


def all_activities(counts: dict[str, int]) -> dict[str, int]:
    """Expected counts for every activity, nought where none is given."""
    return {name: counts.get(name, 0) for name in ACTIVITIES}
