"""Functions on amounts, dates and measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import MONTHS, strip


def format_amount(c: Column) -> Column:
    """Two decimals at most, without trailing noughts."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", c.cast("double")), "0+$", ""), r"\.$", "")


def parse_money(c: Column) -> Column:
    """A number as people write it. With a comma and a point the last is the decimal mark; a single kind of mark before groups of three digits
    parts thousands, else it is the decimal mark."""
    text = F.regexp_replace(c, r"\s+", "")
    comma, point = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
    last_comma, last_point = F.length(F.substring_index(text, ",", -1)), F.length(F.substring_index(text, ".", -1))
    bare = (
        F.when(comma & point & (last_comma < last_point), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & point, F.replace(text, F.lit(","), F.lit("")))
        .when(text.rlike(r"^\d{1,3}(,\d{3})+$"), F.replace(text, F.lit(","), F.lit("")))
        .when(comma, F.replace(text, F.lit(","), F.lit(".")))
        .when(text.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(text, F.lit("."), F.lit("")))
        .otherwise(text)
    )
    return bare.try_cast("double")


def locale_number(c: Column) -> Column:
    """A number with a decimal comma or point; null if blank or not a number."""
    return F.nullif(F.replace(strip(c), F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def plain_year(c: Column) -> Column:
    return F.when(strip(c).rlike(r"^20\d\d$"), strip(c).cast("int"))


def month_number(c: Column) -> Column:
    """1 to 12 for a month's name or its first three letters (also ``sept``)."""
    names = {name: k for k, name in enumerate(MONTHS, 1)} | {name[:3]: k for k, name in enumerate(MONTHS, 1)} | {"sept": 9}
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.try_element_at(table, F.lower(strip(c)))


def currencies(c: Column) -> Column:
    """The codes EUR, USD and GBP in the text, and those of the signs of these currencies."""
    signs = F.create_map(*(F.lit(x) for pair in (("€", "EUR"), ("$", "USD"), ("£", "GBP")) for x in pair))
    found = F.regexp_extract_all(F.upper(c), F.lit(r"\b(?:EUR|USD|GBP)\b|[€$£]"), 0)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.coalesce(F.try_element_at(signs, x), x))))


def valid_date(c: Column) -> Column:
    return F.try_to_date(c, "yyyy-M-d")


def pct_change(first: Column, last: Column) -> Column:
    return (last - first) / F.nullif(first, F.lit(0.0)) * 100


def rate(count: Column, ms: Column) -> Column:
    """Per second. What took no time at all, or too little for a number of seconds, has an infinite rate with the signs of both, and nothing in no time none (NaN)."""
    seconds = ms / 1000.0
    instant = F.signum(count) * F.when(seconds.cast("string").startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(seconds == 0, instant).otherwise(count / F.nullif(seconds, F.lit(0.0)))


def rounded(x: Column, digits: int) -> Column:
    """Rounded as a whole number of units of the last digit, by binary arithmetic as in SQL. ``round`` looks at the shortest decimal, so it leaves numbers with no more digits than that as they are."""
    moved = F.round(x * 10.0**digits) / 10.0**digits
    return F.when(F.abs(moved) < float("inf"), moved).otherwise(x)


def throughput(count: Column, ms: Column) -> Column:
    """Per second, nought without time."""
    return F.when(ms > 0, rate(count, ms)).otherwise(0.0)


def hit_limit(seen_end: Column, generated: Column, most: Column) -> Column:
    return ~seen_end & (generated >= most)


def near_event(event: Column, reference: Column | None, month: Column | None, today: Column) -> Column:
    """Within three days of a reference date, else in the reference month, else within a week of today."""
    by_day = F.abs(F.datediff(event, reference)) <= 3 if reference is not None else F.lit(None)
    by_month = F.date_format(event, "yyyy-MM") == month if month is not None else F.lit(None)
    return F.coalesce(by_day, by_month, F.abs(F.datediff(event, today)) <= 7)
