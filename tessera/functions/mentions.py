"""Amounts of money and points in time that a text names, by built-in expressions: what a pattern finds becomes an array of hits with their places, and what counts is
decided by tests on the places and on the text around them. ``markers`` has the same rules as plain functions of one text.

Defined cases: a null text names nothing; amounts are in the order of lines, and in a line those after their currency come first; points in time are each named once, in order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.markers import CODES_ONLY, CONTEXT, CUE_REACH, CUES, ISO_DATE, MONTH_NUMBERS, MONTH_REACH, NUMBER, ORDINALS, SIGNS, YEAR, Style
from tessera.functions.numbers import parse_money
from tessera.functions.text import bound, split_lines

#: What marks a match.
MARK = "\x01"

# Python's \b and \d take all letters and digits, and so does (?U)
_MONTH = rf"\b(?:{'|'.join(sorted(MONTH_NUMBERS, key=len, reverse=True))})\b"
# what comes first at a place is tested once for all kinds
_TIME = rf"(?U)\b(?:q[1-4]\b|(?:{'|'.join(ORDINALS.values())})\s+(?:installment|instalment)\b|(?:{'|'.join(sorted(MONTH_NUMBERS, key=len, reverse=True))})\b)|(?=20)(?:{ISO_DATE}|{YEAR})"
_CUE = rf"(?iU){_MONTH}|{CUES}"
_CONTEXT = rf"(?iU){YEAR}|{ISO_DATE}|{CONTEXT}"


def places(text: Column, pattern: str) -> Column:
    """(hit, start, end) of each match of a pattern in a text, places counted from 0. Matches are marked on both sides and the text is cut at the marks, so what lies between them tells
    their places. (A cut at a pattern would compile it for each row.) A mark in the text itself counts as another control character."""
    marked = F.split(F.regexp_replace(F.translate(text, MARK, "\x02"), pattern, f"{MARK}$0{MARK}"), MARK)

    def of(parts: Column) -> Column:
        def step(got: Column, k: Column) -> Column:
            start = F.coalesce(F.try_element_at(got, F.lit(-1))["end"], F.lit(0)) + F.length(F.get(parts, 2 * k))
            return F.concat(got, F.array(bound(start, lambda at: F.struct(F.get(parts, 2 * k + 1).alias("hit"), at.alias("start"), (at + F.length(F.get(parts, 2 * k + 1))).alias("end")))))

        none = F.array().cast("array<struct<hit:string,start:int,end:int>>")
        return F.when(F.size(parts) > 1, F.aggregate(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), none, step)).otherwise(none)

    return bound(marked, of)


def around(text: Column, start: Column, end: Column, reach: int) -> Column:
    """The text from ``reach`` characters before a place to as many after it."""
    low = F.greatest(start - reach, F.lit(0))
    return F.substr(text, low + 1, end + reach - low)


def _meant_as_year(text: Column, hit: Column, known: Column) -> Column:
    return F.array_contains(known, F.substring(hit["hit"], 1, 4).cast("int")) | around(text, hit["start"], hit["end"], CUE_REACH).rlike(_CUE)


def _priced(text: Column, hit: Column, known: Column, style: Style) -> Column:
    """Whether what looks like a year is an amount of money."""
    low = F.greatest(hit["start"] - style.reach, F.lit(0))
    before = F.substr(text, low + 1, hit["start"] - low).rlike(rf"(?iU){style.before}{style.code}[ \t]*\z")
    after = F.substr(text, hit["end"] + 1, F.lit(style.reach)).rlike(rf"(?iU)\A[ \t]*{style.code}{style.after}")
    return before | (after & ~_meant_as_year(text, hit, known))


def times(text: Column, known_years: Column, style: Style = CODES_ONLY, months: Column | None = None) -> Column:
    """Quarters, months, instalments and years in a text. A year after a currency is money; before one it must be known or words near it speak of time. With ``months`` a month must be
    among them or near a year or a word of time, as names of people may be like months."""
    numbers = F.create_map(*(F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair))

    def names(low: Column, hit: Column) -> Column:
        word = hit["hit"]
        number = F.try_element_at(numbers, word)
        timely = F.lit(True) if months is None else F.array_contains(months, number) | around(low, hit["start"], hit["end"], MONTH_REACH).rlike(_CONTEXT)
        ordinal = F.concat(F.lit("installment:"), F.coalesce(*(F.when(word.rlike(f"^(?:{words})"), name) for name, words in ORDINALS.items())))
        date = F.array(F.concat(F.lit("year:"), F.substring(word, 1, 4)), F.concat(F.lit("month:"), F.substring(word, 6, 2).cast("int").cast("string")))
        month = F.when(timely, F.array(F.concat(F.lit("month:"), number.cast("string"))))
        year = F.when(~_priced(low, hit, known_years, style), F.array(F.concat(F.lit("year:"), word)))
        return F.when(F.startswith(word, F.lit("q")), F.array(F.concat(F.lit("quarter:"), F.substring(word, 2, 1)))).when(number.isNotNull(), month).when(word.rlike("instal"), F.array(ordinal)).when(F.length(word) == 10, date).otherwise(year)

    found = lambda low: F.flatten(F.array_compact(F.transform(places(low, _TIME), lambda hit: names(low, hit))))
    return F.array_sort(F.array_distinct(bound(F.lower(F.coalesce(text, F.lit(""))), found)))


def money(text: Column, known_years: Column, style: Style = CODES_ONLY) -> Column:
    """(currency, amount) in the lines of a text: first those of a line that begin with the currency, then those that end with it and overlap none.
    A year before a currency is no amount if it is known or words near it speak of time."""
    first = rf"(?iU){style.before}{style.code}[ \t]*{NUMBER}(?![\d.,])"
    last = rf"(?iU)(?<![\d.,]){NUMBER}[ \t]*{style.code}{style.after}"
    signs = F.create_map(*(F.lit(x) for pair in SIGNS.items() for x in pair))

    def amount(hit: Column) -> Column:
        code = F.upper(F.regexp_extract(hit["hit"], f"(?i){style.code}", 0))
        return F.struct(F.coalesce(F.try_element_at(signs, code), code).alias("currency"), parse_money(F.regexp_extract(hit["hit"], rf"(?U){NUMBER}", 0)).alias("amount"))

    def of(line: Column) -> Column:
        def both(sure: Column) -> Column:
            apart = lambda x: F.forall(sure, lambda s: (x["end"] <= s["start"]) | (x["start"] >= s["end"]))
            # the number is what a hit begins with
            year = lambda x: x["hit"].rlike(rf"(?iU)\A20\d{{2}}[ \t]*{style.code}\z") & _meant_as_year(line, F.struct(x["hit"].alias("hit"), x["start"].alias("start"), (x["start"] + 4).alias("end")), known_years)
            return F.concat(sure, F.filter(places(line, last), lambda x: apart(x) & ~year(x)))

        # most lines name no currency
        named = F.upper(line).rlike("|".join(re.escape(x) for x in (*SIGNS.values(), *(SIGNS if style is not CODES_ONLY else ()))))
        found = F.transform(bound(places(line, first), both), amount)
        return F.when(named, found)

    return F.flatten(F.array_compact(F.transform(split_lines(F.coalesce(text, F.lit(""))), of)))
