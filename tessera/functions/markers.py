"""Amounts of money and points in time that a text names: the rules as plain functions of one text, and their patterns. ``mentions`` has them for columns."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import MONTHS

# Codes of currencies, ordinals of instalments, how numbers, dates and years are written, the words near a number or a name of a month that
# make it a point in time, and how many characters away they may stand.
CODES = "(?:EUR|USD|GBP)"
ORDINALS = {"first": "first|1st", "second": "second|2nd", "third": "third|3rd", "final": "final"}
NUMBER = r"(?:\d{1,3}(?:[ ,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
ISO_DATE = r"(?<!\d)(20\d{2})-(0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d)"
YEAR = r"(?<![\d.,])20\d{2}(?![\d.,])"
CUES = r"\bq[1-4]\b|\b(?:year|term|semester|installment|instalment)\b"
CONTEXT = r"\b(?:month|monthly|period|term|semester|quarter|due)\b"
CUE_REACH, MONTH_REACH = 24, 20
SIGNS = {"€": "EUR", "$": "USD", "£": "GBP"}
#: As far from a year a currency is looked for, without and with signs.
CODE_REACH, SIGN_REACH = 8, 10

MONTH_NUMBERS = {name[:k]: n for n, name in enumerate(MONTHS, 1) for k in (3, len(name))} | {"sept": 9}
_MONTH = rf"\b(?:{'|'.join(sorted(MONTH_NUMBERS, key=len, reverse=True))})\b"
_cue = re.compile(f"{_MONTH}|{CUES}", re.I)
_context = re.compile(f"{YEAR}|{ISO_DATE}|{CONTEXT}", re.I)
_ordinal = "|".join(rf"(?P<{name}>{words})" for name, words in ORDINALS.items())
#: A point in time of any kind; kinds do not overlap.
_time = re.compile(rf"\bq(?P<quarter>[1-4])\b|\b(?:{_ordinal})\s+(?:installment|instalment)\b|(?P<month>{_MONTH})|(?P<date>{ISO_DATE})|(?P<year>{YEAR})")


class Style(NamedTuple):
    """How currencies are written: the pattern of one, what may not touch it, and how far from a year one is looked for."""

    code: str
    before: str
    after: str
    reach: int


CODES_ONLY = Style(CODES, r"\b", r"\b", CODE_REACH)
WITH_SIGNS = Style(r"(?:EUR|USD|GBP|€|\$|£)", "(?<![A-Za-z])", "(?![A-Za-z])", SIGN_REACH)


def amount_of(number: str) -> float:
    """A number with marks; see ``numbers.parse_money``."""
    bare = number.strip().replace(" ", "")
    marks = [x for x in bare if x in ",."]
    if len(set(marks)) == 2:
        return float("".join(bare.split(min(",.", key=bare.rfind))).replace(",", "."))
    if marks and re.fullmatch(r"\d{1,3}(?:[,.]\d{3})+", bare):
        return float(bare.replace(marks[0], ""))
    return float(bare.replace(",", "."))


def _meant_as_year(text: str, start: int, end: int, known: set[int]) -> bool:
    return int(text[start:end]) in known or bool(_cue.search(text[max(0, start - CUE_REACH) : end + CUE_REACH]))


def money_in(text: str | None, known_years: set[int], style: Style = CODES_ONLY) -> list[tuple[str, float]]:
    """(currency, amount) in the lines of a text: first those of a line that begin with the currency, then those that end with it and overlap none.
    A year before a currency is no amount if it is known or words near it speak of time."""
    first = rf"{style.before}(?P<code>{style.code})[ \t]*(?P<number>{NUMBER})(?![\d.,])"
    last = rf"(?<![\d.,])(?P<number>{NUMBER})[ \t]*(?P<code>{style.code}){style.after}"
    found = []
    for line in (text or "").splitlines():
        sure = list(re.finditer(first, line, re.I))
        apart = [x for x in re.finditer(last, line, re.I) if all(x.end() <= s.start() or x.start() >= s.end() for s in sure)]
        years = [x for x in apart if re.fullmatch(r"20\d{2}", x["number"]) and _meant_as_year(line, *x.span("number"), known_years)]
        found += [(SIGNS.get(x["code"], x["code"].upper()), amount_of(x["number"])) for x in sure + apart if x not in years]
    return found


def times_in(text: str | None, known_years: set[int], style: Style = CODES_ONLY, months: set[int] | None = None) -> set[str]:
    """Quarters, months, instalments and years in a text, in one pass over them. A year after a currency is money; before one it must be known or words near it speak of time.
    With ``months`` a month must be among them or near a year or a word of time, as names of people may be like months."""
    low, found = (text or "").lower(), set()
    for hit in _time.finditer(low):
        start, end = hit.span()
        if hit["quarter"]:
            found.add(f"quarter:{hit['quarter']}")
        elif hit["month"]:
            number = MONTH_NUMBERS[hit["month"]]
            if months is None or number in months or _context.search(low[max(0, start - MONTH_REACH) : end + MONTH_REACH]):
                found.add(f"month:{number}")
        elif hit["date"]:
            found |= {f"year:{hit['date'][:4]}", f"month:{int(hit['date'][5:7])}"}
        elif hit["year"]:
            if not _priced(low, start, end, known_years, style):
                found.add(f"year:{hit['year']}")
        else:
            found |= {f"installment:{name}" for name in ORDINALS if hit[name]}
    return found


def _priced(low: str, start: int, end: int, known_years: set[int], style: Style) -> bool:
    """Whether what looks like a year is an amount of money."""
    if re.search(rf"{style.before}{style.code}[ \t]*\Z", low[max(0, start - style.reach) : start], re.I):
        return True
    return bool(re.match(rf"[ \t]*{style.code}{style.after}", low[end : end + style.reach], re.I)) and not _meant_as_year(low, start, end, known_years)


def years_of(times: Column) -> Column:
    """The years among markers."""
    return F.transform(F.filter(times, lambda x: x.startswith("year:")), lambda x: F.substring(x, 6, 4).cast("int"))


def months_of(times: Column) -> Column:
    """The months among markers."""
    return F.transform(F.filter(times, lambda x: x.startswith("month:")), lambda x: F.substring(x, 7, 2).cast("int"))
