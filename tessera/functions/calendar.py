"""Calendar events: their category by keywords, the period that a text names, and the events near it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numbers import month_number
from tessera.functions.text import collapse

# The words of each category, in the order in which they are tried.
KEYWORDS = {
    "Accommodation": ["hotel", "hostel", "accommodation", "room booking"],
    "Charity": ["charity", "donation", "fundraiser"],
    "Childcare": ["childcare", "daycare", "babysitter", "nursery"],
    "Consulting": ["consulting", "consultation", "consultant"],
    "Course": ["course", "workshop", "lesson", "class"],
    "Dining": ["lunch", "dinner", "restaurant", "brunch", "dining"],
    "Education": ["thesis", "exam", "university", "school", "lecture", "education"],
    "Family": ["family", "family meeting"],
    "Health": ["doctor", "dentist", "dental", "therapy", "physiotherapy", "hospital", "medical", "clinic"],
    "Insurance": ["insurance", "policy renewal", "insurance premium"],
    "Maintenance": ["maintenance", "air conditioner service", "boiler service"],
    "Membership": ["membership", "club renewal", "membership renewal"],
    "Pet care": ["veterinary", "veterinarian", "vet appointment", "pet care"],
    "Professional": ["business meeting", "client meeting", "professional meeting", "work meeting"],
    "Repair": ["repair", "fixing"],
    "Sport": ["yoga", "gym", "fitness", "sport", "football", "tennis", "padel", "swimming"],
    "Travel": ["flight", "airport", "trip", "travel", "vacation", "train journey"],
}
VEHICLES = ["car", "motorcycle", "motorbike", "vehicle", "scooter"]
SERVICES = ["service", "mechanic", "oil change", "tyre", "tire", "inspection"]


def event_category(title: Column) -> Column:
    """The first category with a word that occurs in the title, inside words too; ``Event`` if none does."""
    has = lambda words: F.lower(title).rlike("|".join(words))
    arms = [(has(words), name) for name, words in KEYWORDS.items()] + [(has(VEHICLES) & has(SERVICES), "Vehicle service")]
    return F.coalesce(*(F.when(found, name) for found, name in arms), F.lit("Event"))


def _day(year: Column, month: Column, day: Column) -> Column:
    """A day; days and months beyond the end run on into the next month or year."""
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)


def named_day(period: Column, today: Column) -> Column:
    """The day that a period names (``2026-09-30``, ``30/9/2026``, ``30 September 2026``, or ``30 September`` of this year), else null."""
    text = collapse(period)
    part = lambda pattern, k: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, k))
    number = lambda pattern, k: part(pattern, k).try_cast("int")
    iso, slashes, words, short = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2}) ([A-Za-z]+) (\d{4})$", r"^(\d{1,2}) ([A-Za-z]+)$"
    return F.coalesce(
        _day(number(iso, 1), number(iso, 2), number(iso, 3)), _day(number(slashes, 3), number(slashes, 2), number(slashes, 1)),
        _day(number(words, 3), month_number(part(words, 2)), number(words, 1)), _day(F.year(today), month_number(part(short, 2)), number(short, 1)),
    )


def named_month(period: Column, today: Column) -> Column:
    """``yyyy-MM`` of ``September 2026``, or ``September`` of this year, else null."""
    text = collapse(period)
    pattern = r"^([A-Za-z]+) (\d{4})$"
    year = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 2)).try_cast("int")
    first = F.coalesce(_day(year, month_number(F.regexp_extract(text, pattern, 1)), F.lit(1)), _day(F.year(today), month_number(text), F.lit(1)))
    return F.date_format(first, "yyyy-MM")


def event_day(millis: Column, all_day: Column, zone: str = "UTC") -> Column:
    """The day of an event: in UTC if it lasts all day, else in the user's zone."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(millis).cast("timestamp_ntz"))
    return F.when(F.coalesce(all_day, F.lit(False)), utc.cast("date")).otherwise(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("date"))


def shown_calendar(name: Column, title: Column) -> Column:
    """Events with a title, of calendars other than those of holidays."""
    return ~F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit("holiday")) & (F.length(collapse(F.coalesce(title, F.lit("")))) > 0)
