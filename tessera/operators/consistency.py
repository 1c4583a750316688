"""Whether a reply says what its record says: currency, amount, time, beneficiary, calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.alternatives import alternatives, markdown_alternatives_udf
from tessera.functions.markers import CODES_ONLY, SIGNS, WITH_SIGNS, months_of, years_of
from tessera.functions.mentions import money, times
from tessera.functions.text import contains_normalised, normalised, strip
from tessera.session import ship

#: How far an amount may be off: absolute, and relative to the larger one.
OFF, OFF_SHARE = 0.011, 1e-9


def consistency(records: DataFrame, reply: str, signs: bool = False) -> DataFrame:
    """``records`` with flags on the whole reply: ``currency_consistent``, ``amount_consistent``, ``temporal_consistent``,
    ``structured_consistent`` (all three, and an alternative was found), ``beneficiary_mentioned``, ``calendar_reflected`` (null without a calendar).
    A null reply says nothing, so nothing in it is wrong, but it has no alternative. Temporary columns begin with ``_c_``.
    With ``signs``, for replies with Markdown: signs of currencies count, and names of months only if the record has them or words near them speak of time."""
    ship(records.sparkSession)  # for compatibility forms and Markdown
    calendar = F.col("calendar_context")
    events = [F.when(calendar.isNotNull(), F.col(f"calendar_context.{x}")) for x in ("event_title", "event_date", "event_category")]
    given = F.concat_ws(" ", "reference_period", *events)
    source = F.concat_ws(" ", "operation_category", "beneficiary", "reference_period", "input_text", *events)
    style, none = (WITH_SIGNS if signs else CODES_ONLY), F.array().cast("array<int>")
    limited = lambda c: months_of(F.col(c)) if signs else None
    rows = records.withColumn("_c_text", strip(F.coalesce(F.col(reply), F.lit("")))).withColumn("_c_sure", times(given, none, style))
    # what the record allows: by what it gives, and by all that it says
    rows = rows.withColumn("_c_allowed", F.array_union("_c_sure", times(source, years_of(F.col("_c_sure")), style, limited("_c_sure"))))
    rows = rows.withColumn("_c_years", years_of(F.col("_c_allowed")))
    rows = rows.withColumns({"_c_times": times(F.col("_c_text"), F.col("_c_years"), style, limited("_c_allowed")), "_c_money": money(F.col("_c_text"), F.col("_c_years"), style), "_c_event": times(events[1], none, style)})
    codes = F.regexp_extract_all(F.upper("_c_text"), F.lit(r"(?U)(?<![A-Z])(?:EUR|USD|GBP|[€$£])(?![A-Z])" if signs else r"(?U)\b(?:EUR|USD|GBP)\b"), 0)
    codes = F.transform(codes, lambda x: F.coalesce(*(F.when(x == sign, code) for sign, code in SIGNS.items()), x))
    wanted, amount = F.upper("currency"), F.col("amount").cast("double")
    near = lambda x: F.abs(x - amount) <= F.greatest(F.lit(OFF), OFF_SHARE * F.greatest(F.abs(x), F.abs(amount)))
    titles = F.filter(F.split(normalised(events[0]), " "), lambda x: F.length(x) >= 4)
    said = F.arrays_overlap(titles, F.split(normalised(F.col("_c_text")), " ")) | F.arrays_overlap("_c_event", "_c_times")
    rows = rows.withColumns(
        {
            "currency_consistent": F.forall(codes, lambda x: x == wanted),
            "amount_consistent": F.forall("_c_money", lambda m: (m["currency"] == wanted) & near(m["amount"])),
            "temporal_consistent": F.size(F.array_except("_c_times", "_c_allowed")) == 0,
            "beneficiary_mentioned": contains_normalised(F.col("_c_text"), F.col("beneficiary")),
            "calendar_reflected": F.when(calendar.isNotNull(), F.coalesce(said, F.lit(False))),
        }
    )
    fine = F.col("currency_consistent") & F.col("amount_consistent") & F.col("temporal_consistent") & (F.size(markdown_alternatives_udf(reply) if signs else alternatives(F.col(reply))) > 0)
    return rows.withColumn("structured_consistent", fine).drop("_c_text", "_c_sure", "_c_allowed", "_c_years", "_c_times", "_c_money", "_c_event")
