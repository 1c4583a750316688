"""Cleaning, rules, copies, splits and rendering of transfer records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import format_amount, valid_date
from tessera.functions.text import bound, category_slug, normalised, normalised_for_copies, normalised_items, strip, tokens
from tessera.operators.similar import near_texts
from tessera.operators.stats import numbered
from tessera.session import fresh, materialise

ACTIVITIES = ["GENERATION", "COMPLETION", "NORMALIZATION"]
CURRENCIES = ["EUR", "USD", "GBP"]
FIELDS = ["id_example", "activity_type", "operation_category", "beneficiary", "currency", "reference_period", "input_text", "language"]

# The texts of the prompts.
PROMPTS = {
    "GENERATION": ["Generate exactly two concise and natural bank-transfer descriptions using only the information provided.", "Return two alternative descriptions without adding unsupported information."],
    "COMPLETION": ["Complete the following partially written bank-transfer description.", "Generate exactly two concise and natural completed alternatives using only the information provided."],
    "NORMALIZATION": ["Normalize the following bank-transfer description by making it clear, concise and natural.", "Generate exactly two alternative normalized descriptions while preserving the original meaning and without adding unsupported information."],
}


def cleaned(records: DataFrame) -> DataFrame:
    """Trimmed strings, upper-case codes; amount and split stay as they are."""
    own = {c: strip(F.col(c)) for c in FIELDS}
    own |= {"activity_type": F.upper(own["activity_type"]), "currency": F.upper(own["currency"]), "language": F.lower(own["language"]), "operation_category": category_slug(F.col("operation_category"))}
    context = F.when(F.col("calendar_context").isNotNull(), F.struct(*(strip(F.col(f"calendar_context.{x}")).alias(x) for x in ("event_title", "event_date", "event_category"))))
    return records.withColumns(own | {"expected_output": F.transform("expected_output", strip), "calendar_context": context})


def _empty(c: Column) -> Column:
    return F.length(strip(c)) == 0


def _blank(c: str) -> Column:
    return F.col(c).isNull() | _empty(F.col(c))


def rules() -> list[tuple[str, Column]]:
    """(name, condition of a violation) in the order of the report."""
    activity, calendar, outputs = F.col("activity_type"), F.col("calendar_context"), F.col("expected_output")
    other = activity.isin("COMPLETION", "NORMALIZATION")
    blank_in = lambda x: calendar.isNotNull() & _blank(f"calendar_context.{x}")
    return [
        ("id_string", F.col("id_example").isNull()),
        ("activity_enum", ~F.coalesce(activity.isin(*ACTIVITIES), F.lit(False))),
        ("category_nonempty", _blank("operation_category")),
        ("beneficiary_nonempty", _blank("beneficiary")),
        ("amount_positive", F.col("amount").isNull() | (F.col("amount") <= 0)),
        ("currency_enum", ~F.coalesce(F.col("currency").isin(*CURRENCIES), F.lit(False))),
        ("period_null_or_nonempty", F.col("reference_period").isNotNull() & _blank("reference_period")),
        ("language_en", ~F.col("language").eqNullSafe("en")),
        ("split_null", F.col("split").isNotNull()),
        ("outputs_is_list", outputs.isNull()),
        ("outputs_len2", F.size(outputs) != 2),
        ("outputs_items_nonempty", F.size(F.filter(outputs, lambda x: x.isNull() | _empty(x)))),
        ("outputs_distinct", (F.size(outputs) == 2) & (normalised_for_copies(F.get(outputs, 0)) == normalised_for_copies(F.get(outputs, 1)))),
        ("gen_input_null", (activity == "GENERATION") & F.col("input_text").isNotNull()),
        ("cn_input_nonempty", other & _blank("input_text")),
        ("cn_calendar_null", other & calendar.isNotNull()),
        ("calendar_only_generation", ~activity.eqNullSafe("GENERATION") & calendar.isNotNull()),
        ("calendar_title", blank_in("event_title")),
        ("calendar_category", blank_in("event_category")),
        ("calendar_date", calendar.isNotNull() & valid_date(F.col("calendar_context.event_date")).isNull()),
    ]


def violations(records: DataFrame) -> DataFrame:
    """(id_example, rule): a row for each time that a record breaks a rule, in one pass; a record has one for each bad output."""
    times = lambda name, c: F.array_repeat(F.lit(name), F.coalesce(c if name == "outputs_items_nonempty" else c.cast("int"), F.lit(0)))
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules() if name != "outputs_items_nonempty")))
    items = next(times(name, c) for name, c in rules() if name == "outputs_items_nonempty")
    return records.select("id_example", F.explode(F.concat(broken, items)).alias("rule"))


def duplicate_ids(rows: DataFrame, id_col: str, seq: str, most: int = 20) -> DataFrame:
    """Ids that occur more than once, the first seen first; a report of ``most``."""
    return rows.groupBy(id_col).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq")).where("n > 1").orderBy("first_seq").limit(most)


def missing_ids(rows: DataFrame, id_col: str, last: int) -> DataFrame:
    """Numbers from 1 to ``last`` that no row has."""
    wanted = rows.sparkSession.range(1, last + 1).withColumnRenamed("id", id_col)
    return wanted.join(rows.select(id_col), id_col, "left_anti")


def category_caps(rows: DataFrame, key: str, expected: int, share: float = 0.1) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("exceeds", F.col("n") > share * expected)


def exact_copies(rows: DataFrame, id_col: str, content: list[str], seq: str) -> DataFrame:
    """(id, first_id) of each later row with the content of an earlier one. The content travels as a digest; only the first of each
    digest is joined back, so that large groups are not gathered."""
    key = F.sha2(F.to_json(F.struct(*content)), 256)
    keyed = rows.select(F.col(id_col), F.col(seq).alias("_seq"), key.alias("_key"))
    first = keyed.groupBy("_key").agg(F.min(F.struct("_seq", F.col(id_col).alias("id"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, "_key").where("_seq > first._seq").select(F.col(id_col), F.col("first.id").alias("first_id"))


def near_copies(rows: DataFrame, id_col: str, block: list[str], text: str, threshold: float = 0.93) -> DataFrame:
    """(id_a, id_b, similarity) of texts in one block, a before b, whose ratio reaches the threshold when they are normalised."""
    return near_texts(rows, id_col, block, normalised_for_copies(F.col(text)), threshold)


def stratified_split(rows: DataFrame, id_col: str, strata: list[str], seed: str = "42", train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """``split`` for each row: in each stratum, in the order of a seeded digest, the first share trains, the next validates, the rest tests.
    Sizes are rounded half to even. Rows are numbered by ranges of stratum and digest, so a large stratum is spread over tasks. The same rows are chosen on every
    run, though not those of another generator."""
    at, stratum = fresh(rows, "_number"), fresh(rows, "_stratum")
    keyed = rows.withColumn(stratum, F.struct(*strata, F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))).alias("_digest")))
    kept = numbered(keyed, [stratum], at).withColumn(stratum, F.struct(*(F.col(f"{stratum}.{c}") for c in strata)))
    sizes = kept.groupBy(F.col(stratum).alias("_s")).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    placed = kept.join(sizes, kept[stratum].eqNullSafe(sizes["_s"]))
    place, first = F.col(at) - F.col("_first") + 1, F.bround(F.col("_n") * train)
    split = F.when(place <= first, "train").when(place <= first + F.bround(F.col("_n") * validation), "validation").otherwise("test")
    return placed.withColumn("split", split).drop(at, stratum, "_s", "_first", "_n")


def prompt(activity: str = "activity_type") -> Column:
    """The prompt of a record; a line whose value is null is left out."""
    head = lambda name: F.lit("\n".join(PROMPTS[name]))
    common = [F.concat(F.lit("Category: "), F.col("operation_category")), F.concat(F.lit("Beneficiary: "), F.col("beneficiary")), F.concat(F.lit("Amount: "), format_amount(F.col("amount")), F.lit(" "), F.col("currency")), F.concat(F.lit("Reference period: "), F.col("reference_period"))]
    calendar = F.when(F.col("calendar_context").isNotNull(), F.concat(F.lit("Calendar context:\n- Event: "), F.col("calendar_context.event_title"), F.lit("\n- Date: "), F.col("calendar_context.event_date"), F.lit("\n- Event category: "), F.col("calendar_context.event_category")))
    tails = {"GENERATION": calendar, "COMPLETION": F.concat(F.lit("Partial description: "), F.col("input_text")), "NORMALIZATION": F.concat(F.lit("Original description: "), F.col("input_text"))}
    out = None
    for name in ACTIVITIES:
        text = F.concat_ws("\n", head(name), *common, tails[name])
        out = F.when(F.col(activity) == name, text) if out is None else out.when(F.col(activity) == name, text)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown activity: "), F.col(activity))))


def completion(outputs: str = "expected_output") -> Column:
    """The two outputs as a numbered list. Fails, when it runs, on a list of another length."""
    two = F.concat(F.lit("1. "), strip(F.get(F.col(outputs), 0)), F.lit("\n2. "), strip(F.get(F.col(outputs), 1)))
    return F.when(F.size(outputs) == 2, two).otherwise(F.raise_error(F.lit("a completion takes exactly two outputs")).cast("string"))


def references_contained(text: Column, references: Column) -> Column:
    """All normalised references are part of the normalised text."""
    both = F.struct(normalised(text).alias("text"), normalised_items(references).alias("refs"))
    return bound(both, lambda n: F.forall(n["refs"], lambda r: (r != "") & F.contains(n["text"], r)))


def contained_items(items: DataFrame, rows: DataFrame, item_id: str, item: str, row_id: str, text: str, most_bytes: int = 1 << 24) -> DataFrame:
    """(item_id, row_id), once each, of items that are part of a row's text, whatever the case. An item's anchor is that of its inner words which the fewest rows have:
    where the item is, that word is a word of the text, so anchors are joined to the words of the rows, and the pairs that meet are verified. Items
    without inner words are searched in all rows, in blocks of at most ``most_bytes``; so the set may have any size."""
    own = items.where(F.col(item).isNotNull()).select(F.col(item_id).alias("_item_id"), F.lower(item).alias("_item")).distinct()
    # a word at the beginning or end of an item may be a part of one in a text
    inner = F.array_distinct(F.regexp_extract_all("_item", F.lit(r"(?<=[^\p{L}\p{N}_])[\p{L}\p{N}_]+(?=[^\p{L}\p{N}_])"), 0))
    own = materialise(own.withColumn("_inner", inner), "items")
    anchored = own.where(F.size("_inner") > 0)
    low = rows.select(F.col(row_id).alias("_row_id"), F.lower(text).alias("_low")).where("_low is not null")
    words = low.select("_row_id", F.explode(F.array_distinct(tokens(F.col("_low")))).alias("_word"))
    asked = anchored.select(F.explode("_inner").alias("_word")).distinct()
    met = materialise(words.join(asked, "_word"), "words")
    often = asked.join(met.groupBy("_word").agg(F.count("*").alias("_often")), "_word", "left").select("_word", F.coalesce("_often", F.lit(0)).alias("_often"))
    each = anchored.select("_item_id", "_item", F.explode("_inner").alias("_word")).join(often, "_word")
    anchors = each.groupBy("_item_id", "_item").agg(F.min_by("_word", F.struct("_often", "_word")).alias("_word"))
    pairs = met.join(anchors, "_word").select("_item_id", "_item", "_row_id").distinct()
    found = pairs.join(low, "_row_id").where(F.contains("_low", F.col("_item"))).select("_item_id", "_row_id").distinct()

    bare = own.where(F.size("_inner") == 0).select("_item_id", "_item")
    total = bare.agg(F.sum(F.octet_length("_item") + 64)).first()[0] or 0
    blocks = 0 if not total else 1 if total <= most_bytes else 2 * int(total // most_bytes + 1)  # twice as many, as digests fill them unevenly
    for k in range(blocks):
        part = bare.where(F.pmod(F.xxhash64("_item_id"), F.lit(blocks)) == k) if blocks > 1 else bare
        every = part.agg(F.collect_list(F.struct("_item_id", "_item")).alias("_items"))
        searched = low.join(F.broadcast(every)).select("_row_id", F.explode(F.filter("_items", lambda i: F.contains(F.col("_low"), i["_item"]))).alias("_i"))
        found = found.unionByName(searched.select("_i._item_id", "_row_id"))
    return found.select(F.col("_item_id").alias(item_id), F.col("_row_id").alias(row_id))
