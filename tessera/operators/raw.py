"""Raw JSON records, before they have a schema: which keys they have, of which types their values are, and the rules that they break.

A record read with a schema no longer tells a missing key from a null, nor a number from a text that looks like one. So a raw record
is parsed once, into its keys and values as variants, and these and the types of its values stay beside the typed and trimmed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import valid_date
from tessera.functions.text import normalised_for_copies, strip
from tessera.operators.records import ACTIVITIES, CURRENCIES, FIELDS, cleaned

#: All keys of a record, and of its calendar context.
KEYS = [*FIELDS, "amount", "calendar_context", "expected_output", "split"]
CALENDAR = ["event_title", "event_date", "event_category"]


def kind_of(value: Column) -> Column:
    """``string``, ``number``, ``boolean``, ``array``, ``object`` or ``null`` of a variant; null if there is none."""
    name = F.schema_of_variant(value)
    number = name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    return F.when(name == "STRING", "string").when(number, "number").when(name == "BOOLEAN", "boolean").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").when(name == "VOID", "null")


def _text(value: Column) -> Column:
    """The text of a variant that is one, else null."""
    return F.when(kind_of(value) == "string", F.try_variant_get(value, "$", "string"))


def _once(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns, computed once for each row, however often they are used later: what is exploded is not computed again in the uses. It is made before and only exploded by its name, as Spark
    compiles what a projection computes and not what is exploded."""
    return rows.select(F.array(F.struct(*columns)).alias("_once")).select(F.explode_outer("_once").alias("_once")).select("_once.*")


def _objects(value: Column) -> Column:
    """The objects that a line consists of, as maps of variants, repeated keys and all; null if it does not end like one. A line that is one object has one."""
    inner = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<map<string,variant>>", {"allowSingleQuotes": "false"})
    return F.when(F.endswith(strip(value), F.lit("}")), inner)


def entries(value: Column) -> Column:
    """(key, value) of a line that is one JSON object, in order, the values as variants; null for other lines. This is the one parse of a line: keys, types and values come from it. NaN and Infinity are
    numbers. Repeated keys are all there; an object within that repeats a key makes a line none (``json_lines`` has such lines with the last one of each as ``last``)."""
    return F.get(F.transform(F.filter(F.array(_objects(value)), lambda x: F.size(x) == 1), lambda x: F.map_entries(F.get(x, 0))), 0)


def value_of(entries: str, name: str) -> Column:
    """The value of a key, of a repeated one the last; null if there is none."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(-1))["value"]


def _read(lines: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """The columns of ``parsed`` for each line, with ``readable`` and the columns to keep; what is not readable has nulls. A line is parsed once; the steps after that are projections, which Spark does not merge
    where that would compute a column twice. Fields are found by the place of their key, not by looking through all entries."""
    rows, kept = _once(lines, *keep, _objects(F.col(value)).alias("_objects")), [F.col(c) for c in keep]
    one = F.when(F.size("_objects") == 1, F.get("_objects", F.lit(0)))
    keys, values = F.reverse(F.map_keys(one)), F.reverse(F.map_values(one))  # the last of repeated keys comes first
    at = lambda name: F.get(values, (F.nullif(F.array_position(keys, F.lit(name)), F.lit(0)) - 1).cast("int"))
    rows = rows.select(*kept, one.isNotNull().alias("readable"), F.map_entries(one).alias("entries"), F.array_distinct(F.map_keys(one)).alias("keys"), *(at(x).alias(f"_{x}") for x in KEYS))
    context = F.when(kind_of(F.col("_calendar_context")) == "object", F.try_variant_get("_calendar_context", "$", "map<string,variant>"))
    outputs = F.when(kind_of(F.col("_expected_output")) == "array", F.try_variant_get("_expected_output", "$", "array<variant>"))
    rows = rows.select("*", *(kind_of(F.col(f"_{x}")).alias(f"_{x}_kind") for x in KEYS), context.alias("_context"), outputs.alias("_outputs"))
    within = lambda name: F.col("_context")[name]
    text = lambda name: F.when(F.col(f"_{name}_kind") == "string", F.try_variant_get(f"_{name}", "$", "string"))
    whole = F.transform("_outputs", lambda v: F.when(kind_of(v) == "string", F.try_variant_get(v, "$", "string")).when(kind_of(v) != "null", F.to_json(v)))
    typed = rows.select(
        *kept, "readable", "entries", "keys", F.struct(*(F.col(f"_{x}_kind").alias(x) for x in KEYS)).alias("kinds"), F.struct(*(kind_of(within(x)).alias(x) for x in CALENDAR)).alias("calendar_kinds"),
        F.map_keys("_context").alias("calendar_keys"), *(text(x).alias(x) for x in FIELDS), F.when(F.col("_amount_kind") == "number", F.try_variant_get("_amount", "$", "double")).alias("amount"),
        F.when(F.col("_context").isNotNull(), F.struct(*(_text(within(x)).alias(x) for x in CALENDAR))).alias("calendar_context"),
        F.transform("_outputs", _text).alias("expected_output"), whole.alias("outputs_whole"), F.when(F.col("_split_kind") != "null", F.to_json("_split")).alias("split"),
    )
    return cleaned(typed)


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """(entries, keys, kinds, calendar_keys, calendar_kinds, and the typed fields, trimmed) of each line that is a JSON object; other lines are left out.
    A value of another type than its field's is null as a field; ``kinds`` tells what it was. split is kept as JSON, and so are outputs that are no texts, in outputs_whole."""
    return _read(lines, value, []).where("readable").drop("readable")


def key_difference(keys: Column, expected: list[str]) -> tuple[Column, Column]:
    """(missing, extra): sorted keys that are expected and not there, and the other way round."""
    wanted = F.array(*(F.lit(x) for x in expected))
    return F.sort_array(F.array_except(wanted, keys)), F.sort_array(F.array_except(keys, wanted))


def _given(name: str, kinds: str = "kinds") -> Column:
    """The field is there and not null, of whatever type."""
    return F.coalesce(F.col(f"{kinds}.{name}") != "null", F.lit(False))


def _bare(c: str) -> Column:
    return F.col(c).isNull() | (F.length(strip(F.col(c))) == 0)


def _none(c: str) -> Column:
    """As ``_bare``, of a field that is trimmed."""
    return F.col(c).isNull() | (F.col(c) == "")


def raw_rules() -> list[tuple[str, Column]]:
    """(rule, how often a record breaks it), in the order of the report; ``outputs_items_nonempty`` counts once for each bad item.
    They are on the columns of ``parsed``, with ``_missing`` and ``_extra`` keys."""
    activity, outputs = F.col("activity_type"), F.col("expected_output")
    of = lambda *names: F.coalesce(activity.isin(*names), F.lit(False))
    is_object = F.coalesce(F.col("kinds.calendar_context") == "object", F.lit(False))
    is_list = F.coalesce(F.col("kinds.expected_output") == "array", F.lit(False))
    calendar = lambda x: is_object & _none(f"calendar_context.{x}")
    rules = [
        ("missing_fields", F.size("_missing") > 0),
        ("extra_fields", F.size("_extra") > 0),
        ("id_string", F.col("id_example").isNull()),
        ("activity_enum", ~of(*ACTIVITIES)),
        ("category_nonempty", _none("operation_category")),
        ("beneficiary_nonempty", _none("beneficiary")),
        ("amount_positive", F.col("amount").isNull() | (F.col("amount") <= 0)),
        ("currency_enum", ~F.coalesce(F.col("currency").isin(*CURRENCIES), F.lit(False))),
        ("period_null_or_nonempty", _given("reference_period") & _none("reference_period")),
        ("language_en", ~F.col("language").eqNullSafe("en")),
        ("split_null", _given("split")),
        ("outputs_is_list", ~is_list),
        ("outputs_len2", is_list & (F.size(outputs) != 2)),
        ("outputs_items_nonempty", F.when(is_list, F.size(F.filter(outputs, lambda x: x.isNull() | (x == "")))).otherwise(0)),
        ("outputs_distinct", is_list & (F.size(outputs) == 2) & (normalised_for_copies(F.get("outputs_whole", 0)) == normalised_for_copies(F.get("outputs_whole", 1)))),
        ("gen_input_null", of("GENERATION") & _given("input_text")),
        ("cn_input_nonempty", of("COMPLETION", "NORMALIZATION") & _none("input_text")),
        ("cn_calendar_null", of("COMPLETION", "NORMALIZATION") & _given("calendar_context")),
        ("calendar_only_generation", ~of("GENERATION") & _given("calendar_context")),
        ("calendar_object", _given("calendar_context") & ~is_object),
        ("calendar_keys", is_object & (F.sort_array("calendar_keys") != F.array(*(F.lit(x) for x in sorted(CALENDAR))))),
        ("calendar_title", calendar("event_title")),
        ("calendar_category", calendar("event_category")),
        ("calendar_date", is_object & valid_date(F.col("calendar_context.event_date")).isNull()),
    ]
    return [(name, F.coalesce(c.cast("int"), F.lit(0))) for name, c in rules]


def checked(lines: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(columns to keep, id_example, broken) of each line, in one pass: (rule, detail) for each time that its record breaks a rule, null if the line is no JSON object; detail lists missing
    or extra keys. A record without an id of its own is named ``<missing-id>`` if the key is missing."""
    keep = keep or []
    missing, extra = key_difference(F.col("keys"), KEYS)
    rows = _read(lines, value, keep).select("*", missing.alias("_missing"), extra.alias("_extra"))
    detail = {"missing_fields": F.array_join("_missing", ", "), "extra_fields": F.array_join("_extra", ", ")}
    each = [F.array_repeat(F.struct(F.lit(name).alias("rule"), detail.get(name, F.lit(None).cast("string")).alias("detail")), n) for name, n in raw_rules()]
    name = F.when(F.col("kinds.id_example").isNull(), "<missing-id>").otherwise(F.col("id_example"))
    return _once(rows, *keep, F.when(F.col("readable"), name).alias("id_example"), F.when(F.col("readable"), F.concat(*each)).alias("broken"))


def raw_violations(lines: DataFrame, value: str = "value") -> DataFrame:
    """(id_example, rule, detail): a row for each time that a record breaks a rule, as ``checked`` finds them."""
    return checked(lines, value).select("id_example", F.explode("broken").alias("v")).select("id_example", "v.rule", "v.detail")


# -- rendered rows, and their alignment with raw ones


def rendered_rules() -> list[tuple[str, Column]]:
    """(rule, condition) on rendered rows (keys, prompt, completion)."""
    return [
        ("sft_fields", F.array_sort("keys") != F.array(F.lit("completion"), F.lit("prompt"))),
        ("sft_prompt", _bare("prompt")),
        ("sft_completion", _bare("completion")),
        ("sft_prefix", ~F.coalesce(F.startswith("completion", F.lit("1. ")), F.lit(False))),
        ("sft_second", ~F.coalesce(F.contains("completion", F.lit("\n2. ")), F.lit(False))),
    ]


def rendered_violations(lines: DataFrame, name: str = "id_example", value: str = "value") -> DataFrame:
    """(name, rule) of each rule that a rendered row, a line of JSON, breaks. A line that is no object breaks all."""
    rows = _once(lines, name, entries(F.col(value)).alias("entries"))
    of = lambda x: _text(value_of("entries", x))
    keys = F.array_distinct(F.transform("entries", lambda e: e["key"]))
    rows = rows.select(name, F.coalesce(keys, F.array().cast("array<string>")).alias("keys"), of("prompt").alias("prompt"), of("completion").alias("completion"))
    broken = F.array_compact(F.array(*(F.when(c, F.lit(rule)) for rule, c in rendered_rules())))
    return rows.select(name, F.explode(broken).alias("rule"))


def guarded_raw(keys: Column, outputs: Column) -> Column:
    """Null, or the first reason why a raw record cannot be scored: ``raw_required`` (keys are missing) or ``raw_refs2`` (not two non-empty references)."""
    missing, _ = key_difference(keys, KEYS)
    bad = outputs.isNull() | (F.size(outputs) != 2) | F.exists(outputs, lambda x: x.isNull() | (F.length(strip(x)) == 0))
    return F.when(F.size(missing) > 0, "raw_required").when(F.coalesce(bad, F.lit(True)), "raw_refs2")
