"""Queries on whole sets of records: raw JSON and its rules, constraints, splits, alignment, summaries of runs; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import compare as O
from tessera.operators import datasets as D
from tessera.operators import raw as W
from tessera.operators import records as R
from tessera.operators import stats as S
from tessera.operators.profile import tallies
from tessera.plans.queries import RECORDS, RUNS, query, runs, stratified_split, table, transfer_records
from tessera.plans.reviews import _norm
from tessera.session import materialise, shared_path
from tessera.sources import jsonl as J
from tessera.sources import readers as I
from tessera.streaming.metrics import DONE, FAILED, distinct_runs, windowed
from tessera.streaming.monitor import monitored

# -- raw records: of forty records in a row, one breaks each rule in its own way


def raw_lines(spark: SparkSession, sf_dir: str, records: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """(value, and what is kept of the records): the records as lines of JSON, in which the record's number, modulo 40, decides what is wrong with it."""
    v, q = F.col("seq") % 40, lambda c: F.to_json(F.struct(F.col(c).alias("x")))
    text = lambda c: F.coalesce(F.regexp_extract(q(c), r'^\{"x":(.*)\}$', 1), F.lit("null"))
    plain = lambda c: F.when(F.col(c).isNull(), "null").otherwise(text(c))

    def field(name: str, usual, odd: dict[int, str], absent: int | None = None):
        value = usual
        for k, other in odd.items():
            value = F.when(v == k, other).otherwise(value)
        pair = F.concat(F.lit(f'"{name}":'), value)
        return pair if absent is None else F.when(v != absent, pair)

    generation = F.col("activity_type") == "GENERATION"
    parts = [
        field("id_example", plain("id_example"), {2: "7"}),
        field("activity_type", plain("activity_type"), {3: '"OTHER"', 4: "null"}),
        field("operation_category", plain("operation_category"), {5: '"  "'}),
        field("beneficiary", plain("beneficiary"), {6: "5"}),
        field("amount", F.greatest(F.col("amount"), F.lit(1.0)).cast("decimal(18,2)").cast("string"), {7: "true", 8: "-1.5", 9: '"12"'}),
        field("currency", F.when(F.col("currency") == "CHF", '"EUR"').otherwise(plain("currency")), {10: '"CHF"'}),
        field("reference_period", plain("reference_period"), {11: '""', 12: "3", 13: "null"}),
        field("input_text", F.when(generation, "null").otherwise(plain("input_text")), {14: '" "'}),
        field("calendar_context", F.coalesce(F.to_json("calendar_context"), F.lit("null")), {15: "[1]", 16: '{"event_title":"t","event_date":"2026-02-30"}', 17: '{"event_title":" ","event_date":"2026-2-3","event_category":"c"}'}),
        field("expected_output", F.to_json("expected_output"), {18: '"text"', 19: '["a"]', 20: '["", " "]', 21: '["A-b","a b"]'}),
        field("language", F.lit('"en"'), {22: '" EN "', 23: '"it"'}, absent=0),
        field("split", F.lit("null"), {24: '"train"'}),
        F.when(v == 1, F.lit('"note":1')),
    ]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return (transfer_records(spark, sf_dir) if records is None else records).select(F.when(v == 25, "[1]").when(v == 26, "{bad").otherwise(whole).alias("value"), *(keep or []))


_G = "activity_type = 'GENERATION'"
_RAW = [
    ("0", "missing_fields", "'language'"), ("0", "language_en", "NULL"), ("1", "extra_fields", "'note'"), ("3, 4", "activity_enum", "NULL"), (f"3, 4) AND (has_calendar", "calendar_only_generation", "NULL"),
    ("5", "category_nonempty", "NULL"), ("6", "beneficiary_nonempty", "NULL"), ("7, 8, 9", "amount_positive", "NULL"), ("10", "currency_enum", "NULL"), ("11, 12", "period_null_or_nonempty", "NULL"),
    (f"14) AND ({_G}", "gen_input_null", "NULL"), (f"14) AND (NOT {_G}", "cn_input_nonempty", "NULL"), ("15", "calendar_object", "NULL"), (f"15, 16, 17) AND (NOT {_G}", "cn_calendar_null", "NULL"),
    (f"15, 16, 17) AND (NOT {_G}", "calendar_only_generation", "NULL"), ("16", "calendar_keys", "NULL"), ("16", "calendar_category", "NULL"), ("16", "calendar_date", "NULL"), ("17", "calendar_title", "NULL"),
    ("18", "outputs_is_list", "NULL"), ("19", "outputs_len2", "NULL"), ("20", "outputs_items_nonempty", "NULL"), ("20", "outputs_items_nonempty", "NULL"), ("20, 21", "outputs_distinct", "NULL"), ("23", "language_en", "NULL"), ("24", "split_null", "NULL"),
]


@query(f"WITH {RECORDS} SELECT NULL AS id_example, 'id_string' AS rule, CAST(NULL AS VARCHAR) AS detail FROM rec WHERE seq % 40 = 2" + "".join(f" UNION ALL SELECT id_example, '{rule}', {detail} FROM rec WHERE (seq % 40 IN ({which}))" for which, rule, detail in _RAW))
def raw_record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.raw_violations(raw_lines(spark, sf_dir))


def lines_of_all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): records as lines of JSON that only a lenient reader takes, and lines that none takes; the record's number, modulo 12, decides."""
    k, v = F.col("seq"), F.col("seq") % 12
    amount = {0: '"amount":true,"amount":5', 1: '"amount":5,"amount":"5"', 2: '"amount":NaN', 3: '"amount":Infinity', 4: '"amount":-Infinity', 5: '"amount":{"amount":[5]}', 6: '"amount":123456789012345678901234567890.5', 7: '"amount":0,"amount":1e400'}
    chosen = F.lit('"amount":12.5')
    for n, text in amount.items():
        chosen = F.when(v == n, text).otherwise(chosen)
    context = F.when(v == 8, '{"event_title":"t","event_title":"","event_date":"2026-02-03","event_category":{"x":1}}').when(v == 9, "[1]").otherwise("null")
    outputs = F.when(v == 10, '[["a"],{"b":NaN}]').otherwise('["one thing","another"]')
    head = F.concat(F.lit('{"id_example":"'), F.col("id_example"), F.lit('","activity_type":"GENERATION","operation_category":"C","beneficiary":"B","currency":"EUR","reference_period":null,"input_text":null,"language":"en","split":null,'))
    whole = F.concat(head, chosen, F.lit(',"calendar_context":'), context, F.lit(',"expected_output":'), outputs, F.lit("}"))
    value = F.when(v == 11, F.when(k % 36 == 11, F.lit("\t\u00a0")).when(k % 36 == 23, F.concat(whole, F.lit(" x"))).otherwise(F.concat(F.lit("[]"), whole))).otherwise(F.concat(F.lit(" \t"), whole, F.lit("\x0b")))
    # the lines are many times as long as the records, so as few tasks as read these would write few files
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return transfer_records(spark, sf_dir).repartition(tasks).select(value.alias("value"))


@query(f"""WITH {RECORDS} SELECT id_example, r.rule, CAST(NULL AS VARCHAR) AS detail FROM rec, (VALUES (1, 'amount_positive'), (4, 'amount_positive'), (5, 'amount_positive'), (8, 'calendar_title'), (8, 'calendar_category'), (9, 'calendar_object'), (10, 'outputs_items_nonempty'), (10, 'outputs_items_nonempty')) r(v, rule) WHERE seq % 12 = r.v
UNION ALL SELECT NULL, CASE WHEN seq % 36 = 11 THEN 'Empty line' ELSE 'Invalid JSON' END, CAST(count(*) AS VARCHAR) FROM rec WHERE seq % 12 = 11 GROUP BY 2""")
def raw_rules_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on lines as files have them: written as a batch, read back with their numbers, and parsed once."""
    path = shared_path(spark, "lines")
    lines_of_all_forms(spark, sf_dir).write.format(J.source(spark)).option("path", path).option("batch", "all").mode("append").save()
    read = materialise(J.json_lines(spark, path).select("line", "error", F.coalesce("last", "value").alias("value")), "lines-read")
    errors = read.where("error is not null").groupBy("error").agg(F.count("*").cast("string").alias("detail")).select(F.lit(None).cast("string").alias("id_example"), F.col("error").alias("rule"), "detail")
    return W.raw_violations(read.where("error is null").select("value")).unionByName(errors)


def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_example, value): rendered rows as lines of JSON, of which the record's number, modulo 11, decides what is wrong."""
    v = F.col("seq") % 11
    done = F.when(v == 1, "").when(v == 2, F.concat(F.lit("x"), R.completion())).when(v == 3, F.replace(R.completion(), F.lit("\n2. "), F.lit(" 2. "))).otherwise(R.completion())
    row = F.struct(F.when(v == 4, F.lit(None).cast("string")).otherwise(F.lit("a prompt")).alias("prompt"), done.alias("completion"), F.when(v == 5, 1).alias("extra"))
    return transfer_records(spark, sf_dir).select("id_example", "seq", F.when(v == 6, "[]").otherwise(F.to_json(row)).alias("value"))


_SFT = [("4, 5, 6", "sft_fields"), ("4, 6", "sft_prompt"), ("1, 6", "sft_completion"), ("1, 2, 6", "sft_prefix"), ("1, 3, 6", "sft_second")]


@query(f"WITH {RECORDS} " + " UNION ALL ".join(f"SELECT id_example, '{rule}' AS rule FROM rec WHERE seq % 11 IN ({which})" for which, rule in _SFT))
def sft_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rendered_violations(rendered_lines(spark, sf_dir))


@query(f"WITH {RECORDS} SELECT id_example, CASE WHEN seq % 40 IN (0) THEN 'raw_required' WHEN seq % 40 IN (18, 19, 20) THEN 'raw_refs2' END AS problem FROM rec WHERE seq % 40 NOT IN (2, 25, 26)")
def raw_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.parsed(raw_lines(spark, sf_dir)).where("id_example is not null")
    return rows.select("id_example", W.guarded_raw(F.col("keys"), F.col("expected_output")).alias("problem"))


# -- constraints on the whole set


@query(f"""WITH {RECORDS}, t AS (SELECT *, CASE WHEN seq % 50 = 7 THEN 'EX0000008' ELSE id_example END AS id FROM rec),
c AS (SELECT count(*) AS n, count_if(activity_type = 'GENERATION' AND has_calendar) AS w, count_if(activity_type = 'GENERATION' AND NOT has_calendar) AS o FROM t)
SELECT 'total_count' AS rule, 'expected 5000, found ' || n AS detail FROM c WHERE n <> 5000
UNION ALL SELECT 'calendar_quota_with', 'expected 1000, found ' || w FROM c WHERE w <> 1000 UNION ALL SELECT 'calendar_quota_without', 'expected 1000, found ' || o FROM c WHERE o <> 1000
UNION ALL SELECT 'duplicate_ids', string_agg(id, ', ' ORDER BY f) FROM (SELECT id, min(seq) AS f FROM t GROUP BY id HAVING count(*) > 1 ORDER BY f LIMIT 20) HAVING count(*) > 0
UNION ALL SELECT 'missing_ids', string_agg(id, ', ' ORDER BY id) FROM (SELECT 'EX' || lpad(CAST(i AS VARCHAR), 7, '0') AS id FROM generate_series(1, 5000) g(i) WHERE 'EX' || lpad(CAST(i AS VARCHAR), 7, '0') NOT IN (SELECT id FROM t) ORDER BY id LIMIT 20) HAVING count(*) > 0
UNION ALL SELECT 'activity_quota', a || ': expected ' || e || ', found ' || n FROM (SELECT a, e, (SELECT count(*) FROM t WHERE activity_type = a) AS n FROM (VALUES ('GENERATION', 2000), ('COMPLETION', 1500), ('NORMALIZATION', 1500)) q(a, e)) WHERE n <> e
UNION ALL SELECT 'min_categories', 'expected 25 at least, found ' || count(DISTINCT operation_category) FROM t HAVING count(DISTINCT operation_category) < 25
UNION ALL SELECT 'category_cap', operation_category || ': ' || count(*) FROM t GROUP BY operation_category HAVING count(*) > 500""")
def dataset_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constraints of the reference's own sets, on a set that breaks them."""
    rows = transfer_records(spark, sf_dir).withColumn("id_example", F.when(F.col("seq") % 50 == 7, "EX0000008").otherwise(F.col("id_example")))
    return D.dataset_errors(rows, 5000, {"GENERATION": 2000, "COMPLETION": 1500, "NORMALIZATION": 1500}, 1000, 1000, digits=7)


@query(f"""WITH {RECORDS} SELECT 'activity' AS part, activity_type AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS most, CAST(NULL AS DOUBLE) AS mean FROM rec GROUP BY 2
UNION ALL SELECT 'currency', currency, count(*), NULL, NULL, NULL FROM rec GROUP BY 2 UNION ALL SELECT 'category', operation_category, count(*), NULL, NULL, NULL FROM rec GROUP BY 2
UNION ALL SELECT 'beneficiary', beneficiary, count(*), NULL, NULL, NULL FROM rec GROUP BY 2 UNION ALL SELECT 'calendar', CAST(has_calendar AS VARCHAR), count(*), NULL, NULL, NULL FROM rec WHERE activity_type = 'GENERATION' GROUP BY 2
UNION ALL SELECT 'amount', NULL, count(*), min(amount), max(amount), round(avg(amount), 4) FROM rec WHERE amount > 0""")
def record_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report on the records says, from one scan of them."""
    keys = {"activity": F.col("activity_type"), "currency": F.col("currency"), "category": F.col("operation_category"), "beneficiary": F.col("beneficiary"), "calendar": F.col("calendar_context").isNotNull()}
    found = tallies(transfer_records(spark, sf_dir), keys, {"amount": F.col("amount")}, only={"calendar": F.col("activity_type") == "GENERATION", "amount": F.col("amount") > 0})
    return found.select("part", "key", "n", "least", "most", F.round(F.col("total") / F.col("n"), 4).alias("mean"))


@query(f"""WITH {RECORDS} SELECT id_example, 'lost' AS problem FROM rec WHERE seq % 53 = 0 UNION ALL SELECT 'ZZ' || id_example, 'stray' FROM rec WHERE seq % 59 = 1 UNION ALL SELECT id_example, 'shared' FROM rec WHERE seq % 61 = 2 AND seq % 53 <> 0
UNION ALL SELECT id_example, 'label' FROM rec WHERE (seq % 67 = 3 OR seq % 61 = 2) AND seq % 53 <> 0""")
def split_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a split of which some rows were lost, renamed, put into two parts, or labelled wrongly."""
    whole = materialise(stratified_split(spark, sf_dir).join(transfer_records(spark, sf_dir).select("id_example", "seq"), "id_example").select("id_example", "seq", "split"), "split")
    kept = whole.where(F.col("seq") % 53 != 0)
    label = F.when(F.col("seq") % 67 == 3, "none").otherwise(F.col("split"))
    parts = {}
    names = ["train", "validation", "test"]
    for k, name in enumerate(names):
        own = kept.where(F.col("split") == name).select("id_example", label.alias("split"))
        stray = whole.where((F.col("split") == name) & (F.col("seq") % 59 == 1)).select(F.concat(F.lit("ZZ"), "id_example").alias("id_example"), "split")
        twice = kept.where((F.col("split") == names[k - 1]) & (F.col("seq") % 61 == 2)).select("id_example", "split")
        parts[name] = own.unionByName(stray).unionByName(twice)
    return D.split_cover(whole, parts, "id_example")


def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with their rendered rows: some completions lack a reference, some prompts are blank or end with a line break."""
    raw, v = transfer_records(spark, sf_dir), F.col("seq") % 7
    one = F.get("expected_output", 0)
    done = F.when(v == 1, F.concat(F.lit("1. "), one)).when(v == 2, F.substring(one, 1, 9)).otherwise(R.completion())
    prompt = F.when(v == 3, " \t").when(v == 4, F.concat("beneficiary", F.lit("\n"))).otherwise(F.col("beneficiary"))
    return D.aligned(raw.select("id_example", "expected_output"), raw.select("id_example", prompt.alias("prompt"), done.alias("completion")), "id_example")


_PAIRS = f"""{RECORDS}, pairs AS (SELECT id_example, out1, out2, CASE seq % 7 WHEN 3 THEN ' ' || chr(9) WHEN 4 THEN beneficiary || chr(10) ELSE beneficiary END AS prompt,
  CASE seq % 7 WHEN 1 THEN '1. ' || out1 WHEN 2 THEN substr(out1, 1, 9) ELSE '1. ' || out1 || chr(10) || '2. ' || out2 END AS completion FROM rec),
n AS (SELECT *, {_norm("out1")} AS a, {_norm("out2")} AS b, {_norm("completion")} AS c FROM pairs)"""


@query(f"WITH {_PAIRS} SELECT id_example, contains(c, a) AND contains(c, b) AS all_references, (contains(c, a) OR contains(a, c)) AND (contains(c, b) OR contains(b, c)) AS either_way, trim(prompt, ' ' || chr(9) || chr(10)) = '' AS bad_prompt, completion = '' AS bad_completion FROM n")
def raw_sft_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.alignment_report(aligned_pairs(spark, sf_dir), "id_example")


@query(f"WITH {_PAIRS} SELECT count(*) AS records, count_if(ends_with(prompt, chr(10))) AS prompts_with_trailing_newline, CAST(max(length(prompt)) AS INTEGER) AS max_prompt_characters FROM pairs")
def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.alignment_stats(aligned_pairs(spark, sf_dir))


_COPIES = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang, source) AS f FROM documents"


@query(f"WITH {RECORDS} SELECT count(*) AS errors, (SELECT count(*) FROM rec WHERE seq % 40 IN (25, 26)) AS unreadable, (SELECT count(*) FROM ({_COPIES}) WHERE f < doc_id) AS copies, false AS passed FROM (SELECT 1 FROM rec WHERE seq % 40 = 23)")
def validation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of which the errors of one rule and one kind of record count. Lines are made and parsed once, and all rules are looked at for all of them."""
    lines = W.checked(raw_lines(spark, sf_dir, keep=["seq"]), keep=["seq"])
    counted = (F.col("seq") % 40 == 23) & F.col("id_example").isNotNull()
    errors = F.when(counted, F.size(F.filter("broken", lambda x: x["rule"] == "language_en"))).otherwise(0)
    copies = R.exact_copies(table(spark, sf_dir, "documents"), "doc_id", ["text", "lang", "source"], "doc_id")
    return D.lines_passed(lines.select(F.col("broken").isNotNull().alias("readable"), errors.alias("errors")), copies)


@query("SELECT doc_id, regexp_matches(text, '\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b') OR regexp_matches(text, '(?:^|[^0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?:[^0-9]|$)') AS pii FROM documents")
def pii_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", D.pii_like(F.col("text")).alias("pii"))


@query(f"WITH {RECORDS} SELECT count(*) AS events, count(DISTINCT seq % 37) AS titles, count(DISTINCT CASE WHEN seq % 9 > 0 THEN activity_type || seq % 5 END) AS categories, min(event_date) AS first_date, max(event_date) AS last_date FROM rec WHERE has_calendar")
def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("seq"), lambda x: F.col(f"calendar_context.{x}")
    category = F.when(k % 9 > 0, F.concat("activity_type", (k % 5).cast("string")))
    context = F.struct(F.concat(c("event_title"), (k % 37).cast("string")).alias("event_title"), c("event_date").alias("event_date"), category.alias("event_category"))
    return D.event_stats(transfer_records(spark, sf_dir).withColumn("calendar_context", F.when(F.col("calendar_context").isNotNull(), context)))


@query(f"WITH {RECORDS} SELECT id_example, year(CAST(event_date AS DATE)) = 1995 + seq % 4 AND (seq % 3 = 0 OR month(CAST(event_date AS DATE)) = 1 + seq % 12) AS coherent FROM rec WHERE has_calendar")
def calendar_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("seq"), F.lit(None).cast("int")
    rows = transfer_records(spark, sf_dir).where("calendar_context is not null")
    return rows.select("id_example", D.calendar_coherent(F.col("calendar_context.event_date"), (F.lit(1995) + k % 4).cast("int"), F.when(k % 3 != 0, (F.lit(1) + k % 12).cast("int")), none).alias("coherent"))


# -- summaries


def scored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("seq")
    flags = {"two_distinct_alternatives": k % 3 != 0, "structured_consistent": k % 5 != 0, "currency_consistent": k % 7 != 0, "amount_consistent": k % 11 != 0, "temporal_consistent": k % 13 != 0, "beneficiary_mentioned": k % 17 != 0}
    rows = transfer_records(spark, sf_dir)
    return rows.select(
        "id_example", "seq", "activity_type", F.concat(F.lit("m"), (k % 2).cast("string")).alias("model"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("test_set"), ((k % 100) / 100).alias("rouge1_f1"), ((k % 50) / 100).alias("rouge2_f1"),
        F.when(k % 4 > 0, (k % 10) / 10).alias("bertscore_f1"), (k % 2).cast("double").alias("normalized_exact_match"), *(c.alias(name) for name, c in flags.items()), F.when(F.col("calendar_context").isNotNull(), k % 8 == 0).alias("calendar_reflected"),
    )


_SCORED = f"""{RECORDS}, scored AS (SELECT id_example, seq, activity_type, 'm' || (seq % 2) AS model, 't' || (seq % 3) AS test_set, (seq % 100) / 100.0 AS rouge1_f1, (seq % 50) / 100.0 AS rouge2_f1, CASE WHEN seq % 4 > 0 THEN (seq % 10) / 10.0 END AS bertscore_f1,
  CAST(seq % 2 AS DOUBLE) AS normalized_exact_match, seq % 3 <> 0 AS two_distinct_alternatives, seq % 5 <> 0 AS structured_consistent, seq % 7 <> 0 AS currency_consistent, seq % 11 <> 0 AS amount_consistent, seq % 13 <> 0 AS temporal_consistent,
  seq % 17 <> 0 AS beneficiary_mentioned, CASE WHEN has_calendar THEN seq % 8 = 0 END AS calendar_reflected FROM rec)"""
_MEANS = ", ".join(f"round(avg(CAST({c} AS DOUBLE)), 6) AS {name}" for c, name in [*((x, x) for x in S.SCORES), *S.FLAGS.items()])


@query(f"WITH {_SCORED} SELECT model, test_set, CASE WHEN grouping(activity_type) = 1 THEN 'ALL' ELSE activity_type END AS activity_type, count(*) AS records, {_MEANS} FROM scored GROUP BY GROUPING SETS ((model, test_set), (model, test_set, activity_type))")
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evaluation_metrics(scored_records(spark, sf_dir), [["model", "test_set"], ["model", "test_set", "activity_type"]], ["model", "test_set", "activity_type"])


@query(f"WITH {_SCORED} SELECT id_example, CAST(10 * CAST(NOT structured_consistent AS INTEGER) + 5 * CAST(NOT two_distinct_alternatives AS INTEGER) AS INTEGER) AS priority, CAST(coalesce(bertscore_f1, rouge1_f1) AS DOUBLE) AS score FROM scored ORDER BY priority DESC, score, model, test_set, seq LIMIT 60")
def qualitative_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.review_first(scored_records(spark, sf_dir), "structured_consistent", "two_distinct_alternatives", ["bertscore_f1", "rouge1_f1"], ["model", "test_set", "seq"]).select("id_example", "priority", "score")


@query(f"WITH {_SCORED} SELECT model, count(*) AS records, round(avg(rouge1_f1), 6) AS avg_rouge1_f1, count_if(currency_consistent) AS currency_consistent, coalesce(count_if(calendar_reflected), 0) AS calendar_reflected, round(100.0 * count_if(currency_consistent) / count(*), 6) AS currency_consistent_pct, round(100.0 * coalesce(count_if(calendar_reflected), 0) / count(*), 6) AS calendar_reflected_pct FROM scored GROUP BY model")
def variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.variant_summary(scored_records(spark, sf_dir), "model", ["rouge1_f1"], ["currency_consistent", "calendar_reflected"])


@query(f"""WITH {RECORDS}, r AS (SELECT activity_type, CASE seq % 5 WHEN 0 THEN '' ELSE out1 END AS a, CASE seq % 7 WHEN 0 THEN NULL WHEN 1 THEN out2 ELSE out1 END AS b, seq FROM rec)
SELECT activity_type, count(*) AS n, count_if(a IS NOT DISTINCT FROM b) AS equal, round(count_if(a IS NOT DISTINCT FROM b) / count(*), 6) AS equal_rate, count_if(a = '') AS empty_a, count_if(coalesce(b, '') = '') AS empty_b, count_if(seq % 2 = 0) AS two_distinct_a,
  count_if(seq % 3 = 0) AS two_distinct_b, count_if(seq % 10 = 0) AS hit_max_a, count_if(seq % 20 = 0) AS hit_max_b FROM r GROUP BY activity_type""")
def audit_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same records, joined by id."""
    rows, k = transfer_records(spark, sf_dir), F.col("seq")
    one, two = F.get("expected_output", 0), F.get("expected_output", 1)
    run = lambda text, a, b: rows.select("id_example", "activity_type", text.alias("raw"), (k % a == 0).alias("distinct"), (k % b == 0).alias("hit"))
    pairs = O.run_pairs(run(F.when(k % 5 == 0, "").otherwise(one), 2, 10), run(F.when(k % 7 == 1, two).when(k % 7 > 1, one), 3, 20), ["id_example", "activity_type"], ["raw", "distinct", "hit"])
    return O.audit_summary(pairs, ["activity_type"], "raw", "distinct", "hit")


@query(f"WITH {RECORDS} SELECT id_example, CASE WHEN seq % 2 = 0 THEN out1 END AS base, out2 AS full FROM rec")
def outputs_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transfer_records(spark, sf_dir)
    long = rows.where(F.col("seq") % 2 == 0).select("id_example", F.lit("base").alias("variant"), F.get("expected_output", 0).alias("t")).unionByName(rows.select("id_example", F.lit("full").alias("variant"), F.get("expected_output", 1).alias("t")))
    return O.side_by_side(long, "id_example", "variant", "t", ["base", "full"])


@query("SELECT min(CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END) AS min, max(CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END) AS max, round(avg(CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END), 2) AS avg FROM orders")
def amount_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("amount"))
    return S.amount_stats(rows, "amount")


@query(f"WITH {RUNS} SELECT place, arg_min(event_type, run) AS event_type, count(*) AS runs, round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median, round(quantile_cont(value, 0.95), 6) AS value_p95, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, round(coalesce(stddev_samp(value), 0), 6) AS value_std_dev FROM runs GROUP BY place")
def describe_by_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.describe_by_prompt(runs(spark, sf_dir), "place", "run", "event_type", ["value"])


@query(f"WITH {RUNS}, r AS (SELECT place, value, row_number() OVER (PARTITION BY place ORDER BY run) AS u, row_number() OVER (PARTITION BY place ORDER BY run DESC) AS d FROM runs), m AS (SELECT place, median(value) FILTER (u <= 3) AS f, median(value) FILTER (d <= 3) AS l FROM r GROUP BY place) SELECT place, round(f, 6) AS value_first_median, round(l, 6) AS value_last_median, round((l - f) / nullif(f, 0) * 100, 6) AS value_median_change_pct FROM m")
def first_last_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_last_medians(runs(spark, sf_dir), "run", ["value"], 3, ["place"])


@query("SELECT event_id, round((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6, 3) AS elapsed_s FROM events")
def sample_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.elapsed(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").select("event_id", "elapsed_s")


@query(f"""WITH {RUNS}, t AS (SELECT run, CASE WHEN run % 3 > 0 THEN value END AS temp, CASE WHEN run % 4 > 0 THEN 100 - run % 50 END AS bat, CAST(run % 5 AS INTEGER) AS st FROM runs)
SELECT count(*) AS samples, max(run) * 5.0 AS duration_s, arg_min(temp, run) FILTER (temp IS NOT NULL) AS first_temperature, arg_max(temp, run) FILTER (temp IS NOT NULL) AS last_temperature, min(temp) AS min_temperature, max(temp) AS max_temperature,
  arg_min(bat, run) FILTER (bat IS NOT NULL) AS first_battery, arg_max(bat, run) FILTER (bat IS NOT NULL) AS last_battery, max(st) AS max_status, string_agg(DISTINCT st, ',' ORDER BY st) AS states FROM t""")
def thermal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.col("run")
    rows = runs(spark, sf_dir).select("run", (run * F.lit(5.0)).alias("at"), F.when(run % 3 > 0, F.col("value")).alias("temp"), F.when(run % 4 > 0, 100 - run % 50).alias("bat"), (run % 5).cast("int").alias("st"))
    return S.thermal_summary(rows, "run", "at", "temp", "bat", "st")


@query("SELECT max(value) FILTER (event_id = 0) AS cold, round(avg(value) FILTER (event_id > 0), 6) AS warm_mean, round(median(value) FILTER (event_id > 0), 6) AS warm_median, min(value) FILTER (event_id > 0) AS warm_min, max(value) FILTER (event_id > 0) AS warm_max, round(100 * (max(value) FILTER (event_id = 0) - avg(value) FILTER (event_id > 0)) / max(value) FILTER (event_id = 0), 6) AS saving_pct FROM events")
def load_cold_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.cold_warm(table(spark, sf_dir, "events").withColumn("condition", F.when(F.col("event_id") == 0, "cold").otherwise("warm")), "condition", "value")
    return found.withColumns({c: F.round(c, 6) for c in ("warm_mean", "warm_median", "saving_pct")})


@query("SELECT arg_min(event_id, value) AS step, min(value) AS eval_loss FROM events WHERE event_id % 10 = 0")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.when(F.col("event_id") % 10 == 0, F.col("value")).alias("eval_loss"))
    return S.best_checkpoint(log)


@query("SELECT p_brand AS variant, round(p_size / 1048576.0, 3) AS mib, round(p_size / 1073741824.0, 6) AS gib, round(100 * (1 - p_size / (SELECT sum(p_size * 1000000) FROM part WHERE p_brand = 'Brand#1')), 6) AS saving_pct FROM (SELECT p_brand, sum(p_size * 1000000) AS p_size FROM part GROUP BY 1)")
def size_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("variant")).agg(F.sum(F.col("p_size").cast("long") * 1000000).alias("bytes"))
    return O.size_reduction(sizes, "variant", "bytes", "Brand#1")


# -- joins


@query("SELECT o_orderkey, o_custkey, coalesce(c_name, '') AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) c ON o_custkey = c_custkey")
def calendar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 > 0).select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return D.with_names(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey", "name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return D.looked_up(table(spark, sf_dir, "orders"), known, "o_custkey").select("o_orderkey")


@query("SELECT m.n_name AS model, t.r_name AS test_set FROM nation m, region t")
def model_x_testset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.combinations(table(spark, sf_dir, "nation").select(F.col("n_name").alias("model")), table(spark, sf_dir, "region").select(F.col("r_name").alias("test_set")))


@query(f"WITH {RECORDS} SELECT id_example FROM rec WHERE seq >= (SELECT max(seq) / 2 FROM rec)")
def resume_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.writers import resumed

    work = transfer_records(spark, sf_dir).select("seq", "id_example")
    done = work.join(F.broadcast(work.agg((F.max("seq") / 2).alias("half")))).where("seq < half").drop("half")
    return resumed(work, done, "seq", "id_example").select("id_example")


@query(f"WITH {RECORDS} SELECT id_example, 'test,train' AS splits FROM rec WHERE seq % 61 = 2")
def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transfer_records(spark, sf_dir)
    both = rows.select("id_example", F.lit("train").alias("split")).unionByName(rows.where(F.col("seq") % 61 == 2).select("id_example", F.lit("test").alias("split")))
    return O.split_overlaps(both, "id_example")


@query(f"""WITH {RECORDS}, s AS (SELECT seq, regexp_replace(regexp_replace(lower(concat_ws(' ', input_text, beneficiary, period, out1, out2)), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g') AS t FROM (SELECT *, reference_period AS period FROM rec))
SELECT count(DISTINCT regexp_replace(regexp_replace(t, '\\b\\d+\\b', '<num>', 'g'), '\\b(january|february|march|april|may|june|july|august|september|october|november|december)\\b', '<month>', 'g')) AS signatures, count(*) AS records FROM s""")
def record_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = T.signature(F.col("input_text"), F.col("beneficiary"), F.col("reference_period"), F.array_join("expected_output", " "))
    return transfer_records(spark, sf_dir).select(own.alias("s")).agg(F.count_distinct("s").alias("signatures"), F.count("*").alias("records"))


# -- logs and streams


@query("SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS value FROM events GROUP BY user_id")
def log_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("event_type") == "click", "MODEL ").otherwise("other "), F.lit("load_ms="), F.col("value").cast("string"))
    lines = table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("value"))
    return I.last_value(lines, "MODEL", r"load_ms=([\d.]+)", "event_id", ["user_id"])


@query("SELECT user_id, CAST(arg_min(event_id % 100, event_id) FILTER (event_type = 'click') AS INTEGER) AS level, CAST(round(arg_min(event_id % 500, event_id) FILTER (event_type = 'view') / 10.0, 1) AS DOUBLE) AS temperature_c, CAST(arg_min(event_id % 7, event_id) FILTER (event_type = 'error') AS VARCHAR) AS status FROM events GROUP BY user_id")
def battery_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    named = lambda name, n: F.concat(F.lit(f"  {name}: "), (k % n).cast("string"))
    line = F.when(F.col("event_type") == "click", named("level", 100)).when(F.col("event_type") == "view", named("temperature", 500)).when(F.col("event_type") == "error", named("status", 7)).otherwise("noise: 1")
    return I.battery_state(table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("value")), "event_id", ["user_id"])


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(event_id % 9 AS VARCHAR) END AS state FROM events")
def thermal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("event_id"), (F.col("event_id") % 9).cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("status=8\nthermal status: "), n)).when(k % 4 == 1, F.concat(F.lit("status=8\nmStatus = "), n)).when(k % 4 == 2, F.concat(F.lit("Status:"), n)).otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", I.cascade(text, I.THERMAL).alias("state"))


@query("SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream of the same rows gives in the end; every log line comes twice, as a poll repeats it."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    found = windowed(distinct_runs(rows.unionByName(rows), "ts", ["event_id"]), "ts", "event_type", "value", "1 day")
    return found.withColumn("total", F.round("total", 4))


@query("""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS run, ts AS time, CASE WHEN event_id % 97 = 5 THEN 'DEPLOYMENT_BENCHMARK_COMPLETE' WHEN event_id % 89 = 7 THEN 'DEPLOYMENT_BENCHMARK_ERROR' WHEN event_type = 'click' THEN 'METRICS k=' || event_id ELSE event_type END AS value FROM events),
r AS (SELECT run, min(time) AS started, min(time) FILTER (value LIKE 'DEPLOYMENT%') AS marked, arg_min(value, time) FILTER (value LIKE 'DEPLOYMENT%') AS marker FROM l GROUP BY run),
e AS (SELECT run, CASE WHEN marked <= started + INTERVAL '1 day' THEN CASE WHEN marker LIKE '%ERROR' THEN 'failed' ELSE 'done' END ELSE 'timeout' END AS kind, CASE WHEN marked <= started + INTERVAL '1 day' THEN marked ELSE started + INTERVAL '1 day' END AS time FROM r)
SELECT run, 'metrics' AS kind, time, value, CAST(NULL AS BIGINT) AS metrics FROM l WHERE value LIKE 'METRICS %'
UNION ALL SELECT run, kind, time, NULL, (SELECT count(*) FROM l WHERE l.run = e.run AND l.value LIKE 'METRICS %' AND l.time <= e.time) FROM e WHERE time <= (SELECT max(time) - INTERVAL '1 minute' FROM l)""")
def monitor_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs and their events as lines of a log, each line twice, as a poll repeats it. What the stream of the lines tells in the end."""
    k = F.col("event_id")
    line = F.when(k % 97 == 5, DONE).when(k % 89 == 7, FAILED).when(F.col("event_type") == "click", F.concat(F.lit("METRICS k="), k.cast("string"))).otherwise(F.col("event_type"))
    lines = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), F.col("ts").alias("time"), line.alias("value"))
    return monitored(lines.unionByName(lines), timeout="1 day").withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("SELECT event_id AS id, 'c' || user_id AS \"calendarName\", event_type AS title, event_id * 3600000 AS \"startMillis\", event_id * 3600000 + 1 AS \"endMillis\", event_id % 2 = 0 AS \"allDay\" FROM events WHERE event_id * 3600000 BETWEEN 86400000 AND 86400000 + 7776000000")
def calendar_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    events = table(spark, sf_dir, "events").select(k.alias("id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("calendarName"), F.col("event_type").alias("title"), (k * 3600000).alias("startMillis"), (k * 3600000 + 1).alias("endMillis"), (k % 2 == 0).alias("allDay"))
    return I.calendar_range(events, F.lit(86400000))
