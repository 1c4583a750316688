"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.operators import records as R
from tessera.operators import similar as M
from tessera.operators import stats as S
from tessera.sources.readers import metric_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- adapters: tables as the engine's entities


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_ordinals(table(spark, sf_dir, "events").select("ts", "event_id", "event_type", "value"), ["ts", "event_id"])


RUNS = "runs AS (SELECT *, CAST(ceil(run / 6.0) AS INTEGER) AS cycle, CAST((run - 1) % 6 AS INTEGER) AS place FROM (SELECT ts, event_id, event_type, value, row_number() OVER (ORDER BY ts, event_id) AS run FROM events))"


def transfer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transfer records, with a few that break rules."""
    orders, customer, nation = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    activity = F.when(k % 10 < 4, "GENERATION").when(k % 10 < 7, "COMPLETION").otherwise("NORMALIZATION")
    category = F.upper(F.replace("o_orderpriority", F.lit(" "), F.lit("_")))
    period = F.date_format("o_orderdate", "MMMM yyyy")
    context = F.when((activity == "GENERATION") & (k % 2 == 0), F.struct(F.lit("Payment due").alias("event_title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"), F.lit("Finance").alias("event_category")))
    return rows.select(
        F.concat(F.lit("EX"), F.lpad(k.cast("string"), 7, "0")).alias("id_example"), k.alias("seq"), activity.alias("activity_type"), category.alias("operation_category"), F.col("c_name").alias("beneficiary"),
        F.when(k % 97 == 0, F.lit(0.0)).otherwise(F.round("o_totalprice", 2)).alias("amount"),
        F.when(F.col("n_regionkey") == 0, "GBP").when(F.col("n_regionkey") == 1, "USD").when(F.col("n_regionkey") == 4, "CHF").otherwise("EUR").alias("currency"),
        period.alias("reference_period"), F.when(activity != "GENERATION", F.concat(F.lit("transfer "), category)).when(k % 89 == 0, "stray").alias("input_text"), context.alias("calendar_context"),
        F.array(F.concat(category, F.lit(" payment for "), period), F.concat(F.lit("Payment of "), category)).alias("expected_output"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("split"),
    )


RECORDS = """rec AS (
  SELECT 'EX' || lpad(CAST(k AS VARCHAR), 7, '0') AS id_example, k AS seq, activity_type, cat AS operation_category, c_name AS beneficiary,
         CASE WHEN k % 97 = 0 THEN 0.0 ELSE round(o_totalprice, 2) END AS amount,
         CASE n_regionkey WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' WHEN 4 THEN 'CHF' ELSE 'EUR' END AS currency, period AS reference_period,
         CASE WHEN activity_type <> 'GENERATION' THEN 'transfer ' || cat WHEN k % 89 = 0 THEN 'stray' END AS input_text,
         activity_type = 'GENERATION' AND k % 2 = 0 AS has_calendar, strftime(o_orderdate, '%Y-%m-%d') AS event_date,
         cat || ' payment for ' || period AS out1, 'Payment of ' || cat AS out2
  FROM (SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 10 < 4 THEN 'GENERATION' WHEN o_orderkey % 10 < 7 THEN 'COMPLETION' ELSE 'NORMALIZATION' END AS activity_type,
               upper(replace(o_orderpriority, ' ', '_')) AS cat, strftime(o_orderdate, '%B %Y') AS period
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, reference, prediction): a user's turn and the assistant's next one."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return asked.join(said, ["conv_id", "turn"])


REPLIES = """c AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations WHERE role <> 'system' GROUP BY conv_id, turn),
replies AS (SELECT a.conv_id, a.turn, a.text AS reference, b.text AS prediction FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


def _describe_sql(c: str) -> str:
    return f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median, round(quantile_cont({c}, 0.95), 6) AS {c}_p95, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max, round(coalesce(stddev_samp({c}), 0), 6) AS {c}_std_dev"


# -- statistics of runs


@query(f"SELECT event_type, count(*) AS runs, {_describe_sql('value')} FROM events GROUP BY event_type")
def describe_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.describe_by(table(spark, sf_dir, "events"), "event_type", ["value"])


@query(f"WITH {RUNS} SELECT round(f, 6) AS value_first, round(l, 6) AS value_last, round((l - f) / nullif(f, 0) * 100, 6) AS value_change_pct FROM (SELECT avg(CASE WHEN run <= 18 THEN value END) AS f, avg(CASE WHEN run > n - 18 THEN value END) AS l FROM (SELECT *, count(*) OVER () AS n FROM runs))")
def sustained_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_last(runs(spark, sf_dir), "run", ["value"], 18)


@query(f"WITH {RUNS}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY run) AS u, row_number() OVER (PARTITION BY event_type ORDER BY run DESC) AS d FROM runs) SELECT event_type, round(f, 6) AS value_first, round(l, 6) AS value_last, round((l - f) / nullif(f, 0) * 100, 6) AS value_change_pct FROM (SELECT event_type, avg(CASE WHEN u <= 3 THEN value END) AS f, avg(CASE WHEN d <= 3 THEN value END) AS l FROM r GROUP BY event_type)")
def first_last_by_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_last(runs(spark, sf_dir), "run", ["value"], 3, ["event_type"])


@query(f"WITH {RUNS} SELECT event_type, round(coalesce(regr_slope(value, run), 0), 6) AS value_slope FROM runs GROUP BY event_type")
def slope_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.slopes(runs(spark, sf_dir), "run", ["value"], ["event_type"])


@query(f"WITH {RUNS} SELECT cycle, round(avg(value), 6) AS value_mean FROM runs GROUP BY cycle")
def cycle_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.means_by(runs(spark, sf_dir), "cycle", ["value"])


@query(f"WITH {RUNS} SELECT event_type, count(*) AS samples, arg_min(value, run) AS first_value, arg_max(value, run) AS last_value, min(value) AS min_value, max(value) AS max_value, string_agg(DISTINCT CAST(place AS VARCHAR), ',' ORDER BY CAST(place AS VARCHAR)) AS states FROM runs GROUP BY event_type")
def series_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.series_summary(runs(spark, sf_dir), "run", "value", "place", "event_type")


@query("SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1")
def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS category, count(*) AS n, count(*) > 0.1 * 5000 AS exceeds FROM orders GROUP BY 1")
def category_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.category_caps(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category")), "category", 5000)


@query("SELECT o_orderpriority, count(o_totalprice) AS n, round(min(o_totalprice), 2) AS min_amount, round(max(o_totalprice), 2) AS max_amount, round(avg(o_totalprice), 4) AS avg_amount, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS median_amount, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def amount_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.amount_profile(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")


# -- records


@query(f"""WITH {RECORDS}
SELECT id_example, 'amount_positive' AS rule FROM rec WHERE amount IS NULL OR amount <= 0
UNION ALL SELECT id_example, 'currency_enum' FROM rec WHERE currency NOT IN ('EUR', 'USD', 'GBP')
UNION ALL SELECT id_example, 'gen_input_null' FROM rec WHERE activity_type = 'GENERATION' AND input_text IS NOT NULL""")
def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.violations(R.cleaned(transfer_records(spark, sf_dir)))


@query("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_seq FROM orders GROUP BY o_custkey HAVING count(*) > 1 ORDER BY first_seq LIMIT 20")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicate_ids(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("SELECT i AS c_custkey FROM generate_series(1, (SELECT max(o_custkey) FROM orders)) t(i) WHERE i NOT IN (SELECT o_custkey FROM orders)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to the last id that an order has."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.missing_ids(orders, "c_custkey", orders.agg(F.max("c_custkey")).first()[0] or 0)


@query("SELECT i AS c_custkey FROM generate_series(1, (SELECT max(c_custkey) FROM customer)) t(i) WHERE i NOT IN (SELECT o_custkey FROM orders)")
def missing_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``missing_ids``, up to the last id that there is."""
    last = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 0
    return R.missing_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", last)


@query("SELECT doc_id, first_id FROM (SELECT doc_id, first_value(doc_id) OVER w AS first_id, row_number() OVER w AS k FROM documents WINDOW w AS (PARTITION BY text, lang, source ORDER BY doc_id)) WHERE k > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exact_copies(table(spark, sf_dir, "documents"), "doc_id", ["text", "lang", "source"], "doc_id")


@query(f"WITH {RECORDS} SELECT activity_type, operation_category, out1 || '|' || out2 AS outputs, count(*) AS n FROM rec GROUP BY ALL HAVING count(*) > 1")
def identical_pairs_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer_records(spark, sf_dir).groupBy("activity_type", "operation_category", F.array_join("expected_output", "|").alias("outputs")).agg(F.count("*").alias("n")).where("n > 1")


_SPLIT = f"""WITH {RECORDS}, o AS (SELECT id_example, activity_type, row_number() OVER (PARTITION BY activity_type, operation_category ORDER BY md5('42:' || id_example)) AS place, count(*) OVER (PARTITION BY activity_type, operation_category) AS n FROM rec),
s AS (SELECT id_example, activity_type, CASE WHEN place <= round_even(n * 0.8, 0) THEN 'train' WHEN place <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'validation' ELSE 'test' END AS split FROM o)"""


@query(_SPLIT + " SELECT id_example, split FROM s")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stratified_split(transfer_records(spark, sf_dir).drop("split"), "id_example", ["activity_type", "operation_category"]).select("id_example", "split")


@query(_SPLIT + " SELECT split, count(*) AS n, count(DISTINCT id_example) AS ids FROM s GROUP BY split")
def split_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("id_example").alias("ids"))


_HEADS = " ".join(f"WHEN '{k}' THEN '{v[0]}' || chr(10) || '{v[1]}'" for k, v in R.PROMPTS.items())


@query(f"""WITH {RECORDS}
SELECT id_example, concat_ws(chr(10), CASE activity_type {_HEADS} END, 'Category: ' || operation_category, 'Beneficiary: ' || beneficiary,
  'Amount: ' || regexp_replace(regexp_replace(format('{{:.2f}}', amount), '0+$', ''), '\\.$', '') || ' ' || currency, 'Reference period: ' || reference_period,
  CASE WHEN has_calendar THEN 'Calendar context:' || chr(10) || '- Event: Payment due' || chr(10) || '- Date: ' || event_date || chr(10) || '- Event category: Finance' END,
  CASE activity_type WHEN 'COMPLETION' THEN 'Partial description: ' || input_text WHEN 'NORMALIZATION' THEN 'Original description: ' || input_text END) AS prompt,
  '1. ' || out1 || chr(10) || '2. ' || out2 AS completion FROM rec""")
def render_prompt_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer_records(spark, sf_dir).select("id_example", R.prompt().alias("prompt"), R.completion().alias("completion"))


# -- means and reviews


@query("SELECT coalesce(lang, 'ALL') AS lang, count(*) AS records, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang))")
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grouped_means(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), ["quality", "toxic"], "lang")


@query("SELECT doc_id, 10 * toxic + 5 * (1 - quality) AS priority, n_chars FROM documents JOIN labels USING (doc_id) ORDER BY priority DESC, n_chars, doc_id LIMIT 60")
def review_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", (10 * F.col("toxic") + 5 * (1 - F.col("quality"))).alias("priority"), "n_chars").orderBy(F.desc("priority"), "n_chars", "doc_id").limit(60)


_LINES = "list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query(f"WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents) SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines, len(l) >= 4 AND list_max(list_transform(list_distinct(l), lambda x: len(list_filter(l, lambda y: y = x)))) / len(l) >= 0.6 AS repeats FROM l")
def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("own"))
    return rows.select("doc_id", F.size("own").alias("n_lines"), T.repeats(F.col("own")).alias("repeats"))


@query(f"WITH {RECORDS} SELECT id_example, seq % 5 IN (0, 3, 4) AS valid, seq % 5 IN (0, 4) AS exactly_two, seq % 5 IN (0, 1, 3) AND lower(out1) <> lower(out2) AS two_differ FROM rec")
def format_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions as they should be, in the wrong order, without numbers, with a third one, and with the same one twice."""
    a, b, k = F.get("expected_output", 0), F.get("expected_output", 1), F.col("seq") % 5
    done = F.when(k == 1, F.concat(F.lit("2. "), b, F.lit("\n1. "), a)).when(k == 2, F.concat(a, F.lit("\n"), b)).when(k == 3, F.concat(R.completion(), F.lit("\n3. x"))).when(k == 4, F.concat(F.lit("1. "), a, F.lit("\n2. "), F.lower(a))).otherwise(R.completion())
    return transfer_records(spark, sf_dir).select("id_example", T.valid_format(done).alias("valid"), T.exactly_two(done).alias("exactly_two"), T.distinct_alternatives(done).alias("two_differ"))


@query("SELECT array_to_string(list_slice(w, 1, 2), ' ') AS lead_in, count(*) AS n FROM (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM conversations) WHERE len(w) > 0 GROUP BY 1 ORDER BY n DESC, lead_in LIMIT 20")
def lead_in_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select(T.tokens(F.col("text")).alias("w")).where("size(w) > 0")
    return words.groupBy(F.array_join(F.slice("w", 1, 2), " ").alias("lead_in")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lead_in").limit(20)


@query("SELECT role, count(*) AS n, CAST(min(k) AS INTEGER) AS min_words, CAST(max(k) AS INTEGER) AS max_words, round(avg(k), 6) AS mean_words, round(median(k), 6) AS median_words FROM (SELECT role, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS k FROM conversations) GROUP BY role")
def length_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.word_lengths(table(spark, sf_dir, "conversations"), "text", "role")


_WORDS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
_ROUGE = f"""WITH {REPLIES}, w AS (SELECT conv_id, turn, {_WORDS.format('prediction')} AS p, {_WORDS.format('reference')} AS r FROM replies),
o AS (SELECT conv_id, turn, len(p) AS np, len(r) AS nr, coalesce(list_sum(list_transform(list_distinct(p), lambda g: least(len(list_filter(p, lambda x: x = g)), len(list_filter(r, lambda x: x = g))))), 0) AS k FROM w)"""


@query(_ROUGE + " SELECT conv_id, turn, round(CASE WHEN np > 0 AND nr > 0 THEN 2.0 * k / (np + nr) ELSE 0 END, 6) AS rouge1 FROM o")
def rouge_plain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rouge_rows(replies(spark, sf_dir), ["conv_id", "turn"], "prediction", "reference", 1, "rouge1")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def alignment_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contained_items(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


@query(f"WITH {REPLIES} SELECT conv_id, turn, lower(trim(reference)) = lower(trim(prediction)) AS same FROM replies")
def turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("conv_id", "turn", T.exact_ci(F.col("reference"), F.col("prediction")).alias("same"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1998-06-15' AS days FROM orders WHERE abs(CAST(o_orderdate AS DATE) - DATE '1998-06-15') <= 7")
def reference_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    today, day = F.to_date(F.lit("1998-06-15")), F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").where(N.near_event(day, None, None, today)).select("o_orderkey", F.datediff(day, today).cast("long").alias("days"))


@query("SELECT event_id AS prompt_tokens, CAST(event_id % 7 AS INTEGER) AS generated_tokens, round(value, 3) AS total_ms, 'yes' AS eog FROM events WHERE event_type = 'click'")
def metric_log_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = F.format_string("%s METRICS prompt_tokens=%d generated_tokens=%d ttft_ms=%.3f prompt_decode_ms=%.3f generation_ms=%.3f total_ms=%.3f throughput_tok_s=%.3f eog=yes", "event_type", "event_id", F.col("event_id") % 7, "value", "value", "value", F.round("value", 3), "value")
    # lines of other events have no marker or lack a measure, so that the reader skips them
    other = F.when(F.col("event_id") % 2 == 0, F.replace(line, F.lit("METRICS "), F.lit(""))).otherwise(F.regexp_replace(line, " total_ms=[^ ]*", ""))
    found = metric_lines(e.select(F.when(F.col("event_type") == "click", line).otherwise(other).alias("value")))
    return found.select(F.col("prompt_tokens").cast("long").alias("prompt_tokens"), "generated_tokens", "total_ms", "eog")


def _blocks_sql(pairs: str) -> str:
    """``pairs`` (x, y) with m, the letters in the matching blocks of x and y: the longest block that both have, the first in x and then in y, and the same before and after it. For texts of less than 200 letters."""
    longest = """list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j:
      struct_pack(k := len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: x[i + 1 : i + n] = y[j + 1 : j + n])), i := -i, j := -j)))))"""
    return f"""parts(x, y, alo, ahi, blo, bhi, k) AS (
  SELECT x, y, 0::BIGINT, length(x), 0::BIGINT, length(y), 0::BIGINT FROM {pairs}
  UNION ALL
  SELECT x, y, CASE side WHEN 0 THEN alo WHEN 1 THEN i + k ELSE 0 END, CASE side WHEN 0 THEN i WHEN 1 THEN ahi ELSE 0 END, CASE side WHEN 0 THEN blo WHEN 1 THEN j + k ELSE 0 END, CASE side WHEN 0 THEN j WHEN 1 THEN bhi ELSE 0 END, CASE side WHEN 2 THEN k ELSE 0 END
  FROM (SELECT x, y, alo, ahi, blo, bhi, b.k AS k, -b.i AS i, -b.j AS j FROM (SELECT *, {longest} AS b FROM parts WHERE alo < ahi AND blo < bhi) WHERE b.k > 0), (SELECT unnest([0, 1, 2]) AS side)),
matched AS (SELECT x, y, sum(k) AS m FROM parts GROUP BY x, y)"""


@query(f"""WITH RECURSIVE named AS (SELECT p_partkey AS id, p_brand, p_type, trim(regexp_replace(regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM part),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, a.s AS x, b.s AS y FROM named a JOIN named b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.id < b.id WHERE a.s <> '' AND b.s <> '' AND 2.0 * least(length(a.s), length(b.s)) >= 0.93 * (length(a.s) + length(b.s))),
asked AS (SELECT DISTINCT x, y FROM pairs), {_blocks_sql('asked')}
SELECT id_a, id_b, CAST(format('{{:.4f}}', 2.0 * m / (length(x) + length(y))) AS DOUBLE) AS similarity FROM pairs JOIN matched USING (x, y) WHERE 2.0 * m / (length(x) + length(y)) >= 0.93""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole product descriptions of a brand and type whose names are alike."""
    return R.near_copies(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type"], "p_name")


def edited_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, role, text): all turns, and of two in three a copy with an edit: without what follows its last blank, or with its first word twice."""
    own = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    edit = F.when(F.col("id") % 3 == 0, F.regexp_replace("text", r" [^ ]*\z", "")).when(F.col("id") % 3 == 1, F.concat(F.regexp_extract("text", "^[^ ]*", 0), F.lit(" "), F.col("text")))
    return own.unionByName(own.select((F.col("id") + 1_000_000_000).alias("id"), "role", edit.alias("text")))


_EDITED = """own AS (SELECT conv_id * 1000 + turn AS id, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
edited AS (SELECT * FROM own UNION ALL SELECT id + 1000000000, role, CASE id % 3 WHEN 0 THEN regexp_replace(text, ' [^ ]*\\z', '') WHEN 1 THEN regexp_extract(text, '^[^ ]*') || ' ' || text END FROM own)"""


@query()
def near_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a role whose letters are nearly the same. Texts of 200 letters and more leave out letters that are frequent in them, for which SQL has no short words: tested by difflib itself."""
    return R.near_copies(edited_turns(spark, sf_dir), "id", ["role"], "text")


@query(f"""WITH {_EDITED}, sets AS (SELECT list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS w, id FROM edited),
kinds AS (SELECT w, min(id) AS id, count(DISTINCT id) AS copies FROM sets WHERE len(w) > 0 GROUP BY w), t AS (SELECT id, unnest(w) AS t FROM kinds),
common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.id < b.id GROUP BY ALL),
found AS (SELECT id_a, id_b, a.copies AS copies_a, b.copies AS copies_b, k / (len(a.w) + len(b.w) - k) AS jaccard FROM common JOIN kinds a ON a.id = id_a JOIN kinds b ON b.id = id_b)
SELECT id_a, id_b, copies_a, copies_b, round(jaccard, 6) AS jaccard FROM found WHERE jaccard >= 0.94""")
def alike_word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.alike_word_sets(edited_turns(spark, sf_dir), "id", "text").withColumn("jaccard", F.round("jaccard", 6))


@query()
def reworded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with nearly the same words and nearly the same letters. Tested by difflib itself, as ``near_turns``."""
    return M.reworded_texts(edited_turns(spark, sf_dir), "id", "text")
