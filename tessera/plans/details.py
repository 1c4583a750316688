"""Queries on single rules and functions, on rows in which each of them goes either way; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import calendar as C
from tessera.functions import mentions as M
from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.functions.markers import WITH_SIGNS
from tessera.operators import datasets as D
from tessera.operators import raw as W
from tessera.operators import records as R
from tessera.operators import stats as S
from tessera.operators import training as L
from tessera.plans.checks import raw_lines
from tessera.plans.queries import RECORDS, SQL, query, stratified_split, table, transfer_records
from tessera.session import materialise, shared_path
from tessera.sources import jsonl as J
from tessera.sources import readers as I
from tessera.sources import writers as X

# -- events


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_orderdate AS DATE) END NULLS LAST, o_orderkey) AS place FROM orders")
def events_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events, of which one in ten has no date."""
    events = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, F.to_date("o_orderdate")).alias("day"))
    return D.events_in_order(events, "day", ["o_orderkey"], "place").withColumn("day", F.col("day").cast("string"))


@query("""SELECT event_id, strftime(make_timestamp(event_id * 7200000000 + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 18000000000 END), '%Y-%m-%d') AS day,
  event_id % 4 <> 1 AND event_id % 5 <> 2 AS shown FROM events""")
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of events in a zone five hours ahead, or in UTC if they last all day; calendars of holidays and events without a title are not shown."""
    k = F.col("event_id")
    name = F.when(k % 4 == 1, "Public HOLIDAYS").otherwise("mine")
    title = F.when(k % 5 == 2, " \t").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", (k * 7_200_000).alias("millis"), (k % 3 == 0).alias("all_day"), name.alias("name"), title.alias("title"))
    return rows.select("event_id", C.event_day(F.col("millis"), F.col("all_day"), "+05:00").cast("string").alias("day"), C.shown_calendar(F.col("name"), F.col("title")).alias("shown"))


@query(f"""WITH {RECORDS}, e AS (SELECT id_example, seq % 8 AS v, CAST(event_date AS DATE) AS d FROM rec WHERE has_calendar)
SELECT id_example, CASE v WHEN 2 THEN quarter(d) IN (2, 3) AND year(d) IN (2000, 2001) WHEN 4 THEN year(d) IN (2000, 2002) ELSE true END AS coherent FROM e""")
def period_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event falls into the period that a record's text names, by months, quarters and years."""
    k, date = F.col("seq") % 8, F.to_date("calendar_context.event_date")
    own = F.concat(F.lit("early "), F.date_format(date, "MMM"))
    period = F.when(k == 0, own).when(k == 2, "Q2 and q3 of 2000 then 2001").when(k == 4, "years 2000 and 2002").otherwise("the spring semester")
    rows = transfer_records(spark, sf_dir).where("calendar_context is not null")
    return rows.select("id_example", D.period_coherent(F.col("calendar_context.event_date"), period).alias("coherent"))


# -- mentions


@query(f"""WITH {RECORDS}, s AS (SELECT id_example, seq % 9 AS v, 100 + seq % 800 AS a, 2020 + seq % 9 AS y FROM rec)
SELECT id_example, CASE v WHEN 0 THEN 'EUR ' || y || '.0' WHEN 2 THEN 'EUR ' || a || '.0' WHEN 3 THEN 'USD ' || a || '.5' WHEN 4 THEN 'EUR 2028.0' WHEN 5 THEN 'USD 1234.5' WHEN 6 THEN 'GBP ' || (99000 + a) || '.99' ELSE '' END AS money,
  CASE v WHEN 1 THEN 'year:' || y WHEN 3 THEN 'month:9' WHEN 4 THEN 'month:5,year:' || y WHEN 5 THEN 'quarter:3' WHEN 6 THEN 'installment:final' WHEN 7 THEN 'month:4,year:' || y || CASE WHEN y <> 2029 THEN ',year:2029' ELSE '' END ELSE '' END AS times FROM s""")
def mentions_of_money_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years beside amounts, which words near them make points in time, and names that are like months."""
    v, a, y = F.col("seq") % 9, (100 + F.col("seq") % 800).cast("string"), (2020 + F.col("seq") % 9).cast("string")
    lit = F.lit
    texts = [
        F.concat(lit("Fee "), y, lit(" EUR")), F.concat(lit("Fee "), y, lit(" EUR for the term")), F.concat(lit("Gift of "), a, lit(" EUR for Alma Sep")), F.concat(lit("Rent due Sep, $"), a, lit(".50")),
        F.concat(lit("Paid EUR 2028 in May "), y), lit("Q3 fee $1,234.50"), F.concat(lit("final  installment of 99 "), a, lit(",99 £")), F.concat(lit("on "), y, lit("-04-30 and 2029")), lit("May I pay March?"),
    ]
    text = F.lit(None).cast("string")
    for k, own in enumerate(texts):
        text = F.when(v == k, own).otherwise(text)
    none = F.array().cast("array<int>")
    money = F.transform(M.money(text, none, WITH_SIGNS), lambda x: F.concat(x["currency"], F.lit(" "), x["amount"].cast("string")))
    return transfer_records(spark, sf_dir).select("id_example", F.array_join(money, ",").alias("money"), F.array_join(M.times(text, none, WITH_SIGNS, none), ",").alias("times"))


# -- functions on texts and numbers


@query("""SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN 0 ELSE (event_id % 300) / ((event_id % 4) * value / 1000.0) END, 6) AS throughput, event_id % 3 <> 0 AND event_id % 300 >= 256 AS hit FROM events WHERE event_id % 7 <> 0""")
def generation_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per second, and generations that were cut off at their limit; samples with a blank measure are left out. One in four took no time, which is nought; those of the others whose
    value is nought are as fast as can be."""
    k, made = F.col("event_id"), F.col("event_id") % 300
    # no measure without an id; of which kind an event is says nothing
    rows = D.nonblank(table(spark, sf_dir, "events").withColumn("measure", F.when(k % 14 == 0, " ").when(k % 7 != 0, "timed")), "measure")
    return rows.select("event_id", N.rounded(F.when(k % 4 == 0, N.throughput(made, F.lit(0.0))).otherwise(N.rate(made, (k % 4) * F.col("value"))), 6).alias("throughput"), N.hit_limit(k % 3 == 0, made, F.lit(256)).alias("hit"))


@query(f"""WITH {RECORDS}, s AS (SELECT *, seq % 4 AS v FROM rec)
SELECT id_example, CASE v WHEN 0 THEN out1 || '|' || out2 WHEN 1 THEN 'last|' || out2 WHEN 2 THEN out2 ELSE '' END AS suggestions, trim(regexp_replace(lower(beneficiary || ' ' || operation_category || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
  regexp_replace(out1 || CASE v WHEN 0 THEN '' WHEN 1 THEN chr(13) || chr(10) ELSE repeat(chr(10), v) END, '[\\r\\n]+$', '') || chr(10) || chr(10) AS prompt, CASE WHEN length(out1) > 20 THEN substr(out1, 1, 20) || '...' ELSE out1 END AS cut,
  CASE WHEN v = 0 THEN out1 ELSE out2 END AS after, CASE v WHEN 0 THEN NULL WHEN 1 THEN 'beneficiary' WHEN 2 THEN 'amount' ELSE 'currency' END AS form_error FROM s""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions of a reply, slugs, ends of prompts, cut texts, what follows a marker, and the first blank field of a form."""
    v, one, two = F.col("seq") % 4, F.get("expected_output", 0), F.get("expected_output", 1)
    lines = lambda *parts: F.concat_ws("\n", *parts)
    reply = F.when(v == 0, lines(F.concat(F.lit("1. "), one), F.concat(F.lit(" 2."), two))).when(v == 1, lines(F.concat(F.lit("1. "), one), F.concat(F.lit("2. "), two), F.lit("1. last"))).when(v == 2, lines(F.lit("note"), F.concat(F.lit("2. "), two))).otherwise("3. none")
    ends = F.when(v == 0, "").when(v == 1, "\r\n").otherwise(F.repeat(F.lit("\n"), v.cast("int")))
    marked = F.when(v == 0, F.concat(F.lit("x\nOutput:\n"), one)).otherwise(two)
    return transfer_records(spark, sf_dir).select(
        "id_example", F.array_join(T.suggestions(reply), "|").alias("suggestions"), T.slug(F.concat("beneficiary", F.lit(" "), "operation_category", F.lit("!"))).alias("slug"), T.prompt_boundary(F.concat(one, ends)).alias("prompt"),
        T.truncated(one, 20, "...").alias("cut"), T.after_marker(marked).alias("after"), D.form_error(F.when(v != 1, F.col("beneficiary")), F.when(v == 2, " ").otherwise("5"), F.when(v == 3, "\t").otherwise(F.col("currency")), F.col("operation_category")).alias("form_error"),
    )


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE 6 END AS INTEGER) AS n, event_id % 3 = 0 AS ended, CAST(2 + 1 AS INTEGER) AS messages, 'q' || event_id AS asked FROM events")
def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids before the first end id, whether there was one, and chats with two fixed messages."""
    k = F.col("event_id")
    ids = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when((k % 3 == 0) & ((i == k % 5) | (i == 5)), 0).otherwise(i + 1))
    talk = L.chat([("user", "a"), ("assistant", "b")], F.concat(F.lit("q"), k.cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.size(L.before_end(ids, 0)).alias("n"), L.seen_end(ids, 0).alias("ended"), F.size(talk).alias("messages"), F.element_at(talk, -1)["content"].alias("asked"))


# -- gates


@query(f"""WITH {RECORDS} SELECT 'broken' AS set, (SELECT count(*) FROM rec WHERE seq % 40 IN (25, 26)) AS unreadable, (SELECT count(*) FROM ({SQL['raw_record_rules']})) AS errors, (SELECT count(*) FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang, source) AS f FROM documents) WHERE f < doc_id) AS copies, false AS passed
UNION ALL SELECT 'clean', 0, 0, 0, true""")
def validation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set that breaks every rule, and what of it breaks none."""
    records, fine = transfer_records(spark, sf_dir), F.coalesce(F.col("seq") % 40 > 26, F.lit(False))
    # the lines are made once, for all that is counted of them
    clean = materialise(raw_lines(spark, sf_dir, records.where(fine)), "clean")
    lines = materialise(raw_lines(spark, sf_dir, records.where(~fine)), "broken").unionByName(clean)
    counted = lambda rows: W.checked(rows).select(F.col("broken").isNotNull().alias("readable"), F.when(F.col("broken").isNotNull(), F.size("broken")).otherwise(0).alias("errors"))
    documents = table(spark, sf_dir, "documents")
    copies = lambda rows: R.exact_copies(rows, "doc_id", ["text", "lang", "source"], "doc_id")
    first = documents.groupBy("text", "lang", "source").agg(F.min("doc_id").alias("doc_id"))
    broken, passed = D.lines_passed(counted(lines), copies(documents)), D.lines_passed(counted(clean), copies(first))
    return broken.select(F.lit("broken").alias("set"), "*").unionByName(passed.select(F.lit("clean").alias("set"), "*"))


# -- files: rows written as files of their kind, and read back


@query("SELECT event_id, value, 'a \"' || event_type || '\", b' AS task, CASE WHEN event_id % 5 > 0 THEN round(value * 10, 1) END AS ms FROM events")
def locale_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted CSV with decimal commas, quotes within fields and blank numbers."""
    path, comma = shared_path(spark, "csv"), lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    rows = table(spark, sf_dir, "events").select("event_id", comma(F.col("value")).alias("value"), F.concat(F.lit('a "'), "event_type", F.lit('", b')).alias("task"), F.when(F.col("event_id") % 5 > 0, comma(F.round(F.col("value") * 10, 1))).otherwise("").alias("ms"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return I.locale_csv(spark, path, ["value", "ms"]).withColumn("event_id", F.col("event_id").cast("long"))


@query("""SELECT CASE event_id % 4 WHEN 0 THEN 'VmRSS' ELSE 'VmHWM' END AS name, event_id * 1000 AS kib, round(event_id * 1000 / 1024.0, 3) AS mib, round(event_id * 1000 / 1048576.0, 3) AS gib FROM events WHERE event_id % 4 < 2""")
def process_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of process states, of which half speak of the memory that is asked for."""
    k = F.col("event_id")
    name = F.when(k % 4 == 0, "VmRSS").when(k % 4 == 1, "VmHWM").when(k % 4 == 2, "VmPeak").otherwise("x VmRSS")
    return I.process_status(table(spark, sf_dir, "events").select(F.concat(name, F.lit(":\t "), (k * 1000).cast("string"), F.lit(" kB")).alias("value")))


@query("SELECT o_orderkey AS k, o_totalprice AS price, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority || ' é' END AS note, o_orderkey % 2 AS batch FROM orders")
def appended_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of lines, each written twice, as by a run that was repeated."""
    path, k = shared_path(spark, "appended"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_totalprice").alias("price"), F.when(k % 3 > 0, F.concat("o_orderpriority", F.lit(" é"))).alias("note"), (k % 2).alias("batch"))
    for batch in (0, 1, 0, 1):
        J.append_jsonl(rows.where(F.col("batch") == batch), path, f"b{batch}")
    return I.strict_jsonl(spark, path, "k long, price double, note string, batch long")


@query(SQL["stratified_split"])
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a split, each written as lines of its own and read back as one set."""
    rows, paths = materialise(stratified_split(spark, sf_dir), "split"), {}
    for name in ("train", "validation", "test"):
        paths[name] = shared_path(spark, name)
        X.write_jsonl(rows.where(F.col("split") == name), paths[name])
    return I.split_sets(spark, paths, "id_example string, split string").select("id_example", "split")


@query(f"""WITH {RECORDS} SELECT activity_type, operation_category, count(*) AS n FROM rec WHERE seq < 5000 GROUP BY ALL""")
def first_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of the first rows, by name, after they were put into another order."""
    shuffled = D.final_shuffle(transfer_records(spark, sf_dir), "id_example")
    return S.sorted_groups(D.first_rows(shuffled, "seq", 5000), ["activity_type", "operation_category"])


@query("SELECT count(*) AS runs, count(*) FILTER (event_type <> 'error') AS ended, false AS ok FROM events")
def runs_all_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all runs ended by themselves, which some did not."""
    runs = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "no").otherwise("YES").alias("eog"))
    return D.runs_all_ok(runs, runs.count())
