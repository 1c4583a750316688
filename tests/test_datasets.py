"""Raw records, constraints, alignment, readers, writers, hooks and the streaming twin."""

import difflib
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import calendar as C
from tessera.functions import text as T
from tessera.operators import compare as O
from tessera.operators import datasets as D
from tessera.operators import hooks as H
from tessera.operators import raw as W
from tessera.operators import records as R
from tessera.operators import stats as S
from tessera.operators import training as L
from tessera.sources import readers as I
from tessera.sources import writers as X
from tessera.streaming.metrics import Monitor, distinct_runs, windowed

FINE = {"id_example": "EX1", "activity_type": "GENERATION", "operation_category": "RENT", "beneficiary": "B", "amount": 5, "currency": "EUR", "reference_period": None, "input_text": None, "calendar_context": None, "expected_output": ["one", "two"], "language": "en", "split": None}


def broken(spark, **changes):
    row = {k: v for k, v in (FINE | changes).items() if v != "ABSENT"}
    return sorted((r.rule, r.detail) for r in W.raw_violations(spark.createDataFrame([(json.dumps(row),)], "value string")).collect())


def test_raw_rules(spark):
    assert broken(spark) == [] == broken(spark, amount=1.5) == broken(spark, operation_category=" rent ", currency=" eur ")
    assert broken(spark, split="ABSENT", note=1, other=2) == [("extra_fields", "note, other"), ("missing_fields", "split")]
    assert [x for x, _ in broken(spark, expected_output=["", " "])] == ["outputs_distinct", "outputs_items_nonempty", "outputs_items_nonempty"]
    assert [x for x, _ in broken(spark, activity_type=None, calendar_context={"event_title": "t", "event_date": "2026-2-3", "event_category": "c"})] == ["activity_enum", "calendar_only_generation"]
    assert [x for x, _ in broken(spark, activity_type="COMPLETION", calendar_context=5)] == ["calendar_object", "calendar_only_generation", "cn_calendar_null", "cn_input_nonempty"]
    for wrong in (True, "5", None, 0, [1]):
        assert [x for x, _ in broken(spark, amount=wrong)] == ["amount_positive"]
    lines = spark.createDataFrame([("",), ("[1]",), ("{bad",), (json.dumps(FINE),)], "value string")
    assert W.parsed(lines).count() == 1 and W.parsed(lines.limit(0)).count() == 0


def test_typed_rules_count_each_item(spark):
    context = "calendar_context struct<event_title:string,event_date:string,event_category:string>"
    schema = f"id_example string, activity_type string, operation_category string, beneficiary string, amount double, currency string, reference_period string, input_text string, {context}, expected_output array<string>, language string, split string"
    rows = [("a", "GENERATION", "X", "b", 1.0, "EUR", None, None, None, ["", None], "en", None), ("b", None, "X", "b", 1.0, "EUR", None, None, ("t", "2026-02-30", "c"), ["p", "q"], "en", None)]
    got = sorted((r.id_example, r.rule) for r in R.violations(spark.createDataFrame(rows, schema)).collect())
    assert got == [("a", "outputs_distinct"), ("a", "outputs_items_nonempty"), ("a", "outputs_items_nonempty"), ("b", "activity_enum"), ("b", "calendar_date"), ("b", "calendar_only_generation")]


def test_alignment_refuses_other_sets(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "x")], "k int, b string")
    assert D.aligned(a, a.withColumnRenamed("a", "b"), "k").count() == 2
    with pytest.raises(Exception, match="not in all sets: 2"):
        D.aligned(a, b, "k").collect()


def test_near_copies_by_difflib(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        text = "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 60))) if i % 3 or not rows else rows[-1][2][:-1] + rng.choice("abc")
        rows.append((i, "xy"[(i + 1) // 3 % 2] if (i + 1) // 3 % 5 else None, text))
    got = {(r.id_a, r.id_b, r.similarity) for r in R.near_copies(spark.createDataFrame(rows, "id int, block string, text string"), "id", ["block"], "text", 0.8).collect()}
    own = [(i, b, " ".join(t.split())) for i, b, t in rows]
    want = set()
    for i, b, s in own:
        for j, c, t in own:
            if i < j and b == c and b and s and t and (ratio := difflib.SequenceMatcher(None, s, t).ratio()) >= 0.8:
                want.add((i, j, round(ratio, 4)))
    assert got == want and want


def test_contained_items(spark):
    items = spark.createDataFrame([(1, "Two words"), (2, "ab"), (3, "the inner Word counts"), (4, None), (5, "never said here at all")], "item int, part string")
    rows = spark.createDataFrame([(1, "xtwo wordsy THE INNER WORD COUNTs"), (2, None), (3, "cab"), (4, "the inner words counts")], "row int, text string")
    for most in (1 << 24, 8):
        assert {(r.item, r.row) for r in R.contained_items(items, rows, "item", "part", "row", "text", most).collect()} == {(1, 1), (3, 1), (2, 3)}


def test_split_of_null_strata(spark):
    rows = spark.range(40).select("id", F.when(F.col("id") % 2 == 0, "a").alias("s"))
    got = R.stratified_split(rows, "id", ["s"]).groupBy("s", "split").count().collect()
    assert {(r.s, r.split, r["count"]) for r in got} == {(s, x, n) for s in ("a", None) for x, n in (("train", 16), ("validation", 2), ("test", 2))}


def test_readers(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    good, bad = I.tolerant_jsonl(spark, str(path), "a int")
    assert {(r.a, r.line) for r in good.collect()} == {(1, 1), (2, 4)} and {(r.line, r.error) for r in bad.collect()} == {(2, "Empty line"), (3, "Invalid JSON")}
    with pytest.raises(Exception, match="line 3"):
        I.strict_jsonl(spark, str(path), "a int").collect()
    path.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in I.strict_jsonl(spark, str(path), "a int").collect()) == [1, 2] == sorted(r.a for r in I.plain_jsonl(spark, str(path), "a int").collect())
    parts = {x: str(path) for x in ("train", "test")}
    assert sorted((r.a, r.split) for r in I.split_sets(spark, parts, "a int").collect()) == [(1, "test"), (1, "train"), (2, "test"), (2, "train")]
    csv = tmp_path / "a.csv"
    csv.write_bytes('﻿"run","ms","task"\r\n"1","12,5","a ""b"""\r\n"2","",""\r\n'.encode())
    rows = I.locale_csv(spark, str(csv), ["ms"])
    assert rows.columns == ["run", "ms", "task"] and [tuple(r) for r in rows.orderBy("run").collect()][0] == ("1", 12.5, 'a "b"')
    doc = tmp_path / "doc.json"
    doc.write_bytes('﻿{"a":\n {"b": 1}}'.encode())
    assert I.json_document(spark, str(doc)).first().a.b == 1
    state = tmp_path / "state.json"
    state.write_text(json.dumps({"best": 1, "log_history": [{"step": 10, "loss": 2.0}, {"step": 10, "eval_loss": 0.5, "epoch": 1.0}, {"step": 20, "eval_loss": 0.3}]}))
    assert tuple(S.best_checkpoint(I.training_log(spark, str(state))).first()) == (20, 0.3)


def test_lines_of_many_pieces(spark, tmp_path):
    for name, n in (("a.txt", 3000), ("b.txt", 10)):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" for k in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = I.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3010 and all(r.value == f"{r.file[-5:]} {r.line}" for r in rows)


def test_fingerprints(spark, tmp_path):
    for name, n in (("small.bin", 10), ("large.bin", 5000)):
        (tmp_path / name).write_bytes(bytes(range(256)) * (n // 256 + 1))
    want = {(p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}
    for whole in (1 << 20, 1000):
        assert {(r.path.rsplit("/", 1)[-1], r.bytes, r.sha256) for r in I.fingerprints(spark, str(tmp_path), whole).collect()} == want


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é", None), (2, 'a"b', "x")], "k int, a string, b string")
    X.write_jsonl(rows, str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["k"]) == [{"k": 1, "a": "é", "b": None}, {"k": 2, "a": 'a"b', "b": "x"}]
    X.write_csv(rows, str(tmp_path / "c"), ["a", "k"])
    assert next((tmp_path / "c").glob("part-*")).read_text().splitlines()[0] == "a,k"
    for write in (lambda: X.write_jsonl(rows, str(tmp_path / "j")), lambda: X.write_csv(rows, str(tmp_path / "c"), ["k"]), lambda: X.write_report(str(tmp_path / "r"), n=rows.agg(F.count("*").alias("n")))):
        if not (tmp_path / "r").exists():
            X.write_report(str(tmp_path / "r"), n=rows.agg(F.count("*").alias("n"), F.max(F.lit(None).cast("int")).alias("none")), m=rows.agg(F.max("k").alias("k")))
        with pytest.raises(Exception, match="(?i)exists"):
            write()
    X.write_jsonl(rows, str(tmp_path / "j"), overwrite=True)
    text = next((tmp_path / "r").glob("part-*")).read_text()
    assert json.loads(text) == {"n": {"n": 2, "none": None}, "m": {"k": 2}} and text.count("\n") > 5
    assert json.loads(X.report(m=rows.agg(F.max("k").alias("k"))).first().report) == {"m": {"k": 2}}
    assert [r.value for r in X.text_report(rows.orderBy("k"), "%d: %s", ["k", "a"]).collect()] == ["1: é", '2: a"b']
    assert [r.k for r in X.remaining(rows, rows.where("k = 1"), "k").collect()] == [2]


def test_resume_refuses_other_outputs(spark):
    work = spark.createDataFrame([(k, f"p{k}") for k in range(5)], "index int, prompt string")
    assert sorted(r["index"] for r in X.resumed(work, work.where("index < 2"), "index", "prompt").collect()) == [2, 3, 4]
    for done, why in ((work.where("index in (0, 2)"), "1 is missing"), (spark.createDataFrame([(0, "other")], "index int, prompt string"), "another prompt"), (spark.createDataFrame([(k, f"p{k}") for k in range(7)], "index int, prompt string"), "not in the work")):
        with pytest.raises(ValueError, match=why):
            X.resumed(work, done, "index", "prompt")


def test_hooks_around_models(spark):
    rows = spark.createDataFrame([(1, ["ab", "cd"], ["cd", "ab"]), (2, ["ab"], ["ab", " "]), (3, [], ["a", "b"])], "k int, p array<string>, r array<string>")
    make = lambda: lambda a, b: [float(x == y) for x, y in zip(a, b, strict=True)]
    assert {r.k: r.s for r in H.pair_scores(rows, "k", "p", "r", make, "s", 2).collect()} == {1: 1.0, 2: 0.5, 3: 0.0}
    assert {r.s for r in H.pair_scores(rows, "k", "p", "r", None, "s").collect()} == {None}
    work = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "index int, prompt string")
    answers = {"b": [5, 6, 0, 7], "c": [1, 2, 3, 4, 5]}
    got = H.generated(work, work.where("index = 0"), "index", "prompt", lambda: lambda prompts: [answers[p] for p in prompts], 0, 4).collect()
    assert {(r["index"], tuple(r.ids), r.ended, r.hit_limit) for r in got} == {(1, (5, 6), True, False), (2, (1, 2, 3, 4), False, True)}


def test_limits_and_chats(spark):
    rows = spark.createDataFrame([("a", [1, 2], [3]), ("b", [1] * 9, [2])], "k string, p array<int>, c array<int>")
    assert L.within_limit(rows, "p", "c", 10, "k").count() == 2
    with pytest.raises(ValueError, match=r"b \(10\)"):
        L.within_limit(rows, "p", "c", 9, "k")
    chat = rows.select(L.chat([("user", "q"), ("assistant", "a")], F.col("k")).alias("m")).first().m
    assert [(x.role, x.content) for x in chat] == [("user", "q"), ("assistant", "a"), ("user", "a")]


def test_text_functions(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert one("1.a\n2. b\n1. c", T.suggestions) == ["c", "b"]
    assert one("Ｍodel ② (x)", T.slug) == "model_2_x" and one("ﬁne", lambda c: T.normalised(T.nfkc(c))) == "fine"
    assert one("A-1", lambda c: T.prediction_filename(c, F.lit("Set 2"))) == "a_1__set_2.jsonl"
    assert one("p\r\n\n", T.prompt_boundary) == "p\n\n" and one("x" * 5, lambda c: T.truncated(c, 3)) == "xxx\n[truncated]"
    assert one("a Output:\nb", T.after_marker) == "b" and one("none", T.after_marker) == "none"
    assert one("a b c", lambda c: T.jaccard(c, F.lit("b c d"))) == 0.5 and one("a", lambda c: T.reworded(c, c)) and not one("a", lambda c: T.reworded(c, F.lit("b")))
    assert one("  x\t", T.strip) == "x" and one("  ", T.strip) == ""
    rows = spark.createDataFrame([(["one"],)], "expected_output array<string>")
    with pytest.raises(Exception, match="exactly two"):
        rows.select(R.completion()).collect()


def test_calendar_functions(spark):
    rows = spark.createDataFrame([(1767225600000, True, "Public Holidays", "x"), (1767225600000, False, "mine", " "), (None, None, None, "y")], "ms long, all_day boolean, name string, title string")
    got = rows.select(C.event_day(F.col("ms"), F.col("all_day"), "America/New_York").cast("string").alias("d"), C.shown_calendar(F.col("name"), F.col("title")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("2026-01-01", False), ("2025-12-31", False), (None, True)]


def test_small_summaries(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test")], "id string, split string")
    assert [tuple(r) for r in O.split_overlaps(rows, "id").collect()] == [("a", "test,train")]
    loads = spark.createDataFrame([("cold", 10.0), ("warm", 4.0), ("warm", 6.0)], "c string, v double")
    assert tuple(S.cold_warm(loads, "c", "v").first()) == (10.0, 5.0, 5.0, 4.0, 6.0, 50.0)
    runs = spark.createDataFrame([("yes",), ("YES",), ("no",)], "eog string")
    assert tuple(D.runs_all_ok(runs, 3).first()) == (3, 2, False) and D.runs_all_ok(runs.where("eog <> 'no'"), 2).first().ok
    assert D.first_rows(rows.withColumn("seq", F.lit(0)), "seq", None).count() == 3
    with pytest.raises(ValueError):
        D.first_rows(rows, "split", 0)
    form = spark.createDataFrame([("b", " ", "EUR", None), ("b", "1", "EUR", "c")], "b string, a string, c string, k string")
    assert [r.e for r in form.select(D.form_error(F.col("b"), F.col("a"), F.col("c"), F.col("k")).alias("e")).collect()] == ["amount", None]
    assert D.nonblank(form, "a").count() == 1 and [r.b for r in D.final_shuffle(rows.withColumnRenamed("id", "b"), "b").collect()] == [r.b for r in D.final_shuffle(rows.withColumnRenamed("id", "b"), "b").collect()]
    refs = spark.createDataFrame([("1. one\n2. two", ["One!", "two"]), ("1. one", ["one", "two"])], "c string, r array<string>")
    assert [r.x for r in refs.select(R.references_contained(F.col("c"), F.col("r")).alias("x")).collect()] == [True, False]


def test_stream_equals_batch(spark, tmp_path):
    schema = "id int, time timestamp, value string"
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda k: f"METRICS prompt_tokens={k} generated_tokens=1 ttft_ms=1 prompt_decode_ms=1 generation_ms=1 total_ms={k} throughput_tok_s=1 eog=yes"
    rows = [{"id": k, "time": f"2026-01-01T00:{k:02d}:00Z", "value": line(k)} for k in range(6)]
    for name, part in (("a", rows[:3] + rows[:2]), ("b", rows[2:]), ("c", [{"id": 9, "time": "2026-01-01T00:09:00Z", "value": "DEPLOYMENT_BENCHMARK_COMPLETE runs=6"}])):
        (folder / f"{name}.json").write_text("\n".join(json.dumps(x) for x in part))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    count = lambda df: windowed(distinct_runs(df, "time", ["id"], "1 hour").withColumn("k", F.lit("k")), "time", "k", "id", "2 minutes", None)
    query = count(stream()).writeStream.format("memory").queryName("counted").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows_of = lambda df: sorted((str(r.start), r.n, r.total) for r in df.collect())
    batch = spark.read.schema(schema).json(str(folder))
    # a window is told again whenever it grows
    last = spark.table("counted").groupBy("start").agg(F.max("n").alias("n"), F.max("total").alias("total"))
    assert rows_of(last) == rows_of(count(batch))
    monitor = Monitor(str(tmp_path / "out"))
    assert monitor.watch(stream(), str(tmp_path / "cp2"), timeout=60, every=0.1) == "done"
    assert spark.read.parquet(str(tmp_path / "out")).select("prompt_tokens").distinct().count() == 6
    (folder / "c.json").unlink()
    (folder / "d.json").write_text(json.dumps({"id": 1, "time": "2026-01-01T00:10:00Z", "value": "DEPLOYMENT_BENCHMARK_ERROR"}))
    with pytest.raises(RuntimeError):
        Monitor(str(tmp_path / "out2")).watch(stream(), str(tmp_path / "cp3"), timeout=60, every=0.1)


def test_cover_of_a_split_is_one_aggregation(spark):
    """Ids meet in one aggregation, not in joins; null ids of the set and of a part are not the same."""
    frame = lambda rows: spark.createDataFrame(rows, "id int, split string")
    whole = frame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "b")])
    found = D.split_cover(whole, {"a": frame([(1, "a"), (2, None), (2, "a"), (None, "a")]), "b": frame([(1, "b"), (9, "a")])}, "id")
    want = [(1, "shared"), (2, "label"), (3, "lost"), (9, "stray"), (9, "label"), (None, "lost"), (None, "stray")]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
