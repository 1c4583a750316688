from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.operators import records as R
from tessera.sources.readers import metric_lines, process_status, tolerant_jsonl


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_golden_cases(spark):
    assert one(spark, "Paid 12.50 in May 2026!", T.normalised_for_copies) == "paid <num> <num> in <month> <num>"
    assert [one(spark, x, N.parse_money) for x in ("1,200", "444,68", "1.200", "444.68")] == [1200, 444.68, 1200, 444.68]
    assert [one(spark, x, N.format_amount) for x in ("750.0", "35.50", "123.45")] == ["750", "35.5", "123.45"]
    assert one(spark, "x\nx\nx\ny", T.repetition) and not one(spark, "x\nx\nx", T.repetition)
    assert one(spark, "1. a\n1. b\n2. c", T.suggestions) == ["b", "c"]
    assert one(spark, "Paid €2 and GBP 3", N.currencies) == ["EUR", "GBP"]


def test_similarity_depends_on_order(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [r.s for r in rows.select(T.similarity_udf("a", "b").alias("s")).collect()] == [0.25, 0.5]


def test_split_sizes(spark):
    for n, want in ((5, (4, 0, 1)), (15, (12, 2, 1)), (25, (20, 2, 3))):
        rows = R.stratified_split(spark.range(n).withColumn("s", F.lit(1)), "id", ["s"]).groupBy("split").count().collect()
        got = {r["split"]: r["count"] for r in rows}
        assert tuple(got.get(k, 0) for k in ("train", "validation", "test")) == want


def test_readers(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n{bad\n[1]\n')
    good, bad = tolerant_jsonl(spark, str(path), "a int")
    assert [r.a for r in good.collect()] == [1]
    assert sorted(r.error for r in bad.collect()) == ["Empty line", "Invalid JSON", "Invalid JSON"]
    lines = spark.createDataFrame([Row(value="VmHWM:\t 2048 kB"), Row(value="x METRICS prompt_tokens=1 generated_tokens=2 ttft_ms=1.5 prompt_decode_ms=1 generation_ms=1 total_ms=3 throughput_tok_s=4 eog=yes"), Row(value="METRICS eog=yes")])
    assert process_status(lines).first().mib == 2.0
    assert [(r.prompt_tokens, r.ttft_ms, r.eog) for r in metric_lines(lines).collect()] == [(1, 1.5, "yes")]
