import json
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import profile as P

ROWS = [(k, "abc"[k % 3] if k % 7 else None, "xy"[k % 2], float(k) if k % 4 else None) for k in range(50)]


def frame(spark):
    return spark.createDataFrame(ROWS, "seq long, a string, b string, x double").withColumn("n", F.lit(1)).withColumn("part", F.lit("p")).repartition(4)


def test_tallies_by_counters(spark):
    got = P.tallies(frame(spark), {"a": F.col("a"), "b": F.col("b"), "all": F.lit("")}, {"x": F.col("x")}, "seq", {"b": F.col("seq") < 10}).collect()
    for part, values in (("a", [r[1] for r in ROWS]), ("b", [r[2] for r in ROWS[:10]])):
        assert {r.key: r.n for r in got if r.part == part} == Counter(values)
        assert {r.key: r["first"] for r in got if r.part == part} == {v: values.index(v) for v in values}
    (x,) = [r for r in got if r.part == "x"]
    numbers = [r[3] for r in ROWS if r[3] is not None]
    assert (x.key, x.n, x.least, x.most, x.total) == (None, len(numbers), min(numbers), max(numbers), sum(numbers))
    assert P.tallies(frame(spark).limit(0), {"a": F.col("a")}).count() == 0


def test_report_reads_the_rows_once(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "rows"))
    tally = P.tallies(spark.read.parquet(str(tmp_path / "rows")), {"a": F.col("a"), "b": F.col("b")}, {"x": F.col("x")})
    report = P.report_of(tally)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "rows") not in plan and "tallies" in plan
    found = json.loads(report.first().report)
    assert found["a"] == {"rows": 50, "different": 4, "counts": {str(k).lower() if k is None else k: n for k, n in Counter("null" if r[1] is None else r[1] for r in ROWS).items()}}
    assert found["b"]["counts"] == {"x": 25, "y": 25} and found["x"]["n"] == 37 and abs(found["x"]["mean"] - sum(k for k in range(50) if k % 4) / 37) < 1e-9
    assert json.loads(P.report_of(tally, 1).first().report)["a"]["counts"].keys() <= {"a", "b", "c"}
    assert json.loads(P.report_of(tally.limit(0)).first().report) == {}


def test_measures_are_taken_while_writing(spark, tmp_path):
    seen = P.written_and_observed(frame(spark), lambda rows: rows.write.json(str(tmp_path / "out")), rows=F.count("*"), most=F.max("x"), nulls=F.count_if(F.col("a").isNull()))
    assert seen == {"rows": 50, "most": 49.0, "nulls": sum(r[1] is None for r in ROWS)} and spark.read.json(str(tmp_path / "out")).count() == 50
