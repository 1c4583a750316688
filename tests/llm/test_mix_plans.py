"""The mix plans its histograms one by one, so that no plan holds all the refinements before it."""

from pyspark.sql import functions as F

from tessera.llm import mixture


def test_no_plan_of_the_mix_holds_the_ones_before_it(spark, monkeypatch):
    joins, write = [], mixture.materialise

    def counted(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, name)

    monkeypatch.setattr(mixture, "materialise", counted)
    sizes = spark.range(400).select(F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"), (F.col("id") % 50).alias("size"), F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h"))
    plan = mixture.plan_mix(write(sizes, "sizes"), [5.0, 2.0, 1.0])
    assert max(joins) <= 3
    # of each source as many words as its target, but for less than the largest document
    rows = {r["source"]: r for r in plan.collect()}
    under = F.exists("rules", lambda r: (F.col("size") <= r["cap"]) & (F.col("h") >= r["low"]) & (F.col("h") < r["end"]))
    p = plan.withColumnRenamed("source", "s")
    taken = sizes.join(p, sizes["source"].eqNullSafe(p["s"])).groupBy("source").agg(F.sum(F.col("size") * (F.col("whole") + under.cast("int"))).alias("n")).collect()
    assert len(rows) == len(taken) == 4
    assert all(0 <= rows[r["source"]]["target"] - r["n"] < 50 for r in taken)
