import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import quantiles as Q
from tessera.operators import stats as S

WANTED = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]


def plain(values, q):
    own = sorted(v for v in values if v is not None)
    if not own:
        return None
    at = (len(own) - 1) * q
    low, high = own[math.floor(at)], own[min(math.floor(at) + 1, len(own) - 1)]
    return low if at == math.floor(at) or low == high else low + (high - low) * (at - math.floor(at))


def test_quantiles_by_sorting(spark):
    rng = random.Random(2)
    rows = []
    for group, draw in {
        "normal": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randrange(3)), "one": lambda: 7.5, "scales": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300), "near": lambda: 1 + rng.randrange(5) * 2.0**-52,
        "zeros": lambda: rng.choice([0.0, -0.0, 5e-324, -5e-324]), "holes": lambda: rng.choice([None, 1.0, 2.0, 10.0]), "ends": lambda: rng.choice([math.inf, -math.inf, 3.0]), None: lambda: float(rng.randrange(100)), "none": lambda: None,
    }.items():
        rows += [(group, draw(), rng.randrange(10)) for _ in range(rng.choice([101, 200]))]
    rows.append(("single", 4.0, None))
    frame = spark.createDataFrame(rows, "g string, x double, k int").withColumn("m", F.lit("m")).withColumn("key", F.lit("key")).repartition(6)
    got = {r.g: (r.x, r.k) for r in Q.exact_quantiles(frame, ["g"], ["x", "k"], WANTED).collect()}
    assert set(got) == {g for g, _, _ in rows}
    for g, (x, k) in got.items():
        for found, column in ((x, 1), (k, 2)):
            want = [plain([r[column] for r in rows if r[0] == g], q) for q in WANTED]
            assert [v if v is None else repr(v) for v in found] == [v if v is None else repr(float(v) + 0.0) for v in want], g


def test_quantiles_of_nan_and_of_all_rows(spark):
    rows = [(float(v),) for v in (3, 1, 2)] + [(math.nan,), (-math.nan,)]
    frame = spark.createDataFrame(rows, "x double")
    ((got,),) = [tuple(r) for r in Q.exact_quantiles(frame, [], ["x"], [0.0, 0.5, 1.0]).collect()]
    assert got[:2] == [1.0, 3.0] and math.isnan(got[2])
    assert [tuple(r) for r in Q.exact_quantiles(frame.limit(0), [], ["x"], [0.5]).collect()] == [([None],)]
    assert Q.exact_quantiles(frame.withColumn("g", F.lit(1)).limit(0), ["g"], ["x"], [0.5]).count() == 0
    big = spark.range(200_000).select((F.col("id") * 7919 % 200_000 / 3).alias("x"))
    assert Q.exact_quantiles(big, [], ["x"], [0.5, 0.999]).first()[0] == np.quantile(np.arange(200_000) / 3, [0.5, 0.999]).tolist()


def test_no_task_holds_the_values_of_a_group(spark):
    """Each level counts buckets of bits, with sums in the tasks that read; there is no percentile and no sort of the rows."""
    keyed = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("key"))
    plan = Q.selected(keyed, spark.createDataFrame([(1, 5)], "g int, rank long"))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower() and "collect" not in plan.lower()
    assert plan.count("partial_count") >= 4
    for line in plan.splitlines():
        if "Sort [" in line or "Exchange" in line:
            assert "key#" not in line or "part" in line


def test_described_rows(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "k string, x double")
    got = {r.k: r.asDict() for r in S.describe_by(frame, "k", ["x"]).collect()}
    assert got["a"] == {"k": "a", "runs": 2, "x_mean": 2.0, "x_median": 2.0, "x_p95": 2.9, "x_min": 1.0, "x_max": 3.0, "x_std_dev": round(math.sqrt(2), 6)}
    assert (got["b"]["x_median"], got["b"]["x_std_dev"], got["c"]["x_p95"], got["c"]["x_mean"]) == (5.0, 0.0, None, None)
