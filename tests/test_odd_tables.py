"""Queries against their SQL, on tables with rows that the given ones have few or none of."""

import datetime
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import stats as S
from tessera.plans import checks, details, reviews  # noqa: F401  their queries join the others
from tessera.plans.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")


def compared(spark, sf, name):
    """(rows of the query, rows of its SQL), sorted."""
    with duckdb.connect() as db:
        db.execute("set threads = 1")  # rows are met in the order of the files
        for path in sf.glob("*.parquet"):
            db.execute(f"create view {path.stem} as select * from '{path}/*.parquet'")
        found = QUERIES[name](spark, str(sf))
        want = db.execute(f"select {', '.join(found.columns)} from ({SQL[name]})").fetchall()
    return sorted(map(repr, map(tuple, found.collect()))), sorted(map(repr, want))


def events(spark, sf, rows):
    frame = spark.createDataFrame([(k, datetime.datetime(2024, 1, 1), k, "error", v, "{}") for k, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    frame.coalesce(1).write.parquet(f"{sf}/events.parquet")


def test_first_of_equal_losses(spark, tmp_path):
    log = spark.createDataFrame([(30, 0.5), (20, 0.5), (10, 0.7), (5, None), (40, 0.5)], "step long, eval_loss double")
    for parts in (1, 3):
        assert tuple(S.best_checkpoint(log.repartition(parts, "step")).first()) == (20, 0.5)
        assert tuple(S.best_checkpoint(log.orderBy(log.step.desc()).coalesce(parts)).first()) == (20, 0.5)
    events(spark, tmp_path, [(k, 0.01 if k % 20 == 10 else 1.0) for k in range(200)])
    got, want = compared(spark, tmp_path, "best_checkpoint")
    assert got == want == ["(10, 0.01)"]


def test_rates_without_time(spark, tmp_path):
    events(spark, tmp_path, [(k, [0.0, 2.5, -1.0, None][k % 4 if k % 8 < 4 else 0]) for k in range(900)])
    got, want = compared(spark, tmp_path, "generation_measures")
    assert got == want and sum("inf" in r for r in got) > 100 and sum("None" in r for r in got) > 10


def test_rates_of_odd_events(spark, tmp_path):
    """Rates beyond ten digits, measures without an id, events of no kind, and times too short for a number of seconds."""
    rng = random.Random(6)
    rows = [(None if k % 50 == 9 else -k if k % 50 == 10 else k, [None, " ", "error"][k % 3], {1: 0.0, 2: -0.0, 3: 5e-324, 5: float("inf"), 6: float("nan")}.get(k % 100, 10 ** rng.uniform(-9, 2))) for k in range(3000)]
    spark.createDataFrame([(k, datetime.datetime(2024, 1, 1), 1, kind, v, "{}") for k, kind, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = compared(spark, tmp_path, "generation_measures")
    assert [r.replace("-0.0", "0.0") for r in got] == [r.replace("-0.0", "0.0") for r in want] and len(got) > 2000


def orders(spark, sf, amounts):
    """Orders of these amounts, by customers of five regions."""
    day = lambda k: datetime.datetime(1992 + k % 7, 1 + k % 12, 1 + k % 28)
    spark.createDataFrame([(k, k % 25, "O", float(x), day(k), ["1-URGENT", "5-LOW"][k % 2]) for k, x in enumerate(amounts)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame([(k, f"Customer#{k:09}", k, 1.0, "X") for k in range(25)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{sf}/customer.parquet")
    spark.createDataFrame([(k, f"NATION_{k}", k % 5) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{sf}/nation.parquet")


@pytest.mark.parametrize("name", ["structured_consistency", "structured_consistency_signs"])
def test_amounts_like_years(spark, tmp_path, name):
    orders(spark, tmp_path, [[2000 + k % 101, 1999 + k % 7, 2028.5, 1000 * (k % 900), k % 300 / 10][k % 5 if k % 3 else 0] for k in range(1500)])
    got, want = compared(spark, tmp_path, name)
    assert got == want


def test_repeated_lines_by_counting(spark):
    rng = random.Random(4)
    texts = [rng.choice(["\n", "\r\n", "\r", "\n \n"]).join(f"{rng.choice(' .')}{rng.choice('abcd'[: rng.randint(1, 4)])} " for _ in range(rng.randint(0, 9))) for _ in range(600)] + [None, "", " \n"]
    texts += ["\n".join(f"a line that no other one is like, {k} {'x' * 40}" for k in range(8000))]
    lines = lambda t: [x for x in (y.strip() for y in re.split("\r\n|\n|\r", t or "")) if x]
    want = [len(x) >= 4 and max(map(x.count, x[:400])) / len(x) >= 0.6 for x in map(lines, texts)]
    began = time.time()
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert [r.r for r in frame.select("k", T.repetition(F.col("t")).alias("r")).orderBy("k").collect()] == want and 20 < sum(want) < 580, sum(want)
    assert time.time() - began < 30  # lines are compared with one, not with each other


def test_gates_make_their_lines_once(spark, tmp_path):
    orders(spark, tmp_path, [1000.5 + k for k in range(400)])
    spark.createDataFrame([(1, "a", "en", "s"), (2, "a", "en", "s"), (3, "b", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "o_orderkey" not in QUERIES["validation_gates"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    got, want = compared(spark, tmp_path, "validation_gates")
    assert got == want


def test_gate_tells_records_of_equal_ids_apart(spark, tmp_path):
    orders(spark, tmp_path, [1000.5 + k for k in range(400)])
    rows = spark.read.parquet(f"{tmp_path}/orders.parquet")
    big = tmp_path / "big"  # ids have seven digits, so keys of nine share one
    for name in ("customer", "nation"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{big}/{name}.parquet")
    rows.withColumn("o_orderkey", F.col("o_orderkey") + 200_000_000).write.parquet(f"{big}/orders.parquet")
    spark.createDataFrame([(1, "a", "en", "s"), (2, "b", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{big}/documents.parquet")
    got, want = compared(spark, big, "validation_gate")
    assert got == want == ["(20, 10, 0, False)"]
    plan = QUERIES["validation_gate"](spark, str(big))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 == plan.count("Relation [o_orderkey")  # lines are made and parsed once
