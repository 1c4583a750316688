"""Mentions of money and time by built-in expressions against the same rules as plain functions."""

import random

from pyspark.sql import functions as F

from tessera.functions import mentions as M
from tessera.functions.markers import CODES_ONLY, WITH_SIGNS, money_in, times_in

PARTS = [
    "2026", "2027 EUR", "EUR 2028", "€2029", "2030€", "$ 12", "310 EUR", "1,234.50 USD", "GBP 1.234,5", "eur 7", "12.50", "2026-04-30", "Sept", "May", "march", "Q3", "q9", "first installment", "1st  instalment", "final instalment", "term", "monthly", "due", "semester",
    "for", "Alma", "x2026", "2026.", "EURO 5", "USD,", "\n", " ", "\t", "3 140 EUR", "99 999,99 £", "20261", "May 2026", "2026 EUR for the term", "year 2031 USD", "éEUR 5", "Ünal 2025 GBPx", "2024 ",
]


def test_places(spark):
    texts = ["ab1cd22", "", "1", "x1", "1x", "12 34 é5", "no"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.places(F.col("t"), r"\d+").alias("p")).collect()
    import re

    assert {r.t: [tuple(x) for x in r.p] for r in got} == {t: [(m[0], *m.span()) for m in re.finditer(r"\d+", t)] for t in texts}


def test_mentions_as_plain_functions_have_them(spark):
    rng = random.Random(6)
    rows = []
    for k in range(1500):
        text = "".join(rng.choice(PARTS) + rng.choice([" ", " ", " ", "", ", ", "\n"]) for _ in range(rng.randint(1, 9)))
        rows.append((k, text, [y for y in range(2024, 2032) if rng.random() < 0.3], [m for m in range(1, 13) if rng.random() < 0.3]))
    rows += [(5000, None, [], []), (5001, "", [2026], []), (5002, "a" * 50_000 + " EUR 5 May 2026", [], [])]
    frame = spark.createDataFrame(rows, "k int, t string, years array<int>, months array<int>")
    c = F.col
    got = frame.select("k", *(M.times(c("t"), c("years"), s, m).alias(f"t{i}") for i, (s, m) in enumerate(((CODES_ONLY, None), (WITH_SIGNS, None), (WITH_SIGNS, c("months"))))), *(M.money(c("t"), c("years"), s).alias(f"m{i}") for i, s in enumerate((CODES_ONLY, WITH_SIGNS)))).collect()
    by_key, said = {r.k: r for r in got}, 0
    for k, text, years, months in rows:
        r = by_key[k]
        known = set(years)
        assert (r.t0, r.t1, r.t2) == tuple(sorted(x) for x in (times_in(text, known), times_in(text, known, WITH_SIGNS), times_in(text, known, WITH_SIGNS, set(months)))), text
        for found, style in ((r.m0, CODES_ONLY), (r.m1, WITH_SIGNS)):
            assert [(x.currency, x.amount) for x in found] == money_in(text, known, style), text
        said += len(r.t1) + len(r.m1)
    assert said > 3000


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([("x",)], "t string")
    plan = rows.select(M.times(F.col("t"), F.array(F.lit(2026))), M.money(F.col("t"), F.array(F.lit(2026))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
