import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import alternatives as A
from tessera.functions import calendar as C
from tessera.functions import grams as G
from tessera.functions.markers import WITH_SIGNS, amount_of, money_in, times_in
from tessera.functions.stems import overlap, stem, stemmed_scores, stems
from tessera.operators import compare as O
from tessera.operators import stats as S
from tessera.operators import training as L
from tessera.operators.consistency import consistency
from tessera.operators.hooks import with_model
from tessera.operators.records import contained_items

NAMED = "Normalized description 1:\n7.45 EUR to Harbour Ferries Ltd. Tickets for the crossing.\n\nNormalized description 2:\n7.45 EUR ferry ticket.\n\nExplanation:\nextra text"
PAIR = ["7.45 EUR to Harbour Ferries Ltd. Tickets for the crossing.", "7.45 EUR ferry ticket."]


def column(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string").select("k", f(F.col("x")).alias("y"))
    return [r.y for r in rows.orderBy("k").collect()]


def test_alternatives_by_lines(spark):
    texts = {
        NAMED: PAIR, "1. a\n2. b": ["a", "b"], "1) a\n2) b\nNote: more": ["a", "b"], '["- a", "", "b", "c"]': ["a", "b"], "a | b | c": ["a", "b"], "- a\n- b": ["a", "b"],
        "Alternatives\nAmount: 3\n* only": ["only"], "a\nb\nc": [], "1. a\n2. b\n3.c": ["a", "b"], "1. a\n2. b\n3. c": ["a", "b\n3. c"], "12.50 EUR": ["12.50 EUR"], "": [], "[broken": ["[broken"], "Reasoning: x": [],
    }
    assert column(spark, [*texts, None], A.alternatives) == [*texts.values(), []]


def test_alternatives_loosely(spark):
    texts = {"so: option 1: a option 2: b": ["a", "b"], "1. a 2. b": ["a", "b"], "a\nb\nc": ["a", "b"], "x | y": ["x", "y"], "12.50 EUR": ["50 EUR"], "": []}
    assert column(spark, [*texts, None], A.alternatives_loose) == [*texts.values(), []]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (NAMED, PAIR),
        ("Here are two:\n\n**Alternative 1:**\nMarch 2029 garden tools GBP 64\n\n**Alternative 2:**\nGBP 64 paid for tools in March 2029", ["March 2029 garden tools GBP 64", "GBP 64 paid for tools in March 2029"]),
        ("### **Option 1 (Concise):**\nPiano lesson USD 35\n\n- **Option 2 (More Formal):**\nUSD 35 for a piano lesson", ["Piano lesson USD 35", "USD 35 for a piano lesson"]),
        ("**Bank-Transfer Description 1:** a b\n**Bank-Transfer Description 2:** c d", ["a b", "c d"]),
        ("1. one\n2. two\n\nAlternative 1: cut", ["one", "two"]),
        ("Option 1: x\nOption 2: y\n\n1. one\n2. two", ["x", "y"]),
        ("**Alternative 1:**\nOnly one of the two came", ["Only one of the two came"]),
        ("**Category:** a\n**Amount:** b\n**Date:** c", []),
        ("1.\n**Category:** Rent\n2.\n**Category:** House", ["**Category:** Rent", "**Category:** House"]),
        ("```text\n1. a\n2. b\n```", ["a", "b"]),
        (None, []),
    ],
)
def test_alternatives_in_markdown(text, found):
    assert A.markdown_alternatives(text) == found


def test_money_and_times():
    assert money_in("garden tools March 2029 GBP 64", {2029}) == [("GBP", 64.0)]
    assert money_in("Half of EUR 81.30 for June 2026\nEUR 81.30 for June 2026", {2026}) == [("EUR", 81.3)] * 2
    assert money_in("Sent €77.05 and $3140.50 and £9", set(), WITH_SIGNS) == [("EUR", 77.05), ("USD", 3140.5), ("GBP", 9.0)]
    assert money_in("2027 EUR", set()) == [("EUR", 2027.0)] and money_in("2027 EUR for the term", set()) == [] and money_in(None, set()) == []
    assert [amount_of(x) for x in ("1,200", "444,68", "1.200", "444.68", "1 200,50", "1,200.50")] == [1200, 444.68, 1200, 444.68, 1200.5, 1200.5]
    assert times_in("roof repair EUR 2041.17", set()) == set() == times_in("EUR 2027", set())
    assert times_in("gift of 310 EUR for Alma Sep", set(), WITH_SIGNS, {5}) == set()
    assert times_in("Rowing club for Sep 2028", set(), WITH_SIGNS, {9}) == {"month:9", "year:2028"}
    assert times_in("Q3, 1st instalment, due 2026-04-30, Sept", set()) == {"quarter:3", "installment:first", "year:2026", "month:4", "month:9"}


@pytest.mark.parametrize("signs", [False, True])
def test_consistency(spark, signs):
    schema = "k int, operation_category string, beneficiary string, amount double, currency string, reference_period string, input_text string, calendar_context struct<event_title:string,event_date:string,event_category:string>, reply string"
    rows = [
        (0, "BILL", "Green Sheds", 64.0, "GBP", "March 2029", None, None, "March 2029 garden tools GBP 64"),
        (1, "BILL", "Green Sheds", 1310.4, "EUR", "2028 Q2", None, None, "Sent EUR 131.04 for 2028 Q2."),
        (2, "BILL", "Green Sheds", 64.0, "EUR", None, None, ("Garden party", "2029-03-03", "x"), "64 USD to Green Sheds for the garden in May 2029"),
        (3, None, None, None, None, None, None, None, None),
    ]
    found = {r.k: r for r in consistency(spark.createDataFrame(rows, schema), "reply", signs).collect()}
    flags = [[getattr(found[k], c) for c in ("currency_consistent", "amount_consistent", "temporal_consistent", "structured_consistent", "beneficiary_mentioned", "calendar_reflected")] for k in range(3)]
    assert flags == [[True, True, True, True, False, None], [True, False, True, False, False, None], [False, False, False, False, True, True]]
    assert found[3].structured_consistent is False
    assert consistency(spark.createDataFrame([], schema), "reply", signs).count() == 0


def test_stems():
    words = "caresses ponies cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing filing happy sky relational conditional digitizer operator triplicate formative electrical hopeful goodness revival allowance adoption probate rate cease controll roll"
    want = "caress poni cat feed agre plaster motor sing conflat troubl size hop tan fall hiss file happi sky relat condit digit oper triplic form electr hope good reviv allow adopt probat rate ceas control roll"
    assert [stem(x) for x in words.split()] == want.split()
    assert stems("The Cats' running!") == ["the", "cat", "run"] and overlap([1, 1, 2], [1, 3]) == 0.4 and overlap([], [1]) == 0


def test_scores_and_labels(spark):
    row = spark.sql("select array('A') p, array('b', 'a') q, array('a', 'b') r, array(1, 2) x, array(3, 0) y, array(3) z").select(
        A.exact_pair(F.col("p"), F.col("r")).alias("half"), A.exact_pair(F.col("q"), F.col("r")).alias("whole"), L.labels(F.col("x"), F.col("y"), 0).alias("has_end"), L.labels(F.col("x"), F.col("z"), 0).alias("gets_end"),
        L.before_end(F.col("y"), 0).alias("cut"), L.trainable(F.col("x"), F.col("z")).alias("unequal"), L.trainable(F.col("x"), F.col("y")).alias("fine"),
    ).first()
    assert row.asDict() == {"half": 0.5, "whole": 1.0, "has_end": [-100, -100, 3, 0], "gets_end": [-100, -100, 3, 0], "cut": [3], "unequal": False, "fine": True}


def test_periods_and_categories(spark):
    today = F.to_date(F.lit("2026-05-01"))
    days = column(spark, ["2026-09-30", "31/2/2026", "30 September 2026", " 30  Sept ", "September 2026", "soon", None], lambda x: C.named_day(x, today).cast("string"))
    assert days == ["2026-09-30", "2026-03-03", "2026-09-30", "2026-09-30", None, None, None]
    assert column(spark, ["September 2027", "may", "x 2027", ""], lambda x: C.named_month(x, today)) == ["2027-09", "2026-05", None, None]
    assert column(spark, ["Classic night", "car inspection", "car", None, "Exam trip"], C.event_category) == ["Course", "Vehicle service", "Event", "Event", "Education"]


def test_numbers_of_all_rows(spark):
    rows = spark.range(1000).withColumn("key", F.pmod(F.col("id") * 37, F.lit(1000))).repartition(7)
    got = S.numbered(rows, ["key"], "run").collect()
    assert sorted(r.run for r in got) == list(range(1, 1001)) and all(r.run == r.key + 1 for r in got)
    assert S.numbered(rows.limit(0), ["key"], "run").count() == 0


def test_even_sample(spark):
    rows = spark.range(1, 101).select(F.col("id").cast("string").alias("id"), F.col("id").alias("seq"))
    for known, n in (([], 5), (["50", "4"], 5), (["1", "2", "3"], 2), (["9"], 2), ([], 100)):
        chosen = [k for k in known][:n]
        last = (n - len(chosen)) * 3 + 9
        points = [50] if n - len(chosen) == 1 else [round(i * 99 / last) for i in range(last + 1)]
        for p in [*points, *range(100)]:
            if len(chosen) < n and str(p + 1) not in chosen:
                chosen.append(str(p + 1))
        assert sorted(r.id for r in S.even_sample(rows, "id", "seq", known, n).collect()) == sorted(chosen)


def test_items_in_blocks(spark):
    items = spark.createDataFrame([(k, f"item {k}x") for k in range(30)] + [(99, None)], "item_id int, text string")
    rows = spark.createDataFrame([(1, "An ITEM 3x and item 29x"), (2, None), (3, "")], "doc_id int, body string")
    for most in (1 << 20, 200):
        assert sorted(map(tuple, contained_items(items, rows, "item_id", "text", "doc_id", "body", most).collect())) == [(3, 1), (29, 1)]


def test_comparisons(spark):
    outputs = spark.createDataFrame([(1, "a", 1, "the cat"), (1, "b", 2, "The cat "), (1, "c", 3, "a dog")], "key int, v string, o int, t string")
    found = {r.pair: (r.n, r.rouge1, r.rouge2, r.same) for r in O.pair_summary(O.variant_pairs(outputs, "key", "v", "o", "t"), "key").collect()}
    assert found == {"a-b": (1, 1.0, 1.0, 1), "a-c": (1, 0.0, 0.0, 0), "b-c": (1, 0.0, 0.0, 0)}
    sizes = spark.createDataFrame([("F16", 1 << 30), ("Q4", 1 << 28)], "v string, b long")
    assert {r.v: (r.mib, r.saving_pct) for r in O.size_reduction(sizes, "v", "b", "F16").collect()} == {"F16": (1024.0, 0.0), "Q4": (256.0, 75.0)}


def test_model_hook(spark):
    rows = spark.createDataFrame([(k, f"p{k}") for k in range(150)], "k int, prompt string")
    got = with_model(rows, ["prompt"], lambda: lambda prompts: [p.upper() for p in prompts], "reply", "string", batch=40).collect()
    assert all(r.reply == r.prompt.upper() for r in got) and len(got) == 150


def test_stems_by_extended_rules():
    """Words that the published algorithm and its extended rules stem in other ways, and some that they do not."""
    words = "dying lying tying skies news innings proceed dies ties flies spied died enjoy happily day say dynamically sensibly possibly hopefully gloriously psychology geology rationally cats agreed"
    want = "die lie tie sky news inning proceed die tie fli spi die enjoy happili day say dynam sensibl possibl hope glorious psycholog geolog ration cat agre"
    plain = [stem(x) for x in words.split()]
    assert [stem(x, True) for x in words.split()] == want.split()
    assert plain[:4] == ["dy", "ly", "ty", "ski"] and plain[8:10] == ["ti", "fli"] and stem("enjoy") == "enjoi" != stem("enjoy", True)


def test_overlaps_by_counters(spark):
    rng = random.Random(8)
    rows = [(k, [rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))], [rng.choice("abcde") for _ in range(rng.randint(0, 9))]) for k in range(150)] + [(200, None, ["a"]), (201, [], [])]
    frame = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    got = {r.k: (r.s.rouge1, r.s.rouge2, r.c) for r in frame.select("k", G.gram_scores(F.col("a"), F.col("b"), [1, 2]).alias("s"), G.common(G.runs(F.col("a")), G.runs(F.col("b"))).alias("c")).collect()}
    for k, a, b in rows:
        a = a or []
        pairs = lambda x: [" ".join(p) for p in zip(x, x[1:], strict=False)]
        assert got[k] == (overlap(a, b), overlap(pairs(a), pairs(b)), sum((Counter(a) & Counter(b)).values()))


def test_long_texts_are_scored_alike(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = spark.createDataFrame([(k, say(k), say(30 - k)) for k in range(31)] + [(40, None, "a"), (41, None, None)], "k int, p string, r string")
    for n in (1, 2):
        score = lambda long: {r.k: r.s for r in S.rouge_rows(rows, ["k"], "p", "r", n, "s", long).collect()}
        assert score(0) == score(20) == score(1 << 20) and len(score(20)) == 33


def test_stemmed_scores_in_the_row(spark):
    rows = spark.createDataFrame([(1, "The cats were dying", "a cat is dying and dies"), (2, None, "x"), (3, "", ""), (4, "Running runs", "runs running RUNNING")], "k int, p string, r string")
    got = {r.k: tuple(r.s) for r in rows.select("k", stemmed_scores(F.col("p"), F.col("r")).alias("s")).collect()}
    for k, p, r in [tuple(x) for x in rows.collect()]:
        a, b = ([stem(w, True) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", (t or "").lower())] for t in (p, r))
        assert got[k] == (overlap(a, b), overlap(list(zip(a, a[1:], strict=False)), list(zip(b, b[1:], strict=False))))
