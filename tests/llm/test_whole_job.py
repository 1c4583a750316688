"""Cases in which an operator once did less than the whole job."""

import random

import pytest

from tessera.llm.mixture import plan_mix
from tessera.llm.quotes import linked_quotes, reply_ordered
from tessera.llm.toxicity import ToxicityModel, fit_toxicity, places_of, score_toxicity, words_of


def _scored(spark, rows, toxic_ids, asked):
    docs = spark.createDataFrame([*rows, *asked], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic_ids)) for i, _ in rows], "doc_id long, toxic int")
    return {r.doc_id: r for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()}


def test_toxicity_reads_whole_words(spark):
    rng = random.Random(4)
    plain = lambda: [f"w{rng.randrange(200)}" for _ in range(40)]
    # clean and toxic words that share eleven bytes, in all texts of their kind
    rows = [(i, " ".join(plain() + ["understandvile" if i % 4 == 0 else "understandwell"] * 4)) for i in range(300)]
    asked = [(1000, " ".join(plain() + ["understandvile"] * 4)), (1001, " ".join(plain() + ["understandwell"] * 4))]
    got = _scored(spark, rows, set(range(0, 300, 4)), asked)
    assert got[1000].score >= 0.5 > got[1001].score


def test_toxicity_tells_clean_words_from_their_beginnings(spark):
    rng = random.Random(5)
    plain = lambda: [f"w{rng.randrange(200)}" for _ in range(40)]
    # the beginning is telling, as most words that have it are toxic; one of them is not
    rows = [(i, " ".join(plain() + ["understandvile"] * 4 * (i % 4 == 0) + ["understandwell"] * 4 * (i % 10 == 1))) for i in range(400)]
    asked = [(1000, " ".join(plain() + ["understandvile"] * 4)), (1001, " ".join(plain() + ["understandwell"] * 4))]
    got = _scored(spark, rows, set(range(0, 400, 4)), asked)
    assert got[1000].score >= 0.5 > got[1001].score


def test_toxicity_reads_runs_without_blanks(spark):
    rng = random.Random(6)
    han = [chr(0x4E00 + k) for k in range(300)]
    run = lambda n, bad: "".join(rng.choice(han) for _ in range(n)) + bad + "".join(rng.choice(han) for _ in range(n))
    letters = lambda n: "".join(rng.choice("bcdfghklmprtvw") for _ in range(n))
    rows = [(i, run(20, "毒骂毒骂毒骂" * (i % 4 == 0)) + " " + letters(100) + "nastynastynasty" * (i % 4 == 0) + letters(50)) for i in range(300)]
    asked = [(1000, run(30, "毒骂毒骂毒骂")), (1001, run(30, "")), (1002, letters(120) + "nastynastynasty" + letters(30)), (1003, letters(150))]
    got = _scored(spark, rows, set(range(0, 300, 4)), asked)
    assert [got[i].score >= 0.5 for i in range(1000, 1004)] == [True, False, True, False]
    assert any("毒骂" in asked[0][1][p.start : p.end] for p in got[1000].passages)


def test_words_cover_a_text():
    for text in ("One, two", "é" * 100, "x" * 200, "你好，世界 abc世def", "ไทย" * 9, "a世", "", "😀" * 30):
        data = text.encode()
        assert [data[a:b].lower() for a, b in places_of(data)] == words_of(data)
        covered = {k for a, b in places_of(data) for k in range(a, b)}
        assert covered == {k for k, c in enumerate(data) if c >= 128 or chr(c).isalnum()}
        assert all(data[a:b].decode() for a, b in places_of(data)) and max((b - a for a, b in places_of(data)), default=0) <= 64


def test_segments_scan_the_real_scores():
    model = ToxicityModel(weights={b"bad$": 6.0, b"fine$": -6.0})
    rng = random.Random(7)
    for _ in range(200):
        words = [rng.choice([b"bad", b"fine", b"so", b"so", b"so"]) for _ in range(rng.randint(1, 40))]
        scores = [model.word_score(w) for w in words]

        def maximal(a, b):
            """The best part of the range, the shortest of equals, then the same on both its sides, as the paper defines it."""
            parts = [(sum(scores[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not parts or (best := max(parts))[0] <= 0:
                return []
            _, _, i, j = best
            return [*maximal(a, i), (i, j, pytest.approx(best[0])), *maximal(j, b)]

        assert model.segments(words, {}) == maximal(0, len(words))


def test_quotes_of_parts(spark):
    rows = [
        (1, 0, "user", "a\nb\nc"),
        (1, 1, "assistant", "> a\n> b\nok"),
        (2, 0, "user", "p one\np more\n\nq two\n\nr three"),
        (2, 1, "assistant", "> p one\n> p more\n>\n> r three\nyes"),
        (2, 2, "user", "> yes\n> more than was said\nwell"),
        (2, 3, "assistant", "> q two\n>\n> well\nboth"),
        (2, 4, "user", "> not said\n> at all\nno"),
        (3, 0, "user", "x\ny"),
        (3, 1, "user", "x"),
        (3, 2, "user", "> x\n> y\nwhole"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.sources) for r in reply_ordered(messages).collect()}
    assert got[1, 1] == (0, 0, [0])
    assert [got[2, t] for t in range(5)] == [(None, 0, []), (0, 0, [0]), (1, 0, [1]), (2, 0, [0, 2]), (None, 4, [])]
    assert got[3, 2] == (0, 0, [0])
    links = {(r.conv_id, r.turn, r.line, r.passage, r.source) for r in linked_quotes(messages).collect()}
    assert {x for x in links if x[:2] in ((2, 1), (2, 4), (3, 2))} == {(2, 1, 0, "p one\np more", 0), (2, 1, 3, "r three", 0), (2, 4, 0, "not said\nat all", None), (3, 2, 0, "x\ny", 0)}


def test_mix_goes_on_after_a_first_document_beyond_the_budget(spark):
    step = (1 << 62) // 100
    rows = [("a", 1000, 1), *(("a", 10, step * k) for k in range(1, 51)), *(("b", 10, step // 2 * k) for k in range(1, 301))]
    plan = {r.source: r for r in plan_mix(spark.createDataFrame(rows, "source string, size long, h long"), [1.0, 9.0]).collect()}
    assert plan["a"].target == 450 and plan["a"].whole == 0
    for source, r in plan.items():
        taken = sum(size * (r.whole + any(size <= x.cap and x.low <= h < x.end for x in r.rules)) for own, size, h in rows if own == source)
        assert r.target - 10 < taken <= r.target
