"""Texts that differ in their code points only, as Python's unicodedata takes them."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import alternatives as A
from tessera.functions import text as T
from tessera.operators.datasets import contained_either_way
from tessera.operators.records import references_contained

SOME = ["ﬁne Ａ", "Café ①②", "ＯＵＴＰＵＴ", "½ ㎏ ⅷ", "ạ̇", "x y　z", "straße İ", "각", "", "plain text!", "…—“x”", "ſtreet ﬀ", "２０２４年", "é É"]


def plain(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", text).lower())).strip()


def test_normalised_as_python_has_it(spark):
    rng = random.Random(1)
    texts = SOME + ["".join(rng.choice("".join(SOME) + "ab ,") for _ in range(rng.randint(1, 12))) for _ in range(200)] + [None]
    rows = spark.createDataFrame([(k, t, [t, None, "Ａ"]) for k, t in enumerate(texts)], "k int, t string, many array<string>")
    # marks that combine with nothing are letters for neither; Python counts some of them as words' parts
    fine = lambda t: not any(unicodedata.category(c).startswith("M") for c in unicodedata.normalize("NFKC", t).lower())
    for r in rows.select("t", T.normalised(F.col("t")).alias("n"), T.normalised_items(F.col("many")).alias("m"), T.nfkc(F.col("t")).alias("c")).collect():
        if r.t is None:
            assert (r.n, r.m, r.c) == ("", ["", "", "a"], None)
        else:
            assert r.c == unicodedata.normalize("NFKC", r.t) and r.m == [r.n, "", "a"]
            assert r.n == plain(r.t) or not fine(r.t), r.t
    assert rows.select(T.normalised_items(F.when(F.col("k") < 0, F.col("many"))).alias("m")).first().m is None


def test_ascii_texts_stay_where_they_are(spark):
    """The Arrow function gets nulls for them."""
    seen = rows = spark.createDataFrame([("plain",), ("ﬁne",)], "t string")
    plan = rows.select(T.normalised(F.col("t")).alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" in plan and "ArrowEvalPython" in plan and seen.select(T.normalised(F.col("t")).alias("n")).collect() == [("plain",), ("fine",)]


def test_comparisons_of_forms(spark):
    rows = spark.createDataFrame([(["ﬁne Ａ", "b"], ["fine a", "Ｂ!"], "1. ﬁne a, 2. ｂ", "ｏｕｔｐｕｔ:\na b\nReſponſe\n㎱")], "a array<string>, r array<string>, t string, reply string")
    got = rows.select(
        A.two_distinct(F.col("a")).alias("two"), A.two_distinct(F.array(F.lit("ﬁ"), F.lit("fi"))).alias("same"), A.exact_pair(F.col("a"), F.col("r")).alias("exact"), references_contained(F.col("t"), F.col("r")).alias("all"),
        contained_either_way(F.col("r"), F.lit("ＦＩＮＥ")).alias("either"), T.contains_normalised(F.col("t"), F.lit("ＦＩＮＥ")).alias("named"), A.alternatives(F.col("reply")).alias("found"), A.alternatives_loose(F.col("reply")).alias("loose"),
    ).first()
    assert got.asDict() == {"two": True, "same": False, "exact": 1.0, "all": True, "either": False, "named": True, "found": ["a b", "㎱"], "loose": ["a b", "㎱"]}


def test_headers_by_their_forms(spark):
    lines = ["Output", "ＯＵＴＰＵＴ!", "𝐨𝐮𝐭𝐩𝐮𝐭", "outputs", "respo㎱e", "norma lized", "Ⓓescriptions:", "dé scriptions", ""]
    got = spark.createDataFrame([(x,) for x in lines], "t string").select(A.is_header(F.col("t"), A.HEADERS + A.MORE_HEADERS).alias("h")).collect()
    assert [r.h for r in got] == [plain(x) in A.HEADERS + A.MORE_HEADERS for x in lines]
